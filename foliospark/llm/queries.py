"""The registered queries of the operators in this folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import (
    conversation_trie,
    decontamination,
    exact_dedup,
    language_id,
    licenses,
    line_dedup,
    packing,
    quality,
    simhash,
    substring_dedup,
    token_counts,
    toxicity,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sha256(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    done = substring_dedup.without_repeats(docs, substring_dedup.repeated_intervals(docs))
    return done.select("row.doc_id", "n_words", "n_removed", _sha256(F.col("kept")).alias("kept_sha256"))


OP1_SQL = r"""
with words as (
    select doc_id, unnest(parts) as word, unnest(range(len(parts))) as i
    from (
        select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as parts
        from documents
    )
),
windows as (
    select doc_id, i, word, count(*) over ahead as size, string_agg(word, ' ') over ahead as content
    from words
    window ahead as (partition by doc_id order by i rows between current row and 34 following)
),
repeated as (
    select content from windows where size = 35 group by content having count(*) > 1
),
marked as (
    select doc_id, i, word, size = 35 and content in (select content from repeated) as start from windows
),
covered as (
    select doc_id, i, word, bool_or(start) over (
        partition by doc_id order by i rows between 34 preceding and current row) as gone
    from marked
)
select doc_id, count(word) as n_words, count(*) filter (where gone) as n_removed,
    sha256(coalesce(string_agg(word, ' ' order by i) filter (where not gone), '')) as kept_sha256
from documents left join covered using (doc_id)
group by doc_id
"""


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    done = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return done.select("row.doc_id", "n_lines", "n_dropped", _sha256(F.col("kept")).alias("kept_sha256"))


OP2_SQL = r"""
with lines as (
    select doc_id, i, line,
        translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from (
        select doc_id, unnest(parts) as line, unnest(range(len(parts))) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)
    )
),
frequent as (
    select key from lines where length(key) >= 1 group by key having count(distinct doc_id) >= 10
),
marked as (
    select doc_id, i, line, key in (select key from frequent) as dropped from lines
)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""

def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.scored(docs, quality.fit(docs, _table(spark, folder, "labels")))


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return decontamination.leaks(docs, benchmark)


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned(_table(spark, folder, "documents"), licenses.known_digests(spark))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return language_id.predicted(docs, language_id.fit(docs))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, _table(spark, folder, "labels")))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


OP8_SQL = """
with normal as (
    select doc_id, translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm
    from documents
)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
    doc_id = max(doc_id) over same as kept, sha256(norm) as text_sha256
from normal window same as (partition by norm)
"""


def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, folder, "documents"))
    return groups.select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.trie(_table(spark, folder, "conversations"))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counted(_table(spark, folder, "documents"))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_packing": op10_packing,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_token_counts": op12_token_counts,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op5_license_scan": licenses.sql(),
    "op8_exact_dedup": OP8_SQL,
}
