"""Registered queries: scans, file selection, cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions.base import normalise_space
from foliospark.operators.pages import drop_blank
from foliospark.operators.ranking import limit_per_class
from foliospark.plans import oracle_parts as sql
from foliospark.plans.registry import register
from foliospark.plans.rendered import CACHE, CORPUS, FILES, Tables
from foliospark.session import scratch_path
from foliospark.sources import cache as cached
from foliospark.sources import corpus

# The languages of the test documents stand for the category folders.
FOLDERS = {"en": "Invoice", "fr": "Email", "de": "Questionnaire", "es": "Resume"}
_LABEL = "case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in FOLDERS.items()) + " end"
_FILES = f"select f.*, {_LABEL} as label from ({FILES}) f"


def labelled_files(t: Tables) -> DataFrame:
    return corpus.with_label(t.derive(FILES), FOLDERS)


# The documents written out as text files in a folder per class, and read back by the scan.
@register(
    "corpus_scan",
    f"""
    select label, sum(strlen(text) + 1) as bytes, sum(strlen(text) + 1) as content_bytes, true as named
    from ({CORPUS}) c group by label
    """,
)
def corpus_scan(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "corpus")
    documents = t.derive(CORPUS)
    for folder, label in fixed.CATEGORY_FOLDERS.items():
        documents.where(F.col("label") == label).select("text").write.text(f"{root}/{folder}")
    found = corpus.scan_corpus(t.spark, root, suffixes=[".txt"])
    return found.groupBy("label").agg(
        F.sum("length").alias("bytes"),
        F.sum(F.octet_length("content")).alias("content_bytes"),
        F.bool_and(F.endswith(F.col("path"), F.lit(".txt"))).alias("named"),
    )


@register(
    "supported_files",
    f"select path, length from ({FILES}) f "
    f"where {sql.suffix('path')} in {sql.in_list(fixed.SUPPORTED_SUFFIXES)}",
)
def supported_files(t: Tables) -> DataFrame:
    return corpus.filter_supported(t.derive(FILES)).select("path", "length")


@register(
    "url_suffix",
    f"select page_id, {sql.suffix('url')} as suffix from {{pages}}",
)
def url_suffix(t: Tables) -> DataFrame:
    return t.pages.select("page_id", corpus.suffix("url").alias("suffix"))


@register(
    "size_cap",
    f"select path, length from ({FILES}) f where length <= {fixed.MAX_UPLOAD_BYTES}",
)
def size_cap(t: Tables) -> DataFrame:
    return corpus.filter_size(t.derive(FILES)).select("path", "length")


@register(
    "per_class_limit",
    f"""
    select path, label from (
        select path, label,
            row_number() over (partition by label order by md5('0:' || path), path) as place
        from ({_FILES}) f
    ) r where place <= 25
    """,
)
def per_class_limit(t: Tables) -> DataFrame:
    return limit_per_class(labelled_files(t), 25).select("path", "label")


@register(
    "incremental_text",
    f"""
    with cache as ({CACHE})
    select path, text from cache
    union all
    select f.path, {sql.normalise('d.text')} as text
    from ({FILES}) f
    join {{documents}} d on d.doc_id = f.doc_id
    where not exists (select 1 from cache c where c.path = f.path)
    """,
)
def incremental_text(t: Tables) -> DataFrame:
    texts = t.documents.select("doc_id", "text")

    def extract(new: DataFrame) -> DataFrame:
        return new.join(texts, "doc_id").select("path", normalise_space("text").alias("text"))

    return cached.incremental_text(t.derive(FILES), t.derive(CACHE), extract)


@register(
    "cache_coverage",
    f"""
    select f.label, count(*) as files, count(c.path) as cached,
        count(*) - count(c.path) as to_do
    from ({_FILES}) f left join ({CACHE}) c on c.path = f.path
    group by f.label
    """,
)
def cache_coverage(t: Tables) -> DataFrame:
    return cached.cache_coverage(labelled_files(t), t.derive(CACHE))


@register(
    "nonblank_docs",
    f"""
    select doc_id, line_no, text from (
        select doc_id, unnest(w) as text, generate_subscripts(w, 1) as line_no
        from (select doc_id, string_split(text, chr(10)) as w from {{documents}}) s
    ) l where {sql.strip('text')} <> ''
    """,
)
def nonblank_docs(t: Tables) -> DataFrame:
    return drop_blank(document_lines(t))


def document_lines(t: Tables) -> DataFrame:
    """``(doc_id, line_no, text)``: the lines of the documents as pages."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return lines.select("doc_id", (F.col("at") + 1).alias("line_no"), "text")


@register(
    "split_summary",
    f"""
    with lists as (
        select case quality when 1 then 'train' else 'val' end as split, f.path as line
        from ({FILES}) f join {{labels}} l on l.doc_id = f.doc_id
    ),
    names(split) as (values ('train'), ('val'), ('test'))
    select n.split, count(l.line) as entries, count(l.line) > 0 as present,
        (select count(*) from ({FILES}) f where path like '%.tif') as images
    from names n left join lists l on l.split = n.split
    group by n.split
    """,
)
def split_summary(t: Tables) -> DataFrame:
    files = t.derive(FILES)
    split = F.when(F.col("quality") == 1, "train").otherwise("val")
    lists = files.join(t.labels, "doc_id").select(split.alias("split"), F.col("path").alias("line"))
    return corpus.split_summary(lists, files)


@register(
    "route_input",
    f"""
    select path, case when s = '.pdf' then 'pdf'
        when s in {sql.in_list(fixed.IMAGE_SUFFIXES)} then 'image' else 'unsupported' end as route
    from (select path, {sql.suffix('path')} as s from ({FILES}) f) r
    """,
)
def route_input(t: Tables) -> DataFrame:
    return t.derive(FILES).select("path", corpus.route("path").alias("route"))
