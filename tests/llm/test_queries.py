"""The registered queries against their SQL, and the pipeline against plain versions of its stages."""

import plain
import pytest
from comparing import FOLDER, connect, difference
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import queries, toxicity

# queries over other tables than documents, with their table and key
OTHER_TABLES = {"op11_conversation_trie": ("conversations", "conv_id"), "op13_embedding_whitening": ("embeddings", "vec_id")}
WITHOUT_SQL = sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - set(OTHER_TABLES))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    want = connect().execute(queries.ORACLE_SQL[name]).df()
    assert len(want) > 100 and difference(got, want) is None
    assert not want.drop(columns="license_id", errors="ignore").isna().all().any()


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_rows(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER)
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert rows.select("doc_id").distinct().join(documents, "doc_id").count() > 0
    if name != "op4_benchmark_decontamination":
        assert rows.count() == documents.count()


def test_rows_of_other_tables(spark):
    trie = queries.QUERIES["op11_conversation_trie"](spark, FOLDER)
    conversations = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    assert trie.where("depth = 0").select("n_convs").first()[0] == conversations.select("conv_id").distinct().count()
    assert trie.select("conv_id").distinct().join(conversations, "conv_id", "left_anti").count() == 0
    assert trie.groupBy("depth", "conv_id").count().where("count > 1").count() == 0
    whitened = queries.QUERIES["op13_embedding_whitening"](spark, FOLDER)
    embeddings = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    assert whitened.count() == embeddings.count() * 16
    assert whitened.select("vec_id").distinct().join(embeddings, "vec_id", "left_anti").count() == 0


def test_near_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op9_simhash_near_dedup(spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted(plain.near_groups(docs))


def test_pipeline(spark, monkeypatch):
    """Every stage decides as its plain version does, on all that the stage before kept."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    seen = {}

    def watched(name, stage):
        def run(spark, docs, folder):
            done = stage(spark, docs, folder)
            seen[name] = (docs, done)
            return done

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, FOLDER)

    def rows(frame):
        return sorted((r["doc_id"], r["text"]) for r in frame.collect())

    for name in ("toxicity", "line_dedup", "near_dedup", "decontamination"):
        assert seen[name][1].columns == columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = toxicity.scored(docs, toxicity.fit(docs, labels)).where("predicted = 0")
    assert [d for d, _ in rows(seen["toxicity"][1])] == sorted(r["doc_id"] for r in scores.collect())
    kept = plain.line_dedup(rows(seen["line_dedup"][0]), 10)
    assert rows(seen["line_dedup"][1]) == sorted((d, text) for d, _, _, text in kept)
    near = plain.near_groups(rows(seen["near_dedup"][0]))
    assert [d for d, _ in rows(seen["near_dedup"][1])] == sorted({least for _, _, least in near})
    before, after = rows(seen["decontamination"][0]), rows(seen["decontamination"][1])
    leaking = {d for d, text in before if any(text.find(t) >= 0 for _, t in items)}
    assert leaking and [d for d, _ in after] == [d for d, _ in before if d not in leaking]
    assert sorted(r["doc_id"] for r in packed.collect()) == [d for d, _ in after]


def test_stages_with_odd_rows(spark, frame):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, score int, copy int"
    odd = [(None, None), (None, "a b"), (1, None), (2, ""), (2, ""), (3, "x " * 50_000), (4, "same"), (5, "same")]
    for rows in (odd, []):
        docs = frame([(d, t, None, None, None, 1, 2, 3) for d, t in rows], schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert corpus_pipeline.pack(spark, docs, FOLDER).count() == docs.select(F.col("doc_id")).count()
