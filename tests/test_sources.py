"""Folder trees, the text cache, writers."""

import json
import pathlib

import pytest
from pyspark.errors import IllegalArgumentException
from pyspark.sql import functions as F

from foliospark.functions import results as rs
from foliospark.sources import cache, corpus, sinks


def files(root: pathlib.Path, names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 10)


def test_scan(spark, tmp_path):
    files(tmp_path, ["invoices/a.PDF", "invoices/b.txt", "emails/c.tif", "other/d.pdf", "resumes/e.docx"])
    (tmp_path / "questionnaires").mkdir()
    found = corpus.scan_corpus(spark, str(tmp_path))
    rows = {(pathlib.Path(r["path"]).name, r["label"], r["length"]) for r in found.collect()}
    assert rows == {("a.PDF", "Invoice", 10), ("c.tif", "Email", 10)}
    assert corpus.scan_corpus(spark, str(tmp_path / "nowhere")).count() == 0


def test_cache_grows_by_new_files_only(spark, tmp_path):
    place, seen = str(tmp_path / "cache"), []

    def extract(new):
        seen.append(sorted(r["path"] for r in new.select("path").collect()))
        return new.withColumn("text", F.upper("path"))

    first = spark.createDataFrame([("a",), ("b",)], "path string")
    cache.extend_cache(first, place, extract)
    cache.extend_cache(first.union(spark.createDataFrame([("c",)], "path string")), place, extract)
    assert seen == [["a", "b"], ["c"]]
    assert sorted(map(tuple, cache.read_cache(spark, place).collect())) == [
        ("a", "A"),
        ("b", "B"),
        ("c", "C"),
    ]


def test_route_and_size(spark):
    rows = [("x.PDF", 1), ("y.Jpeg", 32 * 1024 * 1024), ("z", 32 * 1024 * 1024 + 1), ("w.doc", 5)]
    frame = spark.createDataFrame(rows, "path string, length bigint")
    routes = [r[0] for r in frame.select(corpus.route("path")).collect()]
    assert routes == ["pdf", "image", "unsupported", "unsupported"]
    assert [r["path"] for r in corpus.filter_size(frame).collect()] == ["x.PDF", "y.Jpeg", "w.doc"]


def packed(spark):
    scores = [("a/b c.pdf", "Hello " * 200, 0.6, 0.4), ("d.pdf", "short", 0.3, 0.3)]
    frame = spark.createDataFrame(scores, "file string, raw_text string, p double, q double")
    ranked = rs.rank_scores(["Email", "Invoice"], [F.col("p"), F.col("q")])
    return rs.pack_result(
        frame.select(
            "file",
            "raw_text",
            F.lit("tesseract").alias("ocr_engine"),
            F.lit(3).alias("word_count"),
            F.lit("fr").alias("detected_language"),
            ranked.alias("all_scores"),
        )
    )


def test_written_results(spark, tmp_path):
    out = str(tmp_path / "results")
    sinks.write_results(packed(spark), out)
    lines = [json.loads(x) for f in pathlib.Path(out).glob("*.json") for x in f.read_text().splitlines()]
    by_file = {x["file"]: x for x in lines}
    assert len(by_file["a/b c.pdf"]["raw_text_preview"]) == 500
    assert by_file["a/b c.pdf"]["label"] == "EMAIL" and "raw_text" not in by_file["a/b c.pdf"]
    assert by_file["d.pdf"]["is_uncertain"] is True


def test_written_logs(spark, tmp_path):
    out = str(tmp_path / "logs")
    sinks.write_debug_log(packed(spark), out)
    logs = spark.read.parquet(out).collect()
    assert all(r["log"].startswith("=== OCR DEBUG ===") and "Invoice fields" not in r["log"] for r in logs)
    assert sorted(r["log_name"].split("_", 2)[2] for r in logs) == ["a_b_c.pdf.txt", "d.pdf.txt"]
    assert next(pathlib.Path(out).iterdir()).name.startswith(("day=", "_", "."))


def test_response_of_a_short_foreign_document(spark):
    rows = {r["file"]: r for r in rs.to_response(packed(spark)).collect()}
    row = rows["a/b c.pdf"]
    assert row["confidence"] == 60.0 and row["warning"] is True
    assert row["warning_msg"].startswith("Only 3 words") and "(French)" in row["warning_msg"]
    assert row["text_preview"] == ("Hello " * 200).strip()


def test_card_counts_the_rest(spark):
    long = packed(spark).withColumn("raw_text", F.repeat(F.lit("x"), 3234))
    card = rs.result_card(long).first()["card"]
    assert "… [1,234 more characters]" in card and "█" * 12 in card


def test_failed_extractions_go_to_their_own_table(spark, tmp_path):
    place = str(tmp_path / "cache")
    files = spark.createDataFrame([("a", b"A"), ("b", b"\xff"), ("c", None), ("a", b"A")], "path string, content binary")
    for _ in range(2):
        cache.extend_cache(files, place, cache.guarded(lambda content: content.decode()))
        assert [tuple(r) for r in cache.read_cache(spark, place).collect()] == [("a", "A")]
    failed = cache.read_failures(spark, place + "-failed").collect()
    assert {(r["path"], r["error"].split(":")[0]) for r in failed} == {("b", "UnicodeDecodeError"), ("c", "AttributeError")}
    assert cache.read_failures(spark, str(tmp_path / "none")).count() == 0


def test_a_path_cached_twice_counts_once(spark):
    known = spark.createDataFrame([("a", "A"), ("a", "A"), ("b", "B")], cache.CACHE_SCHEMA)
    files = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("c", "x")], "path string, label string")
    done = cache.incremental_text(files, known, lambda new: new.withColumn("text", F.upper("path")))
    assert sorted(map(tuple, done.collect())) == [("a", "A"), ("b", "B"), ("c", "C")]
    assert cache.cache_coverage(files.distinct(), known).first()["cached"] == 2


def test_only_a_missing_path_is_an_empty_cache(spark, tmp_path):
    assert cache.read_cache(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(IllegalArgumentException):
        cache.read_cache(spark, "nosuchscheme:\\bad")
