"""Results stay whole and plans stay safe when one key holds most rows."""

import hashlib
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from foliospark.functions.dispatch import fields_by_class
from foliospark.operators import pages, ranking, splitting, words
from foliospark.operators.topk import top_per_group


def plan(frame):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def skewed(spark):
    """30,000 rows, 80 % of them in one class, one class of a single row."""
    label = F.when(F.col("id") == 7, "one").when(F.col("id") % 10 < 8, "big").otherwise(
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))
    )
    return spark.range(30000).select(F.col("id").alias("doc_id"), label.alias("label"))


def places(frame, seed):
    by_label = {}
    for row in frame.collect():
        key = hashlib.md5(f"{seed}:{row['doc_id']}".encode()).hexdigest()
        by_label.setdefault(row["label"], []).append((key, row["doc_id"]))
    return {label: [i for _, i in sorted(keys)] for label, keys in by_label.items()}


@pytest.mark.parametrize("limit", [1, 10, 5000])
def test_limit_per_class(skewed, limit):
    got = ranking.limit_per_class(skewed, limit, "label", "doc_id")
    chosen = {}
    for row in got.collect():
        chosen.setdefault(row["label"], set()).add(row["doc_id"])
    assert chosen == {label: set(ids[:limit]) for label, ids in places(skewed, 0).items()}


@pytest.mark.parametrize("limit", [None, 0])
def test_no_limit(skewed, limit):
    assert ranking.limit_per_class(skewed, limit, "label", "doc_id").count() == 30000


def test_split_and_folds(skewed):
    usable = skewed.where("label <> 'one'")
    split = splitting.stratified_split(usable)
    parts = {(r["label"], r["part"]): r["count"] for r in split.groupBy("label", "part").count().collect()}
    assert sum(n for (_, part), n in parts.items() if part == "test") == 6000
    for label, ids in places(usable, 42).items():
        share = parts[label, "test"] / len(ids)
        assert abs(share - 0.2) < 0.001
    folds = splitting.kfold(usable, 5)
    sizes = {}
    for r in folds.groupBy("label", "fold").count().collect():
        sizes.setdefault(r["label"], []).append(r["count"])
    assert all(len(s) == 5 and max(s) - min(s) <= 1 for s in sizes.values())


def test_tiny_class_in_folds(skewed):
    folds = splitting.kfold(skewed, 3)
    assert [r["fold"] for r in folds.where("label = 'one'").collect()] == [0]
    assert folds.count() == 30000


def test_the_rows_themselves_are_not_shuffled(skewed):
    text = plan(splitting.stratified_split(skewed))
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text


def test_one_document_with_most_pages(spark):
    long = spark.range(3000).select(
        F.lit(1).alias("doc_id"), F.col("id").alias("page_no"), F.concat(F.lit("p"), "id").alias("text")
    )
    short = spark.createDataFrame([(2, 1, "b"), (2, 0, "a"), (3, 0, " "), (4, 0, None)], "doc_id int, page_no bigint, text string")
    both = long.union(short).repartition(16)
    got = {r["doc_id"]: r["text"] for r in pages.assemble_pages(both, min_chars=1).collect()}
    assert got == {1: "\n\n".join(f"p{i}" for i in range(3000)), 2: "a\n\nb", 3: None, 4: None}
    read = {r["doc_id"]: (r["text"], r["error"] is None) for r in pages.assemble_ocr_pages(both).collect()}
    assert read[2] == ("a\n\nb", True) and read[3] == (None, False) and read[4] == (None, False)
    assert read[1] == ("\n\n".join(f"p{i}" for i in range(3000)), True)


def test_minimum_length_of_the_text_layer(spark):
    rows = [(1, 0, "x" * 49), (2, 0, "x" * 50), (3, 0, " " * 9 + "x" * 41), (4, 0, "x" * 25), (4, 1, "y" * 23)]
    frame = spark.createDataFrame(rows, "doc_id int, page_no int, text string")
    got = {r["doc_id"]: r["text"] is not None for r in pages.assemble_pages(frame).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_hot_document_of_words(spark):
    hot = spark.range(20000).select(
        F.when(F.col("id") < 19990, 1).otherwise(2).alias("doc_id"),
        F.col("id").alias("word_idx"),
        F.concat(F.lit("$"), (F.col("id") % 997 + 1).cast("string")).alias("text"),
        (F.col("id") % 100).cast("int").alias("top"),
    )
    ranked = sorted(((-(i % 100), i, i % 997 + 1) for i in range(19990)))[:5]
    found = words.total_spatial(hot)
    totals = {r["doc_id"]: r["total"] for r in found.collect()}
    assert totals[1] == max(v for _, _, v in ranked) and len(totals) == 2
    assert "WindowGroupLimit" in plan(found)


def test_top_per_group(spark):
    frame = spark.range(5000).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("big").alias("g"), "id", (F.col("id") % 13).alias("n")
    )
    got = top_per_group(frame, "g", [F.desc("n"), F.col("id")], 40, "id")
    want = {"small": [], "big": []}
    for i in range(5000):
        want["small" if i % 50 == 0 else "big"].append((-(i % 13), i))
    found = {"small": set(), "big": set()}
    for r in got.collect():
        found[r["g"]].add(r["id"])
    assert found == {g: {i for _, i in sorted(v)[:40]} for g, v in want.items()}


def test_extraction_has_no_shuffle(spark):
    frame = spark.createDataFrame([("Invoice", "x")], "label string, text string")
    text = plan(frame.select(fields_by_class("label", "text")))
    assert "Exchange" not in text and "EvalPython" not in text


OCR_CASES = {
    # page: (block layout, automatic layout, second engine) -> engine, words
    1: (25, 40, 50, "tesseract", 25),
    2: (19, 20, 30, "tesseract", 20),
    3: (19, 19, 30, "easyocr", 30),
    4: (10, 15, 15, "easyocr", 15),
    5: (4, 3, 4, None, 4),
    6: (0, 0, 5, "easyocr", 5),
    7: (20, 50, 60, "tesseract", 20),
    8: (5, 0, 0, "easyocr", 5),
}


def test_choice_between_attempts(spark):
    rows = []
    for page, (block, auto, second, _, _) in OCR_CASES.items():
        rows += [
            (1, page, "tesseract", 6, "b " * block),
            (1, page, "tesseract", 3, "a " * auto),
            (1, page, "easyocr", None, "e " * second),
        ]
    frame = spark.createDataFrame(rows, "doc_id int, page_no int, engine string, psm int, text string")
    for row in pages.choose_ocr(frame).collect():
        engine, count = OCR_CASES[row["page_no"]][3:]
        assert (row["ocr_engine"], row["word_count"]) == (engine, count), row
        assert (row["error"] is None) == (engine is not None)
