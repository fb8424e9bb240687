from foliospark.operators import pages as pg
from foliospark.plans import check_text
from foliospark.plans.rendered import Tables

SCHEMA = "doc_id int, page_no int, engine string, psm int, text string"
WORDS = "one two three four five six seven "
ROWS = [
    (1, 1, "tesseract", 6, WORDS * 4),
    (1, 2, "tesseract", 6, WORDS),
    (1, 2, "easyocr", None, WORDS * 2),
    (1, 3, "tesseract", 6, "few"),
    (2, 1, "tesseract", 6, None),
    (None, 1, "tesseract", 6, WORDS),
]


def test_documents_of_chosen_pages_are_those_of_the_attempts(spark):
    attempts = spark.createDataFrame(ROWS, SCHEMA)
    chosen = pg.choose_ocr(attempts)
    for last in (False, True):
        straight = sorted(map(repr, pg.ocr_documents(attempts, compat_last_page=last).collect()))
        assert sorted(map(repr, pg.ocr_documents(chosen, compat_last_page=last).collect())) == straight


def test_both_forms_share_one_choice_of_pages(spark, monkeypatch):
    calls = []
    choose = pg.choose_ocr
    monkeypatch.setattr(pg, "choose_ocr", lambda *a, **k: calls.append(1) or choose(*a, **k))
    attempts = spark.createDataFrame(ROWS[:5], SCHEMA)
    monkeypatch.setattr(check_text, "ocr_attempts", lambda t: attempts)
    rows = {r["doc_id"]: r for r in check_text.ocr_documents(Tables(spark, "")).collect()}
    assert len(calls) == 1
    assert (rows[1]["all_words"], rows[1]["last_words"]) == (28 + 14, 14)
    assert rows[2]["error"] is not None and rows[2]["all_words"] == 0


def test_lines_are_dealt_out_once_for_choice_and_joining(spark, tmp_path):
    texts = [(1, "\n".join([WORDS * 4, " ", WORDS])), (2, "few\n\t"), (3, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = pg.join_chosen(pg.choose_ocr(check_text.ocr_attempts(Tables(spark, str(tmp_path)))))
    assert pages._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    # pages -1 to 1 of document 1 show its first line, 2 and 3 its last
    for last, words in ((False, {1: 3 * 28 + 2 * 7, 2: None}), (True, {1: 7, 2: None})):
        rows = {r["doc_id"]: r for r in pg.ocr_documents(pages, compat_last_page=last).collect()}
        assert {k: r["word_count"] for k, r in rows.items()} == words
        assert rows[2]["error"] is not None and rows[1]["error"] is None


def test_last_page_form_reads_no_text(spark, tmp_path):
    pg.join_chosen(spark.createDataFrame(ROWS, SCHEMA)).write.parquet(f"{tmp_path}/joined")
    joined = spark.read.parquet(f"{tmp_path}/joined")
    counts = pg.ocr_documents(joined, compat_last_page=True).select("doc_id", "word_count")
    assert "text" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["word_count"] for r in counts.collect()} == {1: 14, 2: None, None: 7}
