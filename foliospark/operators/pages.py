"""From pages to documents, and the choice between OCR attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions.base import strip_space
from foliospark.functions.text import fix_ocr, is_blank, word_count

PAGE_BREAK = "\n\n"
PAGES_PER_PIECE = 256


def _join_pages(
    pages: DataFrame, doc: str, page: str, text: str, carried: str | None = None, filled: str | None = None
) -> DataFrame:
    """``(doc, text)``: page texts in page order with a blank line between them; null texts are left
    out, a document of null texts only gets a null.  ``carried`` is kept from the last page with text.
    ``filled`` names a boolean column of the pages; a document has it if any of its pages has.

    Pages are first joined in pieces of consecutive pages, so the pages of one very long document
    are gathered by many tasks; only the joined pieces meet in one row.
    """

    def gather(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        entry = F.struct(F.col(order).alias("at"), F.col(text).alias("text"))
        ordered = F.sort_array(F.collect_list(entry))
        joined = F.array_join(F.transform(ordered, lambda e: e["text"]), PAGE_BREAK)
        out = [F.when(F.count(text) > 0, joined).alias(text)]
        if carried:
            last = F.max_by(carried, F.when(F.col(text).isNotNull(), F.col(order)))
            out.append(last.alias(carried))
        if filled:
            out.append(F.bool_or(filled).alias(filled))
        return df.groupBy(*keys).agg(*out)

    kept = [doc, page, text] + [c for c in (carried, filled) if c]
    piece = F.floor(F.col(page) / PAGES_PER_PIECE).alias("_piece")
    return gather(gather(pages.select(*kept, piece), [doc, "_piece"], page), [doc], "_piece")


def assemble_pages(
    pages: DataFrame,
    min_chars: int = fixed.MIN_NATIVE_CHARS,
    doc: str = "doc_id",
    page: str = "page_no",
    text: str = "text",
) -> DataFrame:
    """``(doc, text)`` from a text layer: null where all pages together are too short."""
    filled = pages.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    whole = strip_space(text)
    joined = _join_pages(filled, doc, page, text)
    return joined.select(doc, F.when(F.length(whole) >= min_chars, fix_ocr(whole)).alias(text))


def assemble_ocr_pages(
    pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text"
) -> DataFrame:
    """``(doc, text, error)`` from recognised pages: empty pages are left out, a document without
    any text becomes an error row."""
    # Documents keep a row even when every page is empty, so empty texts are dropped in the list.
    kept = pages.withColumn(text, F.nullif(F.col(text), F.lit("")))
    joined = _join_pages(kept, doc, page, text)
    blank = is_blank(text)
    return joined.select(
        doc,
        F.when(~blank, F.col(text)).alias(text),
        F.when(blank, F.lit(fixed.NO_TEXT_ERROR)).alias("error"),
    )


def choose_ocr(
    attempts: DataFrame, doc: str = "doc_id", page: str = "page_no"
) -> DataFrame:
    """``(doc, page, ocr_engine, text, word_count, error)`` per page out of its OCR attempts.

    The automatic layout only replaces the block layout when that gave few words and it found
    more; the second engine only counts when the first one stayed short.  The text a page ends up with
    may come from the first engine and still be reported under the second.
    """

    def attempt(engine: str, psm: int | None) -> F.Column:
        wanted = F.col("engine") == engine
        if psm is not None:
            wanted = wanted & (F.col("psm") == psm)
        return F.coalesce(F.max(F.when(wanted, strip_space("text"))), F.lit(""))

    tried = attempts.groupBy(doc, page).agg(
        attempt("tesseract", 6).alias("block"),
        attempt("tesseract", 3).alias("auto"),
        attempt("easyocr", None).alias("second"),
    )
    few = fixed.MIN_ENGINE_WORDS
    switch = (word_count("block") < few) & (word_count("auto") > word_count("block"))
    first = tried.select(
        doc,
        page,
        fix_ocr(F.when(switch, F.col("auto")).otherwise(F.col("block"))).alias("first"),
        "second",
    ).withColumn("first_words", word_count("first"))
    enough = F.col("first_words") >= few
    # The second engine's text is only cleaned where it is needed.
    both = first.select(
        doc, page, "first", "first_words", F.when(~enough, fix_ocr(F.col("second"))).alias("second")
    ).withColumn("second_words", F.when(~enough, word_count("second")))
    better = ~enough & (F.col("second_words") > F.col("first_words"))
    final = both.select(
        doc,
        page,
        F.when(enough, "tesseract").otherwise("easyocr").alias("engine"),
        F.when(better, F.col("second")).otherwise(F.col("first")).alias("text"),
        F.when(better, F.col("second_words")).otherwise(F.col("first_words")).alias("words"),
    )
    readable = F.col("words") >= fixed.MIN_USABLE_WORDS
    return final.select(
        doc,
        page,
        F.when(readable, F.col("engine")).alias("ocr_engine"),
        F.when(readable, F.col("text")).alias("text"),
        "words",
        F.when(~readable, F.lit(fixed.LOW_QUALITY_ERROR)).alias("error"),
    ).withColumnRenamed("words", "word_count")


def join_chosen(attempts: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """``(doc, text, _read, _filled)``: pages chosen from their attempts, then joined; what ``ocr_documents``
    makes its results of.  ``attempts`` may also be the outcome of ``choose_ocr``."""
    read = F.struct(F.col("ocr_engine").alias("engine"), F.col("word_count").alias("words"))
    chosen = attempts if "ocr_engine" in attempts.columns else choose_ocr(attempts, doc, page)
    text = F.nullif(F.col("text"), F.lit(""))
    # a document is blank where all its pages are: told page by page, so that a result without the
    # text need not read it
    chosen = chosen.select(doc, page, text.alias("text"), read.alias("_read"), (~is_blank("text")).alias("_filled"))
    return _join_pages(chosen, doc, page, "text", "_read", "_filled")


def ocr_documents(
    attempts: DataFrame, doc: str = "doc_id", page: str = "page_no", compat_last_page: bool = False
) -> DataFrame:
    """``(doc, text, error, ocr_engine, word_count)``: pages chosen from their attempts, then joined;
    unreadable pages count as empty.  ``attempts`` may also be the outcome of ``choose_ocr`` or of
    ``join_chosen``, where several results are made of the same pages.

    The engine is that of the last page that could be read.  The word count is that of the joined text,
    or with ``compat_last_page`` that of the last page alone.
    """
    joined = attempts if "_filled" in attempts.columns else join_chosen(attempts, doc, page)
    blank = ~F.col("_filled")
    words = F.col("_read.words") if compat_last_page else word_count("text")
    return joined.select(
        doc,
        F.when(~blank, F.col("text")).alias("text"),
        F.when(blank, F.lit(fixed.NO_TEXT_ERROR)).alias("error"),
        F.when(~blank, F.col("_read.engine")).alias("ocr_engine"),
        F.when(~blank, words).alias("word_count"),
    )


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents with some text."""
    return df.where(~is_blank(text))


def quality_flags(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``word_count``, ``usable`` and ``low_quality``."""
    from foliospark.functions.results import low_quality, usable

    counted = df.withColumn("word_count", word_count(text))
    return counted.withColumn("usable", usable("word_count")).withColumn(
        "low_quality", low_quality("word_count")
    )
