"""From ranked class scores to result, response, log and card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions.base import col, python_round, strip_space
from foliospark.functions.invoice import FIELD_NAMES, FIELDS_TYPE
from foliospark.functions.language import is_non_english, language_name

RESULT_COLUMNS = [
    "file",
    "label",
    "confidence",
    "is_uncertain",
    "all_scores",
    "summary",
    "ocr_engine",
    "word_count",
    "detected_language",
    "language_name",
    "is_non_english",
    "raw_text",
    "invoice_fields",
]


def rank_scores(classes: list[str], probabilities: list[Column]) -> Column:
    """Scores from high to low; equal scores stay in class order."""
    entries = F.array(
        *[
            F.struct(
                (-p).alias("descending"),
                F.lit(position).alias("position"),
                F.lit(name).alias("label"),
                p.alias("confidence"),
            )
            for position, (name, p) in enumerate(zip(classes, probabilities))
        ]
    )
    return F.transform(F.sort_array(entries), lambda e: F.struct(e["label"], e["confidence"]))


def top_class(all_scores: Column | str) -> Column:
    return F.get(col(all_scores), F.lit(0))


def is_uncertain(confidence: Column | str) -> Column:
    return col(confidence) < fixed.UNCERTAIN_BELOW


def summary(label: Column | str, confidence: Column | str) -> Column:
    """One sentence about the outcome; the article follows the first letter."""
    name = F.upper(col(label))
    article = F.when(F.substring(name, 1, 1).isin(list("AEIOU")), "an").otherwise("a")
    return F.when(
        is_uncertain(confidence), F.concat(F.lit("Uncertain — closest match is "), name, F.lit("."))
    ).otherwise(F.concat(F.lit("This is "), article, F.lit(" "), name, F.lit(".")))


def percent(confidence: Column | str) -> Column:
    """Share as percent with one decimal, exact ties to the even digit."""
    return python_round(col(confidence) * 100, 1)


def low_quality(words: Column | str) -> Column:
    return col(words) < fixed.LOW_QUALITY_WORDS


def usable(words: Column | str) -> Column:
    return col(words) >= fixed.MIN_USABLE_WORDS


def warning_message(words: Column | str, code: Column | str) -> Column:
    """Joined warnings, null without any."""
    parts = F.concat_ws(
        " ",
        F.when(low_quality(words), F.format_string(fixed.FEW_WORDS_WARNING, col(words))),
        F.when(
            is_non_english(code), F.format_string(fixed.LANGUAGE_WARNING, language_name(code))
        ),
    )
    return F.nullif(parts, F.lit(""))


def confidence_tier(pct: Column | str) -> Column:
    value = col(pct)
    return (
        F.when(value >= fixed.TIER_HIGH, "high").when(value >= fixed.TIER_MID, "mid").otherwise("low")
    )


def engine_label(engine: Column | str) -> Column:
    return F.when(col(engine) == "easyocr", "EasyOCR (handwriting)").otherwise("Tesseract")


def pack_result(df: DataFrame) -> DataFrame:
    """Add the result columns to ``(file, raw_text, ocr_engine, word_count, detected_language,
    all_scores)``; ``invoice_fields`` is kept when it is there, else null."""
    top = top_class("all_scores")
    fields = (
        col("invoice_fields")
        if "invoice_fields" in df.columns
        else F.lit(None).cast(FIELDS_TYPE)
    )
    return df.select(
        "file",
        F.upper(top["label"]).alias("label"),
        top["confidence"].alias("confidence"),
        is_uncertain(top["confidence"]).alias("is_uncertain"),
        "all_scores",
        summary(top["label"], top["confidence"]).alias("summary"),
        "ocr_engine",
        "word_count",
        "detected_language",
        language_name("detected_language").alias("language_name"),
        is_non_english("detected_language").alias("is_non_english"),
        "raw_text",
        fields.alias("invoice_fields"),
    )


def with_preview(results: DataFrame) -> DataFrame:
    """The stored form of a result: the text shortened to its first characters."""
    preview = F.substring("raw_text", 1, fixed.PREVIEW_CHARS)
    return results.withColumn("raw_text_preview", preview).drop("raw_text")


def to_response(results: DataFrame) -> DataFrame:
    """The form shown to a caller: percents, stripped text, warnings."""
    return results.select(
        "file",
        "label",
        percent("confidence").alias("confidence"),
        "is_uncertain",
        "summary",
        F.transform(
            "all_scores",
            lambda s: F.struct(s["label"].alias("label"), percent(s["confidence"]).alias("confidence")),
        ).alias("all_scores"),
        "ocr_engine",
        "word_count",
        strip_space("raw_text").alias("text_preview"),
        "invoice_fields",
        "detected_language",
        "language_name",
        "is_non_english",
        (low_quality("word_count") | col("is_non_english")).alias("warning"),
        warning_message("word_count", "detected_language").alias("warning_msg"),
    )


def display_fields(response: DataFrame) -> DataFrame:
    """Texts for showing: a dash for missing invoice fields, a default for missing text."""
    shown = [
        F.when(
            (col("label") == "INVOICE") & col("invoice_fields").isNotNull(),
            F.coalesce(col("invoice_fields")[name].cast("string"), F.lit(fixed.EM_DASH)),
        ).alias(name)
        for name in FIELD_NAMES[:-1]
    ]
    text = F.coalesce(F.nullif(col("text_preview"), F.lit("")), F.lit(fixed.NO_TEXT_SHOWN))
    return response.select(
        "file",
        "label",
        confidence_tier("confidence").alias("tier"),
        engine_label("ocr_engine").alias("engine"),
        *shown,
        text.alias("text_shown"),
    )


def debug_log(results: DataFrame, stamp: Column | None = None) -> DataFrame:
    """``(file, log_name, log)`` per document; invoice lines only where fields exist."""

    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("None"))

    fields = col("invoice_fields")
    field_lines = F.concat_ws(
        "\n",
        F.lit("--- Invoice fields ---"),
        *[F.concat(F.lit(f"  {n:<16}: "), shown(fields[n])) for n in FIELD_NAMES[:-1]],
    )
    log = F.concat_ws(
        "\n",
        F.lit("=== OCR DEBUG ==="),
        F.concat(F.lit("File      : "), shown(col("file"))),
        F.concat(F.lit("Engine    : "), shown(col("ocr_engine"))),
        F.concat(F.lit("Words     : "), shown(col("word_count"))),
        F.concat(F.lit("Label     : "), shown(col("label"))),
        F.when(fields.isNotNull(), field_lines),
        F.lit("================="),
        F.lit(""),
        col("raw_text"),
    )
    safe = F.regexp_replace(col("file"), r"(?U)[^\w\-.]", "_")
    moment = F.date_format(F.current_timestamp() if stamp is None else stamp, "yyyyMMdd_HHmmss")
    return results.select(
        "file", F.concat(moment, F.lit("_"), safe, F.lit(".txt")).alias("log_name"), log.alias("log")
    )


def share_text(value: Column, width: int = 0) -> Column:
    """Percent with one decimal, exact ties to the even digit, padded on the left to ``width``."""
    shown = F.concat(F.call_function("format_number", value * 100, F.lit("0.0")), F.lit("%"))
    return F.lpad(shown, F.greatest(F.lit(width), F.length(shown)), F.lit(" ")) if width else shown


def result_card(results: DataFrame) -> DataFrame:
    """``(file, card)``: the console view of a result."""
    rule = "=" * 56
    bars = F.array_join(
        F.transform(
            "all_scores",
            lambda s: F.concat(
                F.lit("    "),
                F.rpad(s["label"], F.greatest(F.lit(18), F.length(s["label"])), F.lit(" ")),
                F.lit(" "),
                share_text(s["confidence"], 5),
                F.lit("  "),
                F.repeat(F.lit("█"), F.floor(s["confidence"] * 20).cast("int")),
            ),
        ),
        "\n",
    )
    length = F.length("raw_text")
    more = F.when(
        length > fixed.CARD_CHARS,
        F.concat(
            F.lit("\n  … ["),
            F.format_number(length - fixed.CARD_CHARS, 0),
            F.lit(" more characters]"),
        ),
    )
    card = F.concat_ws(
        "\n",
        F.lit(rule),
        F.lit("  CLASSIFICATION RESULT"),
        F.lit(rule),
        F.concat(F.lit("  File         : "), col("file")),
        F.concat(
            F.lit("  Label        : "),
            col("label"),
            F.when(col("is_uncertain"), "  [UNCERTAIN]").otherwise(""),
        ),
        F.concat(F.lit("  Confidence   : "), share_text(col("confidence"))),
        F.concat(F.lit("  OCR engine   : "), col("ocr_engine")),
        F.concat(F.lit("  Words found  : "), col("word_count").cast("string")),
        F.lit("\n  All scores:"),
        bars,
        F.lit(rule),
        F.lit("\n--- RAW TEXT ---\n"),
        F.substring("raw_text", 1, fixed.CARD_CHARS),
        more,
    )
    return results.select("file", card.alias("card"))


def metrics_tiles(report: DataFrame) -> DataFrame:
    """Headline figures of a training report as text."""

    def tile(value: Column) -> Column:
        return F.when(value.isNull() | F.isnan(value), "N/A").otherwise(share_text(value))

    return report.select(
        tile(col("accuracy")).alias("test_accuracy"),
        tile(col("cv_accuracy")).alias("cv_accuracy"),
        F.coalesce(col("best_C").cast("string"), F.lit("1.0")).alias("best_C"),
    )
