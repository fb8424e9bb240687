"""Amounts from word boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions.base import flags
from foliospark.functions.text import to_float


def total_spatial(
    words: DataFrame, doc: str = "doc_id", position: str = "word_idx"
) -> DataFrame:
    """``(doc, total)``: the largest of the five amounts nearest the bottom of a document.

    Of equal heights the earlier word comes first.  The rank limit is applied before the shuffle as
    well, so a document with very many words sends few rows on.
    """
    amount = to_float(F.regexp_extract("text", flags(fixed.WORD_AMOUNT), 1))
    found = words.select(doc, position, "top", amount.alias("amount")).where(F.col("amount") > 0)
    nearest = Window.partitionBy(doc).orderBy(F.desc("top"), position)
    kept = found.withColumn("_rank", F.row_number().over(nearest)).where(
        F.col("_rank") <= fixed.NEAREST_AMOUNTS
    )
    return kept.groupBy(doc).agg(F.max("amount").alias("total"))
