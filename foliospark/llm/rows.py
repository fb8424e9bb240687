"""Rows of documents under names that no column of the input can clash with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["doc_key", "text_key"]
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all columns as one struct) and its identity: hashes of the id and of the text.

    Neither key is ever null, so rows without id or text can be joined.  Rows that repeat both id and
    text share their keys and get the same decision.  The hash of a 64-bit id is a bijection.
    """
    return docs.select(
        F.xxhash64(F.col(id_col)).alias("doc_key"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
    )


def unpacked(schema: T.StructType, replaced: dict[str, Column] | None = None) -> list[Column]:
    """The columns inside ``row`` again, some of them with another value."""
    replaced = replaced or {}
    return [
        replaced.get(field.name, F.col("row").getField(field.name)).alias(field.name) for field in schema
    ]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def settled(rows: DataFrame, hashes: list[str], least: int) -> DataFrame:
    """Rows whose hash counts ``least`` or more in all.

    Rows arrive counted within a chunk.  Those a chunk could decide (``decided``) are dealt out by
    document; of the others and of the chunk's own total (no ``doc_key``) a hash has at most ``least``
    for each chunk, whatever the share of the rows that holds it, so a frequent hash makes no hot task.
    ``n`` adds up to the total of a hash over all chunks.
    """
    from pyspark.sql import Window

    salt = F.when(F.col("decided"), F.col("doc_key")).otherwise(F.lit(0))
    total = F.sum("n").over(Window.partitionBy(*hashes, "salt"))
    return (
        rows.withColumn("salt", salt)
        .withColumn("total", total)
        .where(F.col("doc_key").isNotNull() & (F.col("decided") | (F.col("total") >= least)))
    )
