"""Exact duplicates by sorting whole texts, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.rows import ascii_lower

PREFIX = 64


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", slices: int | None = None
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row.

    Texts are equal when they are the same bytes after A-Z is lower-cased; null counts as empty.  Of equal
    texts the row with the ``largest`` (or ``smallest``) id stays; a row without id stays only if no row
    of its group has one, and of rows that repeat the id as well, one stays.

    Sampled splitters deal the normalised texts out by range and each partition is sorted, so equal texts
    become neighbours and whole texts are compared.  A splitter has the first ``PREFIX`` characters of a text, so the
    driver never holds whole texts; texts that begin alike are sorted by the rest of them.  The splitters also cut between ``slices`` of the ids,
    as many as there are shuffle partitions if not given: a text with a third of all rows is spread over a third of
    the partitions.  Each slice brings one row to the total of its text, joined by the text's digest.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    largest = keep == "largest"
    slices = slices or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pick = F.max if largest else F.min
    order = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    run = Window.partitionBy("prefix", "norm", "slice")
    ranked = (
        docs.select(
            F.col(id_col).alias("id"),
            ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"),
            F.pmod(F.xxhash64(F.col(id_col)), F.lit(slices)).alias("slice"),
        )
        .withColumn("prefix", F.substring("norm", 1, PREFIX))
        .repartitionByRange("prefix", "slice")
        .select(
            "id",
            F.row_number().over(run.orderBy(order)).alias("place"),
            F.first("id").over(run.orderBy(order)).alias("run_keep"),
            F.count(F.lit(1)).over(run.orderBy(order).rowsBetween(*_ALL)).alias("run_size"),
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        )
    )
    totals = (
        ranked.where("place = 1")
        .groupBy("text_sha256")
        .agg(pick("run_keep").alias("keep_id"), F.sum("run_size").alias("group_size"))
    )
    return ranked.join(totals, "text_sha256").select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        ((F.col("place") == 1) & F.col("run_keep").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
