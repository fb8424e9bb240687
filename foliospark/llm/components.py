"""Connected components by alternating large and small stars, every round on a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its smallest one."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for every node that is not the smallest of its component, the smallest one; and
    for the smallest itself.

    ``edges`` has ``u > v``.  Only counts come to the driver; sums over a node are combined before they are
    shuffled, and the join back leaves a node with many edges to Spark's skew handling.  A round is a table
    in the shared folder, so that a lost executor costs the round at most.
    """
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
        edges = materialise(_small_star(_large_star(edges)), "star-edges")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())
