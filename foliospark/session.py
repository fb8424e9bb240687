"""Session settings and the scratch folder shared by the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "foliospark") -> SparkSession:
    """A session for tests and benchmarks.  On a cluster the job's own session is used instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        # Small test tables: keep all cores busy instead of merging partitions up to 1 MB.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="foliospark-")
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared scratch folder."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str, even: bool = False) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Used where one frame feeds many jobs (every fit of a model search).  Rebalancing first gives files of
    even size, whatever the skew of the rows before.  A lost executor then costs a
    re-read of the table instead of the recomputation of everything before it.  ``even``: the rows of ``df``
    are rebalanced already.
    """
    path = scratch_path(df.sparkSession, name)
    (df if even else df.hint("rebalance")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def materialised(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``materialise``, with the table removed at the end of the block, also after an error.

    Nothing that reads the table may be left unread behind the block.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    try:
        df.hint("rebalance").write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
