"""Reading a labelled folder tree and choosing files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions.base import col
from foliospark.functions.text import suffix
from foliospark.operators.small import broadcast_if_small
from foliospark.sources.cache import is_missing


def filter_supported(
    files: DataFrame, path: str = "path", suffixes: list[str] | None = None
) -> DataFrame:
    """Files whose lower-cased suffix is on the list."""
    return files.where(suffix(path).isin(fixed.SUPPORTED_SUFFIXES if suffixes is None else suffixes))


def filter_size(files: DataFrame, max_bytes: int = fixed.MAX_UPLOAD_BYTES, length: str = "length") -> DataFrame:
    return files.where(F.col(length) <= max_bytes)


def route(path: Column | str) -> Column:
    """"pdf", "image" or "unsupported"."""
    ending = suffix(col(path))
    return (
        F.when(ending == fixed.PDF_SUFFIX, "pdf")
        .when(ending.isin(fixed.IMAGE_SUFFIXES), "image")
        .otherwise("unsupported")
    )


def with_label(
    files: DataFrame, label_map: dict[str, str] | None = None, path: str = "path"
) -> DataFrame:
    """Add ``label`` from the folder a file lies in; files of other folders are dropped."""
    mapping = fixed.CATEGORY_FOLDERS if label_map is None else label_map
    pairs = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    folder = F.regexp_extract(F.col(path), r"([^/]+)/[^/]+$", 1)
    return files.withColumn("label", F.try_element_at(pairs, folder)).where(
        F.col("label").isNotNull()
    )


def scan_corpus(
    spark: SparkSession,
    root: str,
    label_map: dict[str, str] | None = None,
    suffixes: list[str] | None = None,
) -> DataFrame:
    """``(path, modificationTime, length, content, label)`` for the supported files of all category
    folders below ``root``.  Missing and empty folders give no rows.

    Only the category folders are listed, and ``content`` is not read by a query that leaves it out.
    """
    mapping = fixed.CATEGORY_FOLDERS if label_map is None else label_map
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = None
    for folder in mapping:
        try:
            part = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{folder}")
        except AnalysisException as error:
            if not is_missing(error):
                raise
            continue
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return with_label(filter_supported(found, "path", suffixes), mapping)


def split_summary(
    lists: DataFrame, images: DataFrame, splits: list[str] | None = None
) -> DataFrame:
    """Per split name: entries of its list file ``(split, line)`` and whether there is one, and the
    number of ``.tif`` images."""
    names = fixed.SPLIT_NAMES if splits is None else splits
    expected = lists.sparkSession.createDataFrame([(n,) for n in names], "split string")
    written = lists.where(F.trim("line") != "").groupBy("split").agg(
        F.count(F.lit(1)).alias("entries")
    )
    tif = images.where(F.endswith(F.col("path"), F.lit(".tif"))).agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        expected.join(broadcast_if_small(written.where(F.col("split").isin(names))), "split", "left")
        .withColumn("images", tif)
        .select(
            "split",
            F.coalesce("entries", F.lit(0)).alias("entries"),
            F.col("entries").isNotNull().alias("present"),
            "images",
        )
    )
