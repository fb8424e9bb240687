"""Near duplicates by Jaccard similarity of word shingles: MinHash bands propose, exact set overlap decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.components import components
from foliospark.llm.rows import KEYS, keyed
from foliospark.llm.simhash import named, shingle_hashes
from foliospark.session import materialise

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 40, 6
SEED = 42
PART = 1 << 12
GROWTH = 64

_RANDOM = np.random.default_rng(SEED)
FLIPS, FACTORS = _RANDOM.integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
FACTORS |= np.uint64(1)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text; empty without words."""
    parts = [np.unique(hashes) for hashes in shingle_hashes(text.lower().split(), width)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def band_hashes(shingles: np.ndarray) -> list[int]:
    """One (signed) hash per band of ``ROWS`` minima; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), PART):
        np.minimum(least, ((shingles[None, at : at + PART] ^ FLIPS) * FACTORS).min(axis=1), out=least)
    bands = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64).tolist()


def signature(text: Column, width: int = WIDTH) -> Column:
    """``print`` (hash of the shingle set), ``size`` of the set, ``bands``."""

    @F.arrow_udf(returnType="print long, size int, bands array<long>")
    def signatures(texts: pa.Array) -> pa.Array:
        prints, sizes, bands = [], [], []
        for t in texts:
            shingles = shingle_set(t.as_py() or b"", width)
            prints.append(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), SEED))
            sizes.append(len(shingles))
            bands.append(band_hashes(shingles))
        columns = [
            pa.array(np.array(prints, np.uint64).view(np.int64)),
            pa.array(sizes, pa.int32()),
            pa.array(bands, pa.list_(pa.int64())),
        ]
        return pa.StructArray.from_arrays(columns, ["print", "size", "bands"])

    return signatures(F.coalesce(text, F.lit("")).cast("binary"))


def packed_set(text: Column, width: int = WIDTH) -> Column:
    @F.arrow_udf(returnType="binary")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py() or b"", width).tobytes() for t in texts], pa.binary())

    return sets(F.coalesce(text, F.lit("")).cast("binary"))


def similar(a: Column, b: Column, least: float = LEAST) -> Column:
    """Whether two packed sets have a Jaccard similarity of ``least`` or more."""

    @F.arrow_udf(returnType="boolean")
    def decided(left: pa.Array, right: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(left, right):
            x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            found.append(common >= least * (len(x) + len(y) - common))
        return pa.array(found, pa.bool_())

    return decided(a, b)


def linked(shared: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Edges ``u, v`` (u > v) that connect all similar pairs which share a bucket: each print and its smallest one.

    ``shared``: ``bucket, print, size``; ``sets``: ``print, packed``.  In each round the first prints of a bucket
    (one, then ``GROWTH`` times as many in each further round) are held against all others of it, and then leave it.
    A bucket whose prints are all connected is done, so n near copies take about n pairs, not n * n.
    """
    pivots, stars = 1, sets.sparkSession.createDataFrame([], "u long, v long")
    left, right = (sets.withColumnsRenamed({"print": p, "packed": f"set_{p}"}) for p in "uv")
    still = shared.withColumn("root", F.col("print"))
    while True:
        placed = still.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("print")))
        pivot = placed.where(F.col("place") <= pivots).select(
            "bucket", *[F.col(c).alias(f"pivot_{c}") for c in ("print", "size", "root", "place")]
        )
        larger, smaller = F.greatest("size", "pivot_size"), F.least("size", "pivot_size")
        pairs = (
            placed.join(pivot, "bucket")
            .where((F.col("place") > F.col("pivot_place")) & (F.col("root") != F.col("pivot_root")))
            .where(smaller >= least * larger)
            .select(F.col("print").alias("u"), F.col("pivot_print").alias("v"))
            .distinct()
        )
        tried = pairs.join(left, "u").join(right, "v").withColumn("near", similar(F.col("set_u"), F.col("set_v"), least))
        found = materialise(tried.where("near").select("u", "v"), "near-links")
        if not found.isEmpty():
            member = components(stars.union(found)).where("node > root")
            stars = member.select(F.col("node").alias("u"), F.col("root").alias("v"))
        moved = stars.withColumnsRenamed({"u": "print", "v": "new_root"})
        several = Window.partitionBy("bucket")
        rest = (
            placed.where(F.col("place") > pivots)
            .join(moved, "print", "left")
            .select("bucket", "print", "size", F.coalesce("new_root", "print").alias("root"))
            .withColumn("first", F.min("root").over(several))
            .withColumn("last", F.max("root").over(several))
            .where("first < last")
        )
        still = materialise(rest.select("bucket", "print", "size", "root"), "open-buckets")
        if still.isEmpty():
            return stars
        pivots *= GROWTH


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST
) -> DataFrame:
    """``doc_id, doc_key, text_key, print, root, component_id``, one row per input row, as ``simhash.near_groups``.

    Whole texts link if the Jaccard similarity of their sets of ``width`` words in a row (A-Z lower-cased; fewer
    words are one shingle) is ``least`` or more.  Texts without words (null too) have equal, empty sets and link.
    Only pairs that share one of ``BANDS`` bands are held against each other: at 0.8 five in a million pairs
    share none, at 0.85 fewer than one in ten million.  Equal sets are held once, whatever the number of copies.
    """
    rows = keyed(docs.select(id_col, text_col), id_col, text_col)
    text = F.col("row").getField(text_col)
    signed = rows.select(F.col("row").getField(id_col).alias("doc_id"), *KEYS, signature(text, width).alias("signed"))
    prints = materialise(signed.select("doc_id", *KEYS, "signed.*"), "signatures")
    distinct = materialise(
        prints.groupBy("print").agg(
            F.min("doc_id").alias("first_id"),
            F.min(F.struct(*KEYS)).alias("keys"),
            F.first("size").alias("size"),
            F.first("bands").alias("bands"),
        ),
        "distinct-prints",
    )
    dealt = distinct.select(F.explode("bands").alias("bucket"), "print", "size")
    counted = dealt.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket")))
    shared = materialise(counted.where("n > 1").select("bucket", "print", "size"), "shared-buckets")
    wanted = distinct.join(shared.select("print").distinct(), "print", "left_semi").select("print", "keys.*")
    copies = Window.partitionBy(*KEYS).orderBy(*KEYS)
    one = rows.join(wanted, KEYS).withColumn("copy", F.row_number().over(copies)).where("copy = 1")
    sets = materialise(one.select("print", packed_set(text, width).alias("packed")), "shingle-sets")
    edges = linked(shared, sets, least)
    return named(prints.select("doc_id", *KEYS, "print"), distinct, edges)
