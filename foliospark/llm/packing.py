"""Documents packed into token-budget batches of optimal length buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import materialise

BUCKETS = 16
BUDGET = 16_384
EXACT_LENGTH = 1 << 16
FINE = 12
SLICE_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Words of a whole text, null as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def grid(length: Column) -> Column:
    """The length itself up to ``EXACT_LENGTH``; beyond, the next point of a grid with 2**12 points per
    octave.  So the histogram has at most 2**16 bins and 2**12 per further octave, whatever the table."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(length)) - FINE)
    return F.when(length <= EXACT_LENGTH, length).otherwise((F.ceil(length / step) * step).cast("long"))


def best_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets that minimise all padding.

    ``histogram`` has (length, documents) in rising order.  With ``cost[j]`` the least padded tokens of the
    first ``j`` lengths, ``cost_k[j] = min over i < j of cost_(k-1)[i] + length[j] * (docs[j] - docs[i])``: for
    fixed ``i`` a line in the length, with falling slopes, so the least line is found along a hull.
    """
    lengths = [n for n, _ in histogram]
    docs = [0]
    for _, n in histogram:
        docs.append(docs[-1] + n)
    if not lengths:
        return []
    cost = [0] + [length * n for length, n in zip(lengths, docs[1:])]
    choices = []
    for k in range(1, min(buckets, len(lengths))):
        hull: list[int] = []
        head, now, choice = 0, cost[:], [0] * len(cost)
        for j in range(1, len(cost)):
            i = j - 1
            if i >= k:  # at least k lengths for k buckets
                while len(hull) - head >= 2:
                    a, b = hull[-2], hull[-1]
                    # b is never least: the lines of a and i meet before b goes below a
                    if (cost[i] - cost[a]) * (docs[b] - docs[a]) <= (cost[b] - cost[a]) * (docs[i] - docs[a]):
                        hull.pop()
                    else:
                        break
                hull.append(i)
            x = lengths[j - 1]
            while len(hull) - head >= 2 and (
                cost[hull[head + 1]] - docs[hull[head + 1]] * x <= cost[hull[head]] - docs[hull[head]] * x
            ):
                head += 1
            if len(hull) > head:
                i = hull[head]
                now[j], choice[j] = cost[i] + x * (docs[j] - docs[i]), i
        choices.append(choice)
        cost = now
    found, j = [], len(lengths)
    for choice in reversed([[0] * (len(lengths) + 1), *choices]):
        if j > 0:
            found.append(lengths[j - 1])
            j = choice[j]
    return found[::-1]


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``doc_id, n_tokens, bucket, bucket_len, batch, slot, padding``, one row per input row.

    ``length`` is a token count, words if not given; null counts as 0.  Every document of a bucket is padded to
    ``bucket_len``; a batch holds ``budget // bucket_len`` documents of one bucket, one if that is less than one.
    Documents keep the order of a hash of their id, so the same rows always make the same batches (rows
    that repeat id and text change places only with each other).

    Rows are numbered within slices of about ``slice_rows`` rows, and slices are put one after the other by
    their counts: a bucket with most of the rows is no single task.
    """
    count = word_count(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0))
    lengths = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(id_col).alias("doc_key"),
            F.xxhash64(text_col).alias("text_key"),
            count.cast("long").alias("n_tokens"),
        ),
        "lengths",
    )
    bins = lengths.groupBy(grid(F.col("n_tokens")).alias("length")).count().orderBy("length").collect()
    bounds = best_boundaries([tuple(row) for row in bins], buckets)
    slices = max(1, -(-sum(row[1] for row in bins) // slice_rows))
    bucket = F.size(F.filter(F.lit(bounds or [0]).cast("array<long>"), lambda b: b < F.col("n_tokens")))
    placed = lengths.withColumn("bucket", bucket).withColumn("slice", F.pmod("doc_key", F.lit(slices)))
    counts = placed.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("bucket", "slice").orderBy("doc_key", "text_key", "n_tokens")
    place = F.col("before") + F.row_number().over(order) - 1
    bucket_len = F.get(F.lit(bounds or [0]).cast("array<long>"), F.col("bucket"))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_len"))))
    return (
        placed.join(counts, ["bucket", "slice"])
        .withColumn("place", place)
        .withColumn("bucket_len", bucket_len)
        .select(
            "doc_id",
            "n_tokens",
            "bucket",
            "bucket_len",
            F.floor(F.col("place") / capacity).alias("batch"),
            (F.col("place") % capacity).cast("int").alias("slot"),
            (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        )
    )
