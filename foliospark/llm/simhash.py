"""Near duplicates by SimHash: fingerprints, a binary trie joined with itself, connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.components import components
from foliospark.llm.rows import KEYS, keyed, unpacked
from foliospark.session import materialise

WIDTH = 3
BUDGET = 3
SEED = 42
BLOCK = 1 << 14
FRONTIER = 1 << 16
STEP = 1 << 16
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, a bounded number at a time; fewer words make one shingle."""
    digest = xxhash.xxh64_intdigest
    for at in range(0, max(len(words) - width + 1, 1 if words else 0), STEP):
        part = words[at : at + STEP + width - 1]
        if len(part) >= width:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(width))))
        else:
            shingles = [b" ".join(part)]
        yield np.array([digest(s, SEED) for s in shingles], np.uint64)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Bit k is set if bit k of more than half the shingle hashes is; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text.lower().split(), width):
        parts = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(parts[:, k], minlength=256) @ BITS_OF_BYTE
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, width: int = WIDTH) -> Column:
    """The fingerprint of a whole text as a (signed) long.

    Only A-Z is lower-cased; words are runs other than 0x20 and 0x09-0x0D, which is how ``bytes`` split.
    """

    @F.arrow_udf(returnType=T.LongType())
    def prints(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t.as_py() or b"", width) for t in texts], np.uint64)
        return pa.array(found.view(np.int64))

    return prints(F.coalesce(text, F.lit("")).cast("binary"))


class Trie:
    """A sorted array as a binary trie: a node is a range of it that shares the first bits."""

    def __init__(self, values: np.ndarray):
        self.values, self.ones = values, {}

    def middle(self, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
        """Where the right child begins."""
        if level not in self.ones:
            count = np.zeros(len(self.values) + 1, np.int32)
            np.cumsum((self.values >> np.uint64(63 - level)) & np.uint64(1), out=count[1:])
            self.ones[level] = count
        ones = self.ones[level]
        return high - (ones[high] - ones[low])


def near_pairs(left: np.ndarray, right: np.ndarray, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of the pairs of two sorted arrays that differ in at most ``budget`` bits.

    Pairs of nodes go down together; a pair whose prefixes differ in more bits than the budget is pruned.
    No more than a bounded number of node pairs is open at once: a larger front is worked off in parts.
    With ``same`` the arrays are one array and each pair is told once.
    """
    a, b = Trie(left), Trie(right)
    first = np.array([[0, len(left), 0, len(right), 0]], np.int32).T
    open_fronts = [(0, first)]
    while open_fronts:
        level, front = open_fronts.pop()
        sizes = (front[1] - front[0]).astype(np.int64) * (front[3] - front[2])
        small = (sizes <= 8) | (level == 64)
        if small.any():
            low, high, other, end, _ = front[:, small]
            pairs = np.repeat(np.arange(len(low)), sizes[small])
            place = np.arange(len(pairs)) - np.repeat(np.cumsum(sizes[small]) - sizes[small], sizes[small])
            width = (end - other)[pairs]
            i, j = low[pairs] + place // width, other[pairs] + place % width
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            if same:
                near &= i < j
            yield i[near], j[near]
            front = front[:, ~small]
        if not front.shape[1]:
            continue
        low, high, other, end, differ = front
        low_mid, other_mid = a.middle(low, high, level), b.middle(other, end, level)
        twin = (low == other) & (high == end) if same else np.zeros(len(low), bool)
        children = np.concatenate(
            [
                [low, low_mid, other, other_mid, differ],
                [low_mid, high, other_mid, end, differ],
                [low, low_mid, other_mid, end, differ + 1],
                np.array([low_mid, high, other, other_mid, differ + 1])[:, ~twin],
            ],
            axis=1,
        )
        alive = (children[0] < children[1]) & (children[2] < children[3]) & (children[4] <= budget)
        children = children[:, alive]
        for at in range(0, children.shape[1], FRONTIER):
            open_fronts.append((level + 1, children[:, at : at + FRONTIER]))


def forest(left: np.ndarray, right: np.ndarray, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smallest value of its group) that connect what the near pairs connect.

    At most one edge per value: a group of n values within the budget makes n - 1 edges, not n * n.
    """
    values = left if same else np.concatenate([left, right])
    shift = 0 if same else len(left)
    label = np.arange(len(values))
    for i, j in near_pairs(left, right, budget, same):
        j = j + shift
        while len(i):
            while (label[label] != label).any():
                label = label[label]
            x, y = label[i], label[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
    while (label[label] != label).any():
        label = label[label]
    least = np.full(len(values), np.iinfo(np.int64).max)
    signed = values.view(np.int64)
    np.minimum.at(least, label, signed)
    root = least[label]
    moved = np.flatnonzero(root != signed)
    return signed[moved], root[moved]


def packed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``prefix, print`` sorted by both become rows of up to ``BLOCK`` values of one prefix."""
    for batch in batches:
        prefix = batch.column(0).to_numpy()
        values = batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])) if len(prefix) else prefix
        parts = [
            (prefix[low], values[at : min(at + BLOCK, high)].tobytes())
            for low, high in zip(cuts, np.append(cuts[1:], len(prefix)))
            for at in range(low, high, BLOCK)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.binary())],
            ["prefix", "block"],
        )


def linked(prints: DataFrame, n: int, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """Edges ``u, v`` (u > v) between distinct ``print`` values that connect all within the budget.

    The trie is cut at the depth where a subtree has about ``block`` of the ``n`` values.  Each subtree is
    sent, as packed values, to every subtree whose prefix is within the budget, and each such pair
    is traversed in one task: the pairs above the cut are the masks of at most ``budget`` bits.
    """
    depth = max(0, math.ceil(math.log2(max(n, 1) / block)))
    masks = [
        sum(1 << bit for bit in bits) for size in range(min(budget, depth) + 1) for bits in combinations(range(depth), size)
    ]
    prefix = F.shiftrightunsigned("print", 64 - depth) if depth else F.lit(0).cast("long")
    blocks = (
        prints.select(prefix.alias("prefix"), "print")
        .repartition("prefix")
        .sortWithinPartitions("prefix", "print")
        .mapInArrow(packed_blocks, "prefix long, block binary")
    )
    other = F.col("prefix").bitwiseXOR(F.col("mask"))
    sent = blocks.withColumn("mask", F.explode(F.lit(masks).cast("array<long>"))).select(
        F.least("prefix", other).alias("low"), F.greatest("prefix", other).alias("high"), "prefix", "block"
    )

    def traverse(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        sides = {}
        for p, values in zip(table.column("prefix").to_pylist(), table.column("block").to_pylist()):
            sides.setdefault(p, []).append(np.frombuffer(values, np.uint64))
        sides = {p: np.sort(np.concatenate(parts)) for p, parts in sides.items()}
        if len(sides) == 2 or low == high:
            u, v = forest(sides[low], sides[high], budget, low == high)
        else:
            u = v = np.empty(0, np.int64)
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    return sent.groupBy("low", "high").applyInArrow(traverse, "u long, v long").distinct()


def named(prints: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``prints`` with ``root`` and ``component_id`` of what ``edges`` connect."""
    member = components(edges).withColumnsRenamed({"node": "print"})
    least = member.join(distinct, "print").groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = distinct.join(member.join(least, "root"), "print", "left").select(
        "print",
        F.coalesce("root", "print").alias("root"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"),
    )
    return prints.join(named, "print").select("doc_id", *KEYS, "print", "root", "component_id")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, budget: int = BUDGET
) -> DataFrame:
    """``doc_id, doc_key, text_key, print, root, component_id``, one row per input row.

    Fingerprints of whole texts link at ``budget`` or fewer differing bits; ``root`` is one fingerprint of each
    component and ``component_id`` the smallest id in it.  Texts without words (null too) have
    fingerprint 0 and link like any other.  Rows without id take part; ``component_id`` is null if no row of
    the component has one.  Equal fingerprints are joined once, whatever the number of copies.
    """
    rows = keyed(docs.select(id_col, text_col), id_col, text_col)
    text = F.col("row").getField(text_col)
    prints = materialise(
        rows.select(F.col("row").getField(id_col).alias("doc_id"), *KEYS, fingerprint_column(text, width).alias("print")),
        "prints",
    )
    distinct = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    edges = materialise(linked(distinct, distinct.count(), budget), "print-links")
    return named(prints, distinct, edges)


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grouping: Callable[..., DataFrame] = near_groups, **how
) -> DataFrame:
    """The rows, with their columns, of one document per component: the one with the smallest id.

    A row without id stays only if no row of its component has one.  Of rows that repeat the id, or have none,
    the one with the smallest hash of its text stays, and of rows that repeat the text as well, one.
    """
    groups = grouping(docs, id_col, text_col, **how)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *KEYS)
    chosen = groups.groupBy("root").agg(F.min(order).alias("best")).select(*[f"best.{k}" for k in KEYS])
    copies = Window.partitionBy(*KEYS).orderBy(*KEYS)
    kept = keyed(docs, id_col, text_col).join(chosen, KEYS).withColumn("copy", F.row_number().over(copies))
    return kept.where("copy = 1").select(*unpacked(docs.schema))
