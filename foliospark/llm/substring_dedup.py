"""Passages of at least ``width`` words that occur more than once, found by rolling hashes.

A window is ``width`` consecutive words of one text; its Karp-Rabin hash costs the same whatever the
width.  Windows with one content have one *anchor*: the leftmost of their word runs of ``ANCHOR`` words
with the smallest hash.  A window can only be repeated if its anchor is, and a text has about one anchor per
14 words.  So anchors are counted first, and only windows on repeated anchors, which are all that can
be repeated, are counted in full.  Of texts that are copies as a whole one sends its windows, as seen twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.rows import KEYS, keyed, settled
from foliospark.llm.words import WORD_BASE, Rolling, Words, pieces

WIDTH = 35
ANCHOR = 8
FIRST, COPY = 1, 2
TAG_BITS = 16
SCHEMA = "hash long, tag int, doc_key long, text_key long, begin int, end int, n int, decided boolean"


class Windows:
    """Windows of some texts that lie within one text: where they start and where their anchors do."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        self.words = Words(data, offsets)
        self.of = self.words.texts()
        rolling = Rolling(self.words.hashes(), WORD_BASE)
        run = min(ANCHOR, width)
        self.runs, hashes = rolling.windows(run), rolling.windows(width)
        inside = np.arange(len(hashes)) + width <= self.words.first[1:][self.of[: len(hashes)]]
        self.starts = np.flatnonzero(inside)
        self.hashes = hashes[self.starts]
        self.anchors = leftmost_least(self.runs, width - run + 1)[self.starts]

    def place(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and position in the text."""
        of = self.of[words]
        return of, (words - self.words.first[of]).astype(np.int32)


def leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """For every ``span`` neighbours the index of the leftmost smallest one."""
    place, width = np.arange(len(values)), 1
    while width < span and len(values):
        step = min(width, span - width)
        n = max(len(values) - step, 0)
        right = values[step:] < values[:n]
        place = np.where(right, place[step:], place[:n])
        values = np.where(right, values[step:], values[:n])
        width += step
    return place


NAMES = ["hash", "tag", "doc_key", "text_key", "begin", "end", "n", "decided"]


def counted(
    hashes: np.ndarray,
    tags: np.ndarray,
    keys: list[np.ndarray],
    of: np.ndarray,
    word: np.ndarray,
    width: int,
    known: np.ndarray | None = None,
) -> pa.RecordBatch:
    """Rows of the windows of one piece, in text order.

    What repeats within the piece, or is ``known`` to, is decided: neighbouring decided windows become one
    interval without a hash, and one row without a document says that the hash has been seen twice.
    """
    order = np.lexsort((tags, hashes))
    a, b = hashes[order], tags[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    times = np.bincount(group, None if known is None else 1.0 + known[order], minlength=1)
    repeated = times[group] > 1
    twice = order[new & repeated]
    decided = np.zeros(len(a), bool)
    decided[order] = repeated
    alone = np.flatnonzero(~decided)
    sure = np.flatnonzero(decided)
    apart = np.ones(len(sure), bool)
    apart[1:] = (of[sure[1:]] != of[sure[:-1]]) | (word[sure[1:]] > word[sure[:-1]] + width)
    first = np.flatnonzero(apart)
    last = np.append(first[1:], len(sure))[: len(first)] - 1
    rows = np.concatenate([alone, sure[first], twice])
    end = word[np.concatenate([alone, sure[last], twice])] + width
    kind = np.repeat([1, 0, 2], [len(alone), len(first), len(twice)]).astype(np.int32)
    hashed = kind > 0
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(hashed, hashes[rows].view(np.int64), 0)),
            pa.array(np.where(hashed, tags[rows], 0).astype(np.int32)),
            pa.array(keys[0][of[rows]], mask=kind == 2),
            pa.array(np.where(kind == 2, 0, keys[1][of[rows]])),
            pa.array(np.where(kind == 2, 0, word[rows]).astype(np.int32)),
            pa.array(np.where(kind == 2, 0, end).astype(np.int32)),
            pa.array(kind),
            pa.array(kind == 0),
        ],
        NAMES,
    )


def whole(keys: list[np.ndarray], sizes: np.ndarray) -> pa.RecordBatch:
    """Decided intervals that are entire texts."""
    none = np.zeros(len(sizes), np.int32)
    columns = [none.astype(np.int64), none, *keys, none, sizes.astype(np.int32), none, none == 0]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], NAMES)


def anchor_rows(width: int):
    """``doc_key, text_key, text`` to a row per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in (0, 1)]
            for low, high, data, offsets in pieces(batch.column(2)):
                found = Windows(data, offsets, width)
                anchors = np.unique(found.anchors)
                of, word = found.place(anchors)
                hashes = found.runs[anchors]
                yield counted(hashes, np.zeros(len(hashes), np.int32), [k[low:high] for k in keys], of, word, 0)

    return run


def window_rows(width: int, text_col: str):
    """``doc_key, text_key, row, anchors, role`` (``anchors`` are positions) to a row per window on one of the anchors.

    Of copies, the ``FIRST`` sends all its windows and a ``COPY`` none; both are decided as a whole.
    ``tag`` has some bits of the anchor's hash: equal windows have equal anchors, so it makes the hash longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in (0, 1)]
            roles = batch.column(4).to_numpy()
            for low, high, data, offsets in pieces(batch.column(2).field(text_col)):
                found = Windows(data, offsets, width)
                lists = batch.column(3).slice(low, high - low)
                at = lists.flatten().to_numpy() + np.repeat(found.words.first[:-1], np.diff(lists.offsets.to_numpy()))
                marked = np.zeros(len(found.words) + 1, bool)
                marked[at] = True
                role = roles[low:high]
                sizes = np.diff(found.words.first)
                copies = np.flatnonzero((role == COPY) & (sizes >= width))
                yield whole([k[low:high][copies] for k in keys], sizes[copies])
                window_role = role[found.of[found.starts]]
                chosen = np.flatnonzero((window_role == FIRST) | marked[found.anchors] & (window_role == 0))
                of, word = found.place(found.starts[chosen])
                tags = (found.runs[found.anchors[chosen]] >> np.uint64(64 - TAG_BITS)).astype(np.int32)
                yield counted(found.hashes[chosen], tags, [k[low:high] for k in keys], of, word, width, role[of] == FIRST)

    return run


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals sorted by document and begin to maximal intervals ``begin, end`` of words."""
    held = [np.empty(0, np.int64)] * 4

    def out(columns):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(c).cast(kind) for c, kind in zip(columns, kinds)], [*KEYS, "begin", "end"]
        )

    for batch in batches:
        rows = [batch.column(k).cast(pa.int64()).to_numpy() for k in range(4)]
        doc, text, begin, end = (np.concatenate(pair) for pair in zip(held, rows))
        if not len(doc):
            continue
        other = np.ones(len(doc), bool)
        other[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
        # The furthest end so far within a document: ends are moved up by document, then back.
        lift = (np.cumsum(other) - 1) * (1 << 33)
        reach = np.maximum.accumulate(end + lift) - lift
        new = other.copy()
        new[1:] |= begin[1:] > reach[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        found = [doc[first], text[first], begin[first], reach[last]]
        held = [c[-1:] for c in found]
        yield out([c[:-1] for c in found])
    yield out(held)


def repeated_intervals(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH
) -> DataFrame:
    """``doc_key, text_key, begins, ends``: maximal intervals of words of repeated windows, per document.

    A window is repeated if its words start anywhere else, in the same document too.  Rows that
    repeat id and text are two documents: each repeats the other.  Null text has no words.
    """
    rows = keyed(docs.select(id_col, text_col), id_col, text_col)
    text = F.col("row").getField(text_col).alias("text")
    same = ["text_key", "text_hash"]
    hashed = rows.select(*KEYS, F.xxhash64(F.lit(7), text).alias("text_hash"))
    copies = hashed.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("doc_key").alias("first")).where("n > 1")
    role = F.when(F.col("doc_key") == F.col("first"), FIRST).otherwise(COPY)
    roles = hashed.join(copies, same).select(*KEYS, F.lit(None).cast("int").alias("begin"), role.alias("role"))
    anchors = rows.select(*KEYS, text).mapInArrow(anchor_rows(width), SCHEMA)
    found = settled(anchors, ["hash", "tag"], 2).select(*KEYS, "begin", F.lit(0).alias("role"))
    hits = found.union(roles).groupBy(*KEYS).agg(F.collect_set("begin").alias("anchors"), F.max("role").alias("role"))
    spread = rows.repartition(*KEYS).join(hits.hint("shuffle_hash"), KEYS)
    # The whole row goes along so that the shuffle of the texts is the one without_repeats() uses again.
    windows = spread.select(*KEYS, "row", "anchors", "role").mapInArrow(window_rows(width, text_col), SCHEMA)
    return (
        settled(windows, ["hash", "tag"], 2)
        .select(*KEYS, "begin", "end")
        .repartition(*KEYS)
        .sortWithinPartitions(*KEYS, "begin")
        .mapInArrow(merged, "doc_key long, text_key long, begin int, end int")
        .groupBy(*KEYS)
        .agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    )


@F.arrow_udf(
    returnType=T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
)
def without_intervals(text: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
    """Words outside the intervals, joined by one blank."""
    counts, removed, kept = [], [], []
    for t, b, e in zip(text.cast(pa.binary()).to_pylist(), begins.to_pylist(), ends.to_pylist()):
        words = t.split()
        counts.append(len(words))
        if b:
            for low, high in sorted(zip(b, e), reverse=True):
                del words[low:high]
        removed.append(counts[-1] - len(words))
        kept.append(b" ".join(words))
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
        ["n_words", "n_removed", "kept"],
    )


def without_repeats(
    docs: DataFrame, intervals: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``row, n_words, n_removed, kept``: documents without the words of their intervals."""
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    joined = keyed(docs, id_col, text_col).repartition(*KEYS).join(intervals.hint("shuffle_hash"), KEYS, "left")
    done = without_intervals(text, F.col("begins"), F.col("ends"))
    return joined.select("row", done.alias("done")).select("row", "done.n_words", "done.n_removed", "done.kept")
