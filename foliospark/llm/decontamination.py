"""Benchmark items that leaked into documents, found by greedy string tiling.

Tokens are runs of letters and digits (any byte beyond ASCII counts as a letter), A-Z lower-cased.  Runs of
``min_match`` tokens that a document shares with an item are the seeds; seeds on one diagonal make matches; the
longest match that overlaps no other one is marked, again and again.  An item whose tokens are covered to
``threshold`` is a leak, in whatever order its parts stand.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.words import IS_PUNCTUATION, LOWER, WORD_BASE, Rolling, Words, pieces, text_bytes

MIN_MATCH = 5
THRESHOLD = 0.5
BLOCK_BYTES = 8 << 20
SIEVE_BITS = 20


@dataclass
class Seeds:
    """Runs of ``width`` tokens of the items: hashes in order, and the token each begins at."""

    width: int
    hashes: np.ndarray
    tokens: np.ndarray

    def __post_init__(self):
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self._low(self.hashes)] = True

    def _low(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index in ``hashes``, token of the items) of equal runs."""
        maybe = np.flatnonzero(self.sieve[self._low(hashes)])
        low = np.searchsorted(self.hashes, hashes[maybe], "left")
        size = np.searchsorted(self.hashes, hashes[maybe], "right") - low
        maybe, low, size = maybe[size > 0], low[size > 0], size[size > 0]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(maybe, size), self.tokens[np.repeat(low, size) + place]


class Index:
    """One block of benchmark items, small enough to be broadcast.

    An item of fewer than ``min_match`` tokens has one seed, itself.  An item without tokens has none.
    """

    def __init__(self, ids: pa.Array, texts: pa.Array, min_match: int):
        data, offsets = text_bytes(texts)
        words = Words(LOWER[data], offsets, IS_PUNCTUATION)
        self.ids, self.first = ids, words.first
        self.sizes, self.of = np.diff(words.first), words.texts()
        rolling = Rolling(words.hashes(), WORD_BASE)
        self.seeds = []
        widths = np.minimum(self.sizes, min_match)
        for width in np.unique(widths[widths > 0]).tolist():
            hashes = rolling.windows(width)
            start = np.arange(len(hashes))
            of = self.of[: len(hashes)]
            fits = (widths[of] == width) & (start + width <= words.first[1:][of])
            order = np.argsort(hashes[fits], kind="stable")
            self.seeds.append(Seeds(width, hashes[fits][order], start[fits][order]))

    def leaks(self, texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """Text, item and tiles (token of the text, token of the item, length) of every leak."""
        for low, high, data, offsets in pieces(texts):
            words = Words(LOWER[data], offsets, IS_PUNCTUATION)
            rolling, of = Rolling(words.hashes(), WORD_BASE), words.texts()
            for seeds in self.seeds:
                at, token = seeds.find(rolling.windows(seeds.width))
                inside = at + seeds.width <= words.first[1:][of[at]]
                at, token = at[inside], token[inside]
                text, item = of[at], self.of[token]
                order = np.lexsort((token, item, text))
                at, token, text, item = at[order], token[order], text[order], item[order]
                new = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))[: len(at)]
                begins = np.flatnonzero(new)
                if not len(begins):
                    continue
                # No tiling covers more than all seeds of the pair do.
                gap = np.append(token[1:] - token[:-1], seeds.width)
                gap[np.append(begins[1:] - 1, len(at) - 1)] = seeds.width
                reach = np.add.reduceat(np.minimum(gap, seeds.width), begins)
                need = threshold * self.sizes[item[begins]]
                ends = np.append(begins[1:], len(at))
                for b, e in zip(begins[reach >= need].tolist(), ends[reach >= need].tolist()):
                    i, d = int(item[b]), int(text[b])
                    marked = tiles(at[b:e] - words.first[d], token[b:e] - self.first[i], seeds.width)
                    if sum(t[2] for t in marked) >= threshold * self.sizes[i]:
                        yield low + d, i, marked


def tiles(text: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from all seeds of one text and one item.

    The longest match whose tokens are all free is marked, ties by position in item and text; a match that is partly taken is cut
    into its free runs and waits for its turn.
    """
    diagonal = text - item
    order = np.lexsort((text, diagonal))
    text, item, diagonal = text[order], item[order], diagonal[order]
    new = np.append(True, (diagonal[1:] != diagonal[:-1]) | (text[1:] != text[:-1] + 1))
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, len(text))) + width - 1
    waiting = [(-n, q, p) for n, q, p in zip(sizes.tolist(), item[begins].tolist(), text[begins].tolist())]
    heapq.heapify(waiting)
    in_text: set[int] = set()
    in_item: set[int] = set()
    found = []
    while waiting:
        size, q, p = heapq.heappop(waiting)
        taken = [k for k in range(-size) if p + k in in_text or q + k in in_item]
        if not taken:
            in_text.update(range(p, p - size))
            in_item.update(range(q, q - size))
            found.append((p, q, -size))
            continue
        for low, high in zip([-1, *taken], [*taken, -size]):
            if high - low - 1 >= width:
                heapq.heappush(waiting, (low + 1 - high, q + low + 1, p + low + 1))
    return sorted(found)


def blocks(
    benchmark: DataFrame, id_col: str, text_col: str, min_match: int, block_bytes: int = BLOCK_BYTES
) -> Iterator[Index]:
    """The items in as many hash-dealt blocks as keep one at about ``block_bytes`` of text.

    Only one block at a time is in the driver; a benchmark of any size makes more blocks, not larger ones.
    """
    items = benchmark.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        table = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").toArrow()
        if table.num_rows:
            texts = table.column("text").combine_chunks()
            yield Index(table.column("id").combine_chunks(), texts, min_match)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, item_id, n_tokens, n_covered, coverage, tiles``: one row per document row and leaked item.

    Null texts have no tokens.  Items that repeat id and text count once.  Each block of items is
    matched in one scan of the documents, without a shuffle.
    """
    tile = "array<struct<text_token: int, item_token: int, length: int>>"
    kind = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("item_id", benchmark.schema[item_id_col].dataType),
        ]
    )
    schema = f"{kind.toDDL()}, n_tokens int, n_covered int, coverage double, tiles {tile}"
    tile_type = pa.list_(pa.struct([("text_token", pa.int32()), ("item_token", pa.int32()), ("length", pa.int32())]))
    context = docs.sparkSession.sparkContext

    def matcher(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = list(index.leaks(batch.column(1), threshold))
                items = [f[1] for f in found]
                sizes = index.sizes[items] if items else np.zeros(0, np.int64)
                covered = np.array([sum(t[2] for t in f[2]) for f in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                        index.ids.take(pa.array(items, pa.int64())),
                        pa.array(sizes, pa.int32()),
                        pa.array(covered, pa.int32()),
                        pa.array(covered / np.maximum(sizes, 1)),
                        pa.array(
                            [[dict(zip(("text_token", "item_token", "length"), t)) for t in f[2]] for f in found], tile_type
                        ),
                    ],
                    ["doc_id", "item_id", "n_tokens", "n_covered", "coverage", "tiles"],
                )

        return run

    texts = docs.select(F.col(id_col), F.col(text_col))
    found = None
    for index in blocks(benchmark, item_id_col, item_text_col, min_match, block_bytes):
        part = texts.mapInArrow(matcher(context.broadcast(index)), schema)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows, with their columns, whose text leaks no item; nothing is shuffled."""
    context = docs.sparkSession.sparkContext

    def clean(shared):
        @F.arrow_udf(returnType=T.BooleanType())
        def check(texts: pa.Array) -> pa.Array:
            kept = np.ones(len(texts), bool)
            for d, _, _ in shared.value.leaks(texts, threshold):
                kept[d] = False
            return pa.array(kept)

        return check

    for index in blocks(benchmark, item_id_col, item_text_col, min_match, block_bytes):
        docs = docs.where(clean(context.broadcast(index))(F.coalesce(F.col(text_col), F.lit(""))))
    return docs
