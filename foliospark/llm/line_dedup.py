"""Lines that many documents share lose all their copies.

Hashes of the lines are range-partitioned and sorted by document and position within a hash; one pass
over each sorted partition counts the documents of a hash and lets go of its lines.  What comes back per
document is a compressed bitmap of the lines to keep, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.rows import BLANKS, KEYS, ascii_lower, keyed, settled, unpacked

MIN_DOCS = 10
MIN_CHARS = 1
COLUMNS = ["hash_a", "hash_b", "doc_key", "text_key", "line"]
SCHEMA = "hash_a long, hash_b long, doc_key long, text_key long, line int, n long, decided boolean"


def line_rows(rows: DataFrame, text: Column, min_chars: int) -> DataFrame:
    """A row per line whose key is long enough: 128 bits of hash, document and position."""
    key = F.trim(ascii_lower(F.col("value")), F.lit(BLANKS))
    return (
        rows.select(*KEYS, F.posexplode(F.split(text, "\n")).alias("line", "value"))
        .select(*KEYS, "line", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("hash_a"), F.xxhash64(F.lit(7), "key").alias("hash_b"), *KEYS, "line")
    )


def _batch(values: dict, n: np.ndarray, decided: bool, absent: bool = False) -> pa.RecordBatch:
    size = len(values["line"])
    arrays = [
        pa.array(values[c], pa.int64(), mask=np.full(size, absent and c == "doc_key")) for c in COLUMNS
    ]
    arrays[4] = arrays[4].cast(pa.int32())
    arrays += [pa.array(n, pa.int64()), pa.array(np.full(size, decided))]
    return pa.RecordBatch.from_arrays(arrays, [*COLUMNS, "n", "decided"])


class HashRuns:
    """The rows of one partition, sorted by hash, document and position, as they come in.

    ``held`` has the rows of the last hash while fewer than ``least`` documents have it.  From then on
    its rows leave at once and only their count (``seen``) and the last document stay.
    """

    def __init__(self, least: int):
        self.least, self.first, self.open = least, None, None
        self.held = {name: np.empty(0, np.int64) for name in COLUMNS}
        self.seen, self.last_doc = 0, None

    def summary(self, key: tuple[int, int], n: int) -> pa.RecordBatch:
        values = {name: np.zeros(1, np.int64) for name in COLUMNS} | {
            "hash_a": np.array(key[:1]), "hash_b": np.array(key[1:])
        }
        return _batch(values, np.array([n]), False, absent=True)

    def close(self, last: bool) -> Iterator[pa.RecordBatch]:
        """The last hash is complete.  Another partition can have more of the first and the last hash
        of this one only: for these the count goes along."""
        if self.open is None:
            return
        if last or self.open == self.first:
            if self.seen:
                yield self.summary(self.open, self.seen)
            elif len(doc := self.held["doc_key"]):
                yield _batch(self.held, np.append(1, doc[1:] != doc[:-1]), False)
        self.held = {name: values[:0] for name, values in self.held.items()}
        self.seen, self.last_doc, self.open = 0, None, None

    def add(self, new: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if (new["hash_a"][0], new["hash_b"][0]) != self.open:
            yield from self.close(False)
        rows = {name: np.concatenate([self.held[name], new[name]]) for name in COLUMNS}
        a, b, doc = rows["hash_a"], rows["hash_b"], rows["doc_key"]
        starts = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        fresh = starts | np.append(True, doc[1:] != doc[:-1])
        fresh[0] = doc[0] != self.last_doc
        group, starts = np.cumsum(starts) - 1, np.flatnonzero(starts)
        docs = np.bincount(group, fresh).astype(np.int64)
        docs[0] += self.seen
        full = docs >= self.least
        if full.any():
            gone = full[group]
            yield _batch({name: values[gone] for name, values in rows.items()}, np.zeros(gone.sum(), np.int64), True)
        self.first = self.first or (a[0], b[0])
        for g in [0, len(starts) - 1] if len(starts) > 1 else [0]:
            part = slice(starts[g], starts[g + 1] if g + 1 < len(starts) else None)
            self.open = (a[part.start], b[part.start])
            self.held = {name: values[part if not full[g] else slice(0, 0)] for name, values in rows.items()}
            self.seen, self.last_doc = (docs[g], doc[part][-1]) if full[g] else (0, None)
            if g + 1 < len(starts):
                yield from self.close(False)


def frequent(least: int):
    """For sorted partitions: the rows of hashes that ``least`` documents have, settled or to be settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = HashRuns(least)
        for batch in batches:
            if batch.num_rows:
                yield from runs.add({c: batch.column(c).cast(pa.int64()).to_numpy() for c in COLUMNS})
        yield from runs.close(True)

    return run


@F.arrow_udf(returnType=T.BinaryType())
def bitmap(lines: pa.Array) -> pa.Array:
    """One bit per line, 1 to keep, up to the byte with the last dropped line; compressed."""
    done = []
    for dropped in lines:
        positions = np.asarray(dropped.values.to_numpy())
        keep = np.ones((positions.max() // 8 + 1) * 8, bool)
        keep[positions] = False
        done.append(zlib.compress(np.packbits(keep).tobytes(), 6))
    return pa.array(done, pa.binary())


def kept_lines(text: str, keep: bytes) -> str:
    """The lines whose bit is 1 or that lie behind the bitmap."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    bits = bits[: len(lines)].tolist()
    return "\n".join([line for line, bit in zip(lines, bits) if bit] + lines[len(bits) :])


@F.arrow_udf(returnType=T.StringType())
def without_lines(text: pa.Array, keep: pa.Array) -> pa.Array:
    return pa.array(
        [None if k is None else kept_lines(t or "", k) for t, k in zip(text.to_pylist(), keep.to_pylist())],
        pa.string(),
    )


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """``doc_key, text_key, n_dropped, keep``: a compressed keep bitmap for each document that loses lines.

    A line's key is the line without blanks (0x20, 0x09-0x0D) at both ends, A-Z lower-cased.  Keys of at
    least ``min_chars`` characters that ``min_docs`` documents hold lose all their lines.  A document is
    an id: rows that repeat an id count once, and so do all rows without id.  Null text is one empty line.
    """
    rows = keyed(docs.select(id_col, text_col), id_col, text_col)
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    lines = (
        line_rows(rows, text, min_chars)
        .repartitionByRange("hash_a", "hash_b", "doc_key")
        .sortWithinPartitions(*COLUMNS)
    )
    counted = lines.mapInArrow(frequent(min_docs), SCHEMA)
    return (
        settled(counted, ["hash_a", "hash_b"], min_docs)
        .groupBy(*KEYS)
        .agg(F.collect_set("line").alias("lines"))
        .select(*KEYS, F.size("lines").cast("long").alias("n_dropped"), bitmap("lines").alias("keep"))
    )


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, n_lines, n_dropped, kept``: documents with the text their bitmap leaves.

    Text without a dropped line is passed on as it is (null stays null) and does not go through Python.
    """
    text = F.col("row").getField(text_col)
    cut = F.when(F.col("keep").isNotNull(), text)
    joined = keyed(docs, id_col, text_col).join(bitmaps.hint("shuffle_hash"), KEYS, "left")
    return joined.select(
        "row",
        F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNotNull(), without_lines(cut, "keep")).otherwise(text).alias("kept"),
    )


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Documents with their columns and without frequent lines; ``n_chars``, where there is one, follows."""
    done = with_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, **how), id_col, text_col)
    replaced = {text_col: F.col("kept")}
    if "n_chars" in docs.columns:
        old = F.col("row").getField("n_chars")
        kind = docs.schema["n_chars"].dataType
        replaced["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept").cast(kind)).otherwise(old)
    return done.select(*unpacked(docs.schema, replaced))
