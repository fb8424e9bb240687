"""Language by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.words import Chars, pieces

GRAMS = (1, 2, 3)
BITS = 15
SMOOTHING = 0.5
UNKNOWN = "und"
MAX_MATRIX_BYTES = 1 << 28
HELD_LANGUAGES = 64


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


@dataclass
class Model:
    """``logs[l, bucket]``: log-probability of a bucket in language ``l``; ``priors``: of the language."""

    languages: list[str]
    logs: np.ndarray
    priors: np.ndarray
    bits: int
    grams: tuple[int, ...]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its posterior probability; ties go to the first by name."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums = np.empty((len(texts), len(self.languages)))
        for low, high, data, offsets in pieces(texts):
            part = np.tile(self.priors, (high - low, 1))
            for ids, first in buckets(data, offsets, self.grams, self.bits):
                for k, logs in enumerate(self.logs):
                    total = np.append(0.0, np.cumsum(logs[ids], dtype=np.float64))
                    part[:, k] += total[first[1:]] - total[first[:-1]]
            sums[low:high] = part
        best = sums.argmax(axis=1)
        return [self.languages[k] for k in best], 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)


def buckets(data: np.ndarray, offsets: np.ndarray, grams: tuple[int, ...], bits: int):
    """Buckets of the n-grams of some texts, one width at a time, and where each text begins."""
    chars, mask = Chars(data, offsets), np.uint64((1 << bits) - 1)
    for n in grams:
        hashes, first = chars.grams(n)
        yield (hashes & mask).astype(np.int32), first


def counted(grams: tuple[int, ...], bits: int):
    """``text, lang`` rows to ``lang, bucket, n``; bucket -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush():
            for lang, found in counts.items():
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at - 1), pa.array(found[at])], ["lang", "bucket", "n"]
                )
            counts.clear()

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for low, high, data, offsets in pieces(batch.column(0)):
                here = langs[low:high]
                owner = {lang: np.flatnonzero(here == lang) for lang in set(here)}
                for lang, rows in owner.items():
                    found = counts.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                    found[0] += len(rows)
                for ids, first in buckets(data, offsets, grams, bits):
                    of = np.repeat(np.arange(high - low), np.diff(first))
                    for lang, rows in owner.items():
                        if len(owner) == 1:
                            mine = ids
                        else:
                            chosen = np.zeros(high - low, bool)
                            chosen[rows] = True
                            mine = ids[chosen[of]]
                        counts[lang][1:] += np.bincount(mine, minlength=1 << bits)
                if len(counts) > HELD_LANGUAGES:
                    yield from flush()
        yield from flush()

    return run


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    training: Column | None = None,
    grams: tuple[int, ...] = GRAMS,
    bits: int = BITS,
) -> Model:
    """Counts over all training rows whose language is not null (null text has no n-grams).

    To the driver come at most ``2 ** bits + 1`` sums per language; a matrix beyond ``MAX_MATRIX_BYTES`` is
    refused, since it is broadcast: use fewer ``bits`` then.
    """
    training = ~held_out(F.col("doc_id")) if training is None else training
    known = docs.where(training & F.col(lang_col).isNotNull()).select(
        F.coalesce(text_col, F.lit("")).alias("text"), F.col(lang_col).alias("lang")
    )
    sums = (
        known.mapInArrow(counted(grams, bits), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    most = MAX_MATRIX_BYTES // 4 >> bits
    rows = sums.limit(most * ((1 << bits) + 1) + 1).toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    if len(languages) > most:
        raise ValueError(f"more than {most} languages at {bits} bits; use fewer bits")
    counts = np.zeros((len(languages), (1 << bits) + 1))
    place = {lang: k for k, lang in enumerate(languages)}
    at = np.array([place[lang] for lang in rows.column("lang").to_pylist()], int)
    counts[at, rows.column("bucket").to_numpy() + 1] = rows.column("n").to_numpy()
    priors = np.log(counts[:, 0] / counts[:, 0].sum()) if languages else np.zeros(0)
    smooth = counts[:, 1:] + SMOOTHING
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(languages, logs, priors, bits, grams)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row per input row.

    Text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(returnType=kind)
    def predict(texts: pa.Array) -> pa.Array:
        languages, scores = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(scores)], ["lang", "score"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    letters = text.rlike(r"\p{L}")
    found = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), letters.alias("letters"), predict(text).alias("p")
    )
    return found.select(
        "doc_id",
        "held_out",
        F.when(F.col("letters"), F.col("p.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), F.col("p.score")).otherwise(0.0).alias("score"),
    )
