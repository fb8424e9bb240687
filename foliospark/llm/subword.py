"""Text classifiers over learned vectors of hashed words and character n-grams.

A text is the mean of the vectors of its words and of its words' character n-grams (blanks at both ends
included), and a softmax layer turns the mean into class probabilities.  Vectors and layer are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.words import Chars, mixed, pieces


@dataclass(frozen=True)
class Settings:
    """What features a text has and how they are trained.

    ``sample_rows`` and ``sample_chars`` bound the training data: the rows are the first in the order of a
    hash of the id, among labelled texts of at most so many characters.  Nothing bounds what is scored.
    ``pairs`` adds pairs of neighbouring words; with ``rare`` the mean weighs a feature by the logarithm of how
    rare it is among the training texts, so that a few telling words outweigh what all texts have.
    """

    grams: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 18
    pairs: bool = False
    rare: bool = False
    dim: int = 4
    lower: bool = True
    epochs: int = 8
    rate: float = 3000.0
    layer_rate: float = 0.003
    sample_rows: int = 5000
    sample_chars: int = 20_000
    seed: int = 17


def features(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the features of some texts, one kind at a time, in text order, and where each text
    begins among them."""
    chars = Chars(data, offsets, settings.lower)
    mask = np.uint64((1 << settings.bits) - 1)
    words, first = chars.words()
    yield (words & mask).astype(np.int32), first
    if settings.pairs and len(words):
        # A word and the one before it; a word said twice is the same feature whatever the word.
        pair = mixed(words + np.append(words[:1], words[:-1]) * np.uint64(3))
        pair[1:][words[1:] == words[:-1]] = 0
        alone = np.zeros(len(words), bool)
        alone[first[:-1][first[:-1] < first[1:]]] = True
        inside = np.flatnonzero(~alone)
        yield (pair[inside] & mask).astype(np.int32), np.searchsorted(inside, first)
    for n in settings.grams:
        hashes, first = chars.grams(n)
        yield (hashes & mask).astype(np.int32), first


def bags(texts: pa.Array, settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its buckets and their shares of all its features."""
    done = []
    for low, high, data, offsets in pieces(texts):
        kinds = list(features(data, offsets, settings))
        for d in range(high - low):
            found = np.concatenate([ids[first[d] : first[d + 1]] for ids, first in kinds])
            ids, counts = np.unique(found, return_counts=True)
            done.append((ids, (counts / max(len(found), 1)).astype(np.float32)))
    return done


@dataclass
class Model:
    """``weights`` has, per bucket, what its vector adds to the log-odds of class 1."""

    weights: np.ndarray
    bias: float
    settings: Settings

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probabilities of class 1; a text without features has that of the bias."""
        done = np.zeros(len(texts))
        for low, high, data, offsets in pieces(texts):
            total, size = np.zeros(high - low), np.zeros(high - low)
            for ids, first in features(data, offsets, self.settings):
                sums = np.append(0.0, np.cumsum(self.weights[ids], dtype=np.float64))
                total += sums[first[1:]] - sums[first[:-1]]
                size += np.diff(first)
            done[low:high] = total / np.maximum(size, 1)
        return 1 / (1 + np.exp(-np.clip(done + self.bias, -500, 500)))


def train(texts: pa.Array, labels: np.ndarray, settings: Settings) -> Model:
    """Vectors and softmax layer by stochastic gradient descent, one text at a time, with falling steps.

    The step of the vectors is large because each gets only its share of a text's gradient.  Without
    texts to learn from every score is near 0.5.
    """
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-0.01, 0.01, (1 << settings.bits, settings.dim)).astype(np.float32)
    layer = rng.normal(0, 1, (settings.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    docs = bags(texts, settings)
    weights = np.ones(1 << settings.bits, np.float32)
    if settings.rare:
        seen = np.zeros(1 << settings.bits, np.int64)
        for ids, _ in docs:
            seen[ids] += 1
        weights = np.where(seen, np.log((len(docs) + 1) / (seen + 1)), 0).astype(np.float32)
    for epoch in range(settings.epochs):
        left = 1 - epoch / settings.epochs
        rate, layer_rate = np.float32(settings.rate * left), np.float32(settings.layer_rate * left)
        for d in rng.permutation(len(docs)):
            ids, share = docs[d]
            share = share * weights[ids]
            mean = share @ vectors[ids]
            logits = mean @ layer + bias
            slope = np.exp(logits - logits.max())
            slope /= slope.sum()
            slope[labels[d]] -= 1
            vectors[ids] -= np.outer(rate * share, layer @ slope)
            layer -= layer_rate * np.outer(mean, slope)
            bias -= layer_rate * slope
    return Model(vectors @ (layer[:, 1] - layer[:, 0]) * weights, float(bias[1] - bias[0]), settings)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, settings: Settings) -> DataFrame:
    """``text, label``: the bounded sample of rows to learn from.

    ``training`` is a condition on ``doc_id``.  Labels that are null or of an id that is null, missing or
    not a training row are not read; an id with several labels has the largest.  The labels that
    can be in the sample are found first, so that whole texts are read of these only.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & training)
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .where("label in (0, 1)")
    )
    fitting = docs.where(F.length("text") <= settings.sample_chars).select("doc_id", "text")
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = (
        known.join(fitting.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(*order).limit(settings.sample_rows)
    )
    texts = fitting.join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows
    return texts.orderBy(*order, "text").limit(settings.sample_rows).select("text", F.col("label").cast("int"))


def fit(docs: DataFrame, labels: DataFrame, label: str, training: Column, settings: Settings) -> Model:
    sample = labelled_sample(docs, labels, label, training, settings).toArrow()
    texts = sample.column("text").combine_chunks().cast(pa.string())
    return train(texts, sample.column("label").to_numpy(), settings)


def score_column(docs: DataFrame, model: Model, text: Column) -> Column:
    """Scores of whole texts, null as empty; the model is broadcast once (4 bytes a bucket)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(returnType=T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts))

    return score(F.coalesce(text, F.lit("")))
