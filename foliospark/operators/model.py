"""Linear support vector machine, calibration, search, scoring and persistence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions.results import rank_scores, top_class
from foliospark.operators.features import STRUCTURAL_NAMES, FeatureModel
from foliospark.operators import joint_svm
from foliospark.operators.linear import argmax, linear_scores
from foliospark.sources.cache import is_missing


# High enough for every fit to end at its tolerance; a fit that does not is told by ``converged``.
MAX_ITER = 1000


@dataclass
class LinearFit:
    """Weights and intercept of each class; ``converged``: every class was fitted to tolerance."""

    weights: list[list[float]]
    intercepts: list[float]
    converged: bool = True

    def margins(self, entries: Column) -> Column:
        return linear_scores(entries, self.weights, self.intercepts)


def fit_svm(
    frame: DataFrame,
    c: float,
    max_iter: int = MAX_ITER,
    parallelism: int = 4,
    classes: int | None = None,
    near: LinearFit | None = None,
) -> LinearFit:
    """One linear SVM per class on ``(features, label_index)``, the class against all others.

    Squared hinge loss, ``C`` times its sum plus half the squared norm (bias included), solved by the
    joint Newton solver to its tolerance; ``max_iter`` bounds the Newton steps.  ``classes`` is needed
    where ``frame`` may lack some, as a training fold may.  ``parallelism`` is kept for callers: every
    class is solved in the same passes.  ``near``: a fit of related rows to start from.
    """
    count = classes if classes is not None else int(frame.agg(F.max("label_index")).first()[0]) + 1
    problems = joint_svm.search_problems([c], 0, count, refit=True)
    start = _start(near, problems)
    fit = joint_svm.solve(frame, problems, joint_svm.width_of(frame), max_newton=max_iter, start=start)
    weights, biases = fit.of(float(c), -1)
    return LinearFit(weights, biases, all(fit.converged))


def _start(near: LinearFit | None, problems: Sequence[joint_svm.Problem]) -> np.ndarray | None:
    """The weights of ``near`` for the class of every problem."""
    if near is None:
        return None
    rows = np.column_stack([np.array(near.weights), np.array(near.intercepts)])
    return rows[[p.label for p in problems]]


def mean_fit(fits: Sequence[LinearFit]) -> LinearFit:
    """The mean of the weights of several fits: a point to start from, not a fit."""
    weights = np.mean([f.weights for f in fits], axis=0)
    return LinearFit(weights.tolist(), np.mean([f.intercepts for f in fits], axis=0).tolist(), False)


def vector_entries(features: str = "features") -> Column:
    return F.unwrap_udt(features)


def held_out_margins(frame: DataFrame, fits: Sequence[LinearFit]) -> DataFrame:
    """Add ``margins``: each row is scored by the fit that has not seen its ``fold``; one pass."""
    margins = F.lit(None).cast("array<double>")
    for fold, fit in enumerate(fits):
        margins = F.when(F.col("fold") == fold, fit.margins(joint_svm.entries_of(frame))).otherwise(margins)
    return frame.withColumn("margins", margins)


def fit_folds(
    frame: DataFrame, c: float, folds: int, max_iter: int, parallelism: int, classes: int | None = None
) -> list[LinearFit]:
    """One fit per fold, on the rows of the other folds; all folds and classes in the same passes."""
    return fit_grid(frame, [c], folds, max_iter, classes)[float(c)]


def fit_grid(
    frame: DataFrame, grid: Sequence[float], folds: int, max_iter: int = MAX_ITER, classes: int | None = None
) -> dict[float, list[LinearFit]]:
    """Fits of every fold for every C, solved together: ``{C: [fit of fold 0, ...]}``."""
    if classes is None:
        classes = int(frame.agg(F.max("label_index")).first()[0]) + 1
    problems = joint_svm.search_problems(grid, folds, classes, refit=False)
    fit = joint_svm.solve(frame, problems, joint_svm.width_of(frame), max_newton=max_iter)
    out = {}
    for c in grid:
        fits = []
        for fold in range(folds):
            weights, biases = fit.of(float(c), fold)
            done = all(ok for p, ok in zip(fit.problems, fit.converged) if p.c == c and p.fold == fold)
            fits.append(LinearFit(weights, biases, done))
        out[float(c)] = fits
    return out


def fit_with_folds(
    frame: DataFrame,
    c: float,
    folds: int,
    max_iter: int = MAX_ITER,
    classes: int | None = None,
    near: LinearFit | None = None,
) -> tuple[LinearFit, list[LinearFit]]:
    """The fit on all rows and one per fold on the rows of the others, solved together.  ``near``: a fit of
    related rows to start from."""
    if classes is None:
        classes = int(frame.agg(F.max("label_index")).first()[0]) + 1
    problems = joint_svm.search_problems([c], folds, classes, refit=True)
    start = _start(near, problems)
    fit = joint_svm.solve(frame, problems, joint_svm.width_of(frame), max_newton=max_iter, start=start)
    fits = []
    for fold in [-1, *range(folds)]:
        done = all(ok for p, ok in zip(fit.problems, fit.converged) if p.fold == fold)
        fits.append(LinearFit(*fit.of(float(c), fold), done))
    return fits[0], fits[1:]


def grid_search(
    frame: DataFrame,
    folds: int,
    grid: Sequence[float] = tuple(fixed.C_GRID),
    max_iter: int = MAX_ITER,
    parallelism: int = 4,
    kept: dict[float, LinearFit] | None = None,
) -> list[tuple[float, float]]:
    """``(C, accuracy averaged over the folds)`` for every C, in grid order.

    ``frame``: ``(features, label_index, fold)``.  All C, folds and classes are one joint solve; the
    accuracy of a fold is counted from its held-out rows, scored by the weights that did not see them.
    ``kept`` receives the mean of the folds' weights of every C, for later fits to start from.
    """
    classes = int(frame.agg(F.max("label_index")).first()[0]) + 1
    problems = joint_svm.search_problems(grid, folds, classes, refit=False)
    width = joint_svm.width_of(frame)
    with joint_svm.cached_blocks(frame) as blocks:
        fit = joint_svm.solve(frame, problems, width, max_newton=max_iter, blocks=blocks)
        scores = joint_svm.held_out_accuracy(frame, fit, [float(c) for c in grid], folds, blocks)
    if kept is not None:
        for c in grid:
            kept[float(c)] = mean_fit([LinearFit(*fit.of(float(c), fold)) for fold in range(folds)])
    return [(float(c), scores[float(c)]) for c in grid]


def best_c(scores: Sequence[tuple[float, float]]) -> tuple[float, float]:
    """The first C with the best score."""
    top = max(score for _, score in scores)
    return next((c, score) for c, score in scores if score == top)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z)))


def _margin_blocks(margins: DataFrame, classes: int):
    """Cached blocks ``(labels, margins, known)`` of one Arrow batch each; an absent margin is not known."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                labels = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
                known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
                values = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
                parts = (labels, values.astype(float), known)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["l", "m", "k"])

    def unpack(row):
        values = np.frombuffer(row["m"], float).reshape(-1, classes)
        return np.frombuffer(row["l"], np.int32), values, np.frombuffer(row["k"], bool).reshape(-1, classes)

    columns = [F.get("margins", F.lit(k)).cast("double").alias(f"m{k}") for k in range(classes)]
    rows = margins.select(F.coalesce(F.col("label_index").cast("int"), F.lit(-1)).alias("label"), *columns)
    packed = rows.mapInArrow(pack, "l binary, m binary, k binary")
    return packed.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def fit_calibration(
    margins: DataFrame, classes: int, parallelism: int = 4, tol: float = 1e-10, max_iter: int = 100
) -> list[tuple[float, float]]:
    """Slope and offset of each class's sigmoid, from held-out ``(label_index, margins)``.

    Targets are smoothed: (n+1)/(n+2) for the n rows of the class, 1/(m+2) for the m others; the loss
    is the cross-entropy of ``sigmoid(a m + b)`` against them.  All classes are fitted at once by Newton
    steps: one pass per step gives the loss, gradient and 2x2 Hessian of every class after the full step,
    a second one the losses at shorter steps (halving until the loss falls) where the full one does not
    lower it.  A pass is one ``treeReduce`` of small sums over cached blocks of margins.
    ``parallelism`` is kept for callers.
    """
    margins = margins.select("label_index", "margins")
    sizes = {int(r[0]): r[1] for r in margins.groupBy("label_index").count().collect() if r[0] is not None}
    total = sum(sizes.values())
    inside = np.array([sizes.get(k, 0) for k in range(classes)], dtype=float)
    high, low = (inside + 1) / (inside + 2), 1 / (total - inside + 2)
    # Platt's start: no slope, the offset of the smoothed prior
    slopes, offsets = np.zeros(classes), np.log((inside + 1) / (total - inside + 1))
    lengths = 0.5 ** np.arange(10)

    def losses_of(m, t, known, a, b):
        z = m * a + b
        return np.where(known, _softplus(z) - t * z, 0.0).sum(axis=0)

    def targets(labels):
        return np.where(labels[:, None] == np.arange(classes)[None, :], high, low)

    def sums_kernel(block, a, b):
        labels, m, known = block
        t = targets(labels)
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-(m * a + b)))
        off, v = np.where(known, p - t, 0.0), np.where(known, p * (1 - p), 0.0)
        sums = [off * m, off, v * m * m, v * m, v]
        return np.stack([x.sum(axis=0) for x in sums] + [losses_of(m, t, known, a, b)])

    def line_kernel(block, a, b, da, db):
        labels, m, known = block
        t = targets(labels)
        return np.stack([losses_of(m, t, known, a + h * da, b + h * db) for h in lengths])

    blocks = _margin_blocks(margins, classes)
    try:

        def run(kernel, *params):
            return blocks.map(lambda block: kernel(block, *params)).treeReduce(lambda x, y: x + y, depth=2)

        if not classes or blocks.isEmpty():
            return [(float(a), float(b)) for a, b in zip(slopes, offsets)]
        now = run(sums_kernel, slopes, offsets)
        for _ in range(max_iter):
            ga, gb, haa, hab, hbb, loss = now
            det = haa * hbb - hab * hab
            open_ = ~((np.abs(ga) + np.abs(gb) <= tol * max(total, 1)) | (det <= 0))
            if not open_.any():
                break
            safe = np.where(open_, det, 1.0)
            da = np.where(open_, (-hbb * ga + hab * gb) / safe, 0.0)
            db = np.where(open_, (hab * ga - haa * gb) / safe, 0.0)
            there = run(sums_kernel, slopes + da, offsets + db)
            length = np.where(open_ & (there[5] < loss), 1.0, 0.0)
            short = open_ & (length == 0)
            if short.any():
                tried = run(line_kernel, slopes, offsets, da, db)
                for h, losses in zip(lengths, tried):
                    length = np.where(short & (length == 0) & (losses < loss), h, length)
            if not (length > 0).any():
                break
            slopes, offsets = slopes + length * da, offsets + length * db
            # classes that took the full step or none are known there or before
            now = run(sums_kernel, slopes, offsets) if (length[short] > 0).any() else np.where(length > 0, there, now)
    finally:
        blocks.unpersist()
    return [(float(a), float(b)) for a, b in zip(slopes, offsets)]


def class_probabilities(margins: Column, sigmoids: Sequence[tuple[float, float]]) -> Column:
    """Calibrated scores, normalised to one."""
    raw = F.array(
        *[
            1 / (1 + F.exp(-(F.get(margins, F.lit(k)) * slope + offset)))
            for k, (slope, offset) in enumerate(sigmoids)
        ]
    )
    total = F.aggregate(raw, F.lit(0.0), lambda t, p: t + p)
    return F.transform(raw, lambda p: p / total)


@dataclass
class DocumentModel:
    """Everything needed to score documents."""

    classes: list[str]
    features: FeatureModel
    svm: LinearFit
    sigmoids: list[tuple[float, float]]

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Add ``margins`` and ``probabilities`` (class order) and ``all_scores`` (ranked).

        Every step is an expression over the row; there is no shuffle and no Python worker.
        """
        entries = self.features.joined(docs, text, "_entries")
        scored = entries.withColumn("margins", self.svm.margins(F.col("_entries"))).withColumn(
            "probabilities", class_probabilities(F.col("margins"), self.sigmoids)
        )
        shares = [F.get("probabilities", F.lit(k)) for k in range(len(self.classes))]
        return scored.withColumn("all_scores", rank_scores(self.classes, shares)).drop("_entries")

    def predict(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Add ``predicted`` (largest margin) and ``confidence`` (largest probability).  The two may name
        different classes; ``all_scores[0]`` is free of that."""
        names = F.array(*[F.lit(c) for c in self.classes])
        label = F.get(names, argmax(F.col("margins")).cast("int"))
        return (
            self.score(docs, text)
            .withColumn("predicted", label)
            .withColumn("confidence", top_class("all_scores")["confidence"])
        )

    # ------------------------------------------------------------------ persistence

    def save(self, spark: SparkSession, path: str) -> None:
        """Three small tables below ``path``."""
        terms = list(zip(range(len(self.features.vocabulary)), self.features.vocabulary, self.features.idf))
        spark.createDataFrame(terms, "term_index int, term string, idf double").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/vocabulary")
        scale = list(zip(range(len(STRUCTURAL_NAMES)), STRUCTURAL_NAMES, self.features.max_abs))
        spark.createDataFrame(scale, "position int, feature string, max_abs double").coalesce(
            1
        ).write.mode("overwrite").parquet(f"{path}/scaler")
        rows = [
            (k, name, self.svm.weights[k], self.svm.intercepts[k], *self.sigmoids[k])
            for k, name in enumerate(self.classes)
        ]
        schema = (
            "position int, label string, weights array<double>, intercept double, "
            "slope double, offset double"
        )
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/classes"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str, unscaled: bool = False) -> DocumentModel:
        """Read the tables back.  A missing table is an error; ``unscaled`` takes a model that was saved
        without a scaler on purpose, its structural block stays as it is."""
        try:
            rows = spark.read.parquet(f"{path}/classes").orderBy("position").collect()
            terms = spark.read.parquet(f"{path}/vocabulary").orderBy("term_index").collect()
        except AnalysisException as missing:
            if not is_missing(missing):
                raise
            raise FileNotFoundError(f"no trained model at {path}; train one first") from missing
        if unscaled:
            max_abs = [1.0] * len(STRUCTURAL_NAMES)
        else:
            scale = spark.read.parquet(f"{path}/scaler").orderBy("position").collect()
            max_abs = [r["max_abs"] for r in scale]
        features = FeatureModel([r["term"] for r in terms], [r["idf"] for r in terms], max_abs)
        return cls(
            [r["label"] for r in rows],
            features,
            LinearFit([list(r["weights"]) for r in rows], [r["intercept"] for r in rows]),
            [(r["slope"], r["offset"]) for r in rows],
        )
