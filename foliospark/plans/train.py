"""The training job: documents with labels in, model and report out."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.operators.evaluation import accuracy, per_class_metrics
from foliospark.operators.features import FeatureModel, prepared
from foliospark.operators.joint_svm import entries_of
from foliospark.operators.linear import argmax
from foliospark.operators.model import (
    MAX_ITER,
    DocumentModel,
    best_c,
    fit_calibration,
    fit_svm,
    fit_with_folds,
    grid_search,
    held_out_margins,
)
from foliospark.operators.pages import drop_blank
from foliospark.operators.splitting import (
    class_counts,
    fold_count,
    guards_from_counts,
    kfold,
    stratified_split,
    wants_search,
)
from foliospark.session import materialise

# A model has one weight vector per class; more classes than this are refused, never left out.
MAX_CLASSES = 10_000

REPORT_SCHEMA = (
    "trained_at string, total_documents bigint, documents_per_class map<string,bigint>, "
    "grid_search boolean, best_C double, cv_accuracy double, train_samples bigint, "
    "test_samples bigint, accuracy double, converged boolean, "
    "per_class map<string,struct<precision:double,recall:double,f1_score:double,support:bigint>>"
)


def _index(classes: list[str], label: str) -> Column:
    names = F.array(*[F.lit(c) for c in classes])
    return (F.array_position(names, F.col(label)) - 1).cast("double")


def _vectors(
    docs: DataFrame, features: FeatureModel, classes: list[str], doc: str, text: str, label: str
) -> DataFrame:
    """``(doc, label, label_index, features)``, written once and read by every fit."""
    indexed = features.plain_vectors(docs, text)
    return materialise(
        indexed.select(doc, label, _index(classes, label).alias("label_index"), "features"), "vectors"
    )


def train(
    docs: DataFrame,
    grid: bool = True,
    c_grid: Sequence[float] = tuple(fixed.C_GRID),
    max_folds: int = fixed.MAX_FOLDS,
    leak_free: bool = False,
    seed: int = fixed.SEED,
    max_iter: int = MAX_ITER,
    min_df: int = fixed.MIN_DF,
    max_features: int = fixed.MAX_FEATURES,
    parallelism: int = 4,
    max_classes: int = MAX_CLASSES,
    doc: str = "doc_id",
    text: str = "text",
    label: str = "label",
) -> tuple[DocumentModel, DataFrame]:
    """Fit features, search C, evaluate on a held-out part, refit on all documents, calibrate.

    Vocabulary, idf and scaling are fitted on all documents before the split, which makes the
    evaluation a little optimistic; ``leak_free`` evaluates with features fitted on the train part.
    """
    spark = docs.sparkSession
    docs = drop_blank(docs, text).where(F.col(label).isNotNull())
    found = class_counts(docs, label).limit(max_classes + 1).collect()
    if len(found) > max_classes:
        raise ValueError(f"more than {max_classes} classes; raise max_classes if they are meant")
    sizes = {r[label]: r["documents"] for r in found}
    counts = spark.createDataFrame(list(sizes.items()), "label string, documents bigint")
    guards = guards_from_counts(counts).first()
    if not guards["can_train"]:
        raise ValueError(f"only {guards['documents']} documents; at least {fixed.MIN_DOCUMENTS} needed")
    if guards["classes"] < 2:
        raise ValueError("all documents have the same label")
    classes = sorted(sizes)
    # the fit reads terms and counts twice, the vectors once: take the texts apart once
    if "_terms" in docs.columns:  # taken apart before, by ``prepared``
        docs = docs.select(doc, label, "_terms", "_structural")
    else:
        docs = materialise(prepared(docs.select(doc, text, label), text), "terms")
    features = FeatureModel.fit(docs, text, doc, min_df, max_features)
    everything = _vectors(docs, features, classes, doc, text, label)

    chosen, cv, test_rows, score, figures = fixed.DEFAULT_C, None, 0, float("nan"), {}
    searched, near, by_c = None, None, {}
    train_rows = guards["documents"]
    if guards["can_split"]:
        if leak_free:
            parts = stratified_split(docs, fixed.TEST_SHARE, seed, label, doc)
            inner = FeatureModel.fit(parts.where("part = 'train'"), text, doc, min_df, max_features)
            split = _vectors(docs, inner, classes, doc, text, label)
        else:
            split = everything
        split = stratified_split(split, fixed.TEST_SHARE, seed, label, doc)
        train_part, test_part = split.where("part = 'train'"), split.where("part = 'test'")
        in_train = {r[label]: r["documents"] for r in class_counts(train_part, label).collect()}
        train_rows = sum(in_train.values())
        test_rows = guards["documents"] - train_rows
        if wants_search(grid, train_rows, len(classes)):
            folds = min(max_folds, fold_count(min(in_train.values())))
            folded = kfold(train_part, folds, seed, label, doc)
            searched, cv = best_c(grid_search(folded, folds, c_grid, max_iter, parallelism, by_c))
            chosen = searched
        # the folds, the train part and all rows have near solutions: each solve starts from the one before
        trial = fit_svm(train_part, chosen, max_iter, parallelism, len(classes), by_c.get(float(chosen)))
        near = None if leak_free else trial  # other features there
        guess = F.get(
            F.array(*[F.lit(c) for c in classes]),
            argmax(trial.margins(entries_of(test_part))).cast("int"),
        )
        judged = test_part.select(F.col(label).alias("label"), guess.alias("predicted"))
        judged = materialise(judged, "judged")
        score = accuracy(judged).first()["accuracy"]
        figures = {
            r["label"]: (r["precision"], r["recall"], r["f1_score"], r["support"])
            for r in per_class_metrics(judged).collect()
        }

    folds = min(max_folds, fold_count(guards["smallest_class"]))
    folded = kfold(everything, folds, seed, label, doc)
    final, by_fold = fit_with_folds(folded, chosen, folds, max_iter, len(classes), near)
    unseen = held_out_margins(folded, by_fold)
    # the calibration reads the margins once per Newton step: score the rows once
    # (rows of the vectors are even already; dealt out again by size, few bytes would go to few tasks)
    unseen = materialise(unseen.select("label_index", "margins"), "held-out-margins", even=True)
    sigmoids = fit_calibration(unseen, len(classes))

    report = (
        datetime.datetime.now().isoformat(timespec="seconds"),
        int(guards["documents"]),
        {k: int(v) for k, v in sizes.items()},
        bool(grid),
        searched,
        None if cv is None else round(cv, 4),
        int(train_rows),
        int(test_rows),
        float(score),
        final.converged,
        figures,
    )
    return (
        DocumentModel(classes, features, final, sigmoids),
        spark.createDataFrame([report], REPORT_SCHEMA),
    )
