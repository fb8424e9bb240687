"""Registered queries: splitting, evaluation, training, scoring, streaming."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions import results as rs
from foliospark.operators import evaluation as ev
from foliospark.operators import joint_svm
from foliospark.operators import model as md
from foliospark.operators import splitting as sp
from foliospark.operators.features import FeatureModel, prepared
from foliospark.operators.language import LanguageModel
from foliospark.plans import oracle_parts as sql
from foliospark.plans.classify import classify
from foliospark.plans.registry import register
from foliospark.plans.rendered import CORPUS, INVOICES, PREDICTED, Tables
from foliospark.plans.train import train
from foliospark.session import materialise, scratch_path
from foliospark.streaming import documents as stream

_LABELS = "(select doc_id, lang as label from {documents})"


def labelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("lang").alias("label"))


# ------------------------------------------------------------------------------ labels and splits


@register(
    "label_encode",
    f"select doc_id, label, dense_rank() over (order by label) - 1 as label_index from {_LABELS} d",
)
def label_encode(t: Tables) -> DataFrame:
    return sp.encode_labels(labelled(t)).select("doc_id", "label", "label_index")


@register("class_counts", f"select label, count(*) as documents from {_LABELS} d group by label")
def class_counts(t: Tables) -> DataFrame:
    return sp.class_counts(labelled(t))


@register(
    "training_guards",
    f"""
    select sum(n) as documents, count(*) as classes, min(n) as smallest_class,
        sum(n) >= {fixed.MIN_DOCUMENTS} as can_train, min(n) >= 2 and count(*) > 1 as can_split,
        sum(n) - ceil(sum(n) * {fixed.TEST_SHARE}) >= count(*) * 5 as can_search
    from (select label, count(*) as n from {_LABELS} d group by label) c
    """,
)
def training_guards(t: Tables) -> DataFrame:
    return sp.training_guards(labelled(t))


_ORDERED = f"""
    ordered as (
        select doc_id, label, count(*) over (partition by label) as n,
            row_number() over (partition by label
                order by md5('{fixed.SEED}:' || doc_id), doc_id) as place
        from {_LABELS} d
    )"""


@register(
    "stratified_split",
    f"""
    with {_ORDERED},
    sizes as (select label, max(n) as n from ordered group by label),
    sums as (select sum(n) as n_all, sum(n) - ceil(sum(n) * {fixed.TEST_SHARE}) as n_train from sizes),
    exact as (select label, n, n_train, n * n_train / n_all as share from sizes, sums),
    rests as (
        select *, row_number() over (order by share - floor(share) desc, label) as rest_place,
            n_train - sum(floor(share)) over () as rest
        from exact
    ),
    quota as (
        select label, n - floor(share) - case when rest_place <= rest then 1 else 0 end as test_rows
        from rests
    )
    select o.doc_id, o.label, case when o.place <= q.test_rows then 'test' else 'train' end as part
    from ordered o join quota q on q.label = o.label
    """,
)
def stratified_split(t: Tables) -> DataFrame:
    return sp.stratified_split(labelled(t)).select("doc_id", "label", "part")


@register(
    "kfold",
    f"""
    with {_ORDERED}
    select doc_id, label, len(list_filter([1, 2, 3, 4], lambda j: n * j // 5 < place)) as fold
    from ordered
    """,
)
def kfold(t: Tables) -> DataFrame:
    return sp.kfold(labelled(t), 5).select("doc_id", "label", "fold")


# -------------------------------------------------------------------------------------- evaluation


@register(
    "accuracy",
    f"""
    select cast(format('{{:.4f}}', avg(case when label = predicted then 1.0 else 0.0 end)) as double)
        as accuracy
    from ({PREDICTED}) p
    """,
)
def accuracy(t: Tables) -> DataFrame:
    return ev.accuracy(t.derive(PREDICTED))


@register(
    "per_class_metrics",
    f"""
    with p as ({PREDICTED}),
    classes as (select label from p union select predicted from p),
    counts as (
        select c.label,
            (select count(*) from p where p.label = c.label) as support,
            (select count(*) from p where p.predicted = c.label) as guessed,
            (select count(*) from p where p.label = c.label and p.predicted = c.label) as hits
        from classes c
    )
    select label, support,
        cast(format('{{:.4f}}', case when guessed = 0 then 0 else hits / guessed end) as double)
            as precision,
        cast(format('{{:.4f}}', case when support = 0 then 0 else hits / support end) as double)
            as recall,
        cast(format('{{:.4f}}', 2 * hits / (guessed + support)) as double) as f1_score
    from counts
    """,
)
def per_class_metrics(t: Tables) -> DataFrame:
    return ev.per_class_metrics(t.derive(PREDICTED))


# One report per source of documents; small sources were neither searched nor measured.
_REPORTS = f"""
select d.source, case when count(*) >= 8 then avg(case when p.label = p.predicted then 1.0 else 0.0 end)
    end as accuracy,
    case when count(*) >= 9 then avg(case when p.label = 'en' then 1.0 else 0.0 end) end as cv_accuracy,
    case when count(*) >= 9 then 10.0e0 end as best_C
from ({PREDICTED}) p join {{documents}} d on d.doc_id = p.doc_id
group by d.source
"""


@register(
    "metrics_tiles",
    f"""
    select coalesce(format('{{:.1f}}', accuracy * 100) || '%', 'N/A') as test_accuracy,
        coalesce(format('{{:.1f}}', cv_accuracy * 100) || '%', 'N/A') as cv_accuracy,
        case when best_C is null then '1.0' else '10.0' end as best_C
    from ({_REPORTS}) r
    """,
)
def metrics_tiles(t: Tables) -> DataFrame:
    reports = t.derive(_REPORTS)
    return rs.metrics_tiles(
        reports.withColumns({c: F.col(c).cast("double") for c in ("accuracy", "cv_accuracy", "best_C")})
    )


# ---------------------------------------------------------------------------------------- training

# The folds of the default job; every fit runs to its tolerance (the joint solver's Newton steps).
FOLDS = fixed.MAX_FOLDS


def corpus(t: Tables) -> DataFrame:
    return t.derive(CORPUS)


@lru_cache(maxsize=4)
def _trained(spark: SparkSession, folder: str):
    """One training run per session and folder, shared by the queries that need a model."""
    # fitting and scoring read the terms of this table: the texts are taken apart once, dealt out evenly
    rows = corpus(Tables(spark, folder)).hint("rebalance")
    documents = materialise(prepared(rows, keep_text=True), "corpus", even=True)
    model, report = train(documents, grid=True, max_folds=FOLDS)
    return documents, model, report


@lru_cache(maxsize=4)
def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Feature vectors of the rendered corpus with folds, as the search reads them."""
    # the texts are taken apart once; every later table keeps the even rows of the first
    rows = corpus(Tables(spark, folder)).hint("rebalance")
    documents = materialise(prepared(rows), "corpus", even=True)
    features = FeatureModel.fit(documents)
    indexed = sp.encode_labels(features.vectors(sp.kfold(documents, FOLDS)))
    frame = indexed.select("doc_id", "label", F.col("label_index").cast("double"), "features", "fold")
    return materialise(frame, "folds", even=True)


_CLASSES = "case label when 'Email' then 0 when 'Invoice' then 1 when 'Questionnaire' then 2 else 3 end"


@register("fit_svm", f"select doc_id, {_CLASSES} as label_index, {_CLASSES} as predicted from ({CORPUS}) c")
def fit_svm(t: Tables) -> DataFrame:
    frame = _vectors(t.spark, t.folder)
    fit = md.fit_svm(frame, fixed.DEFAULT_C)
    guess = md.argmax(fit.margins(md.vector_entries()))
    return frame.select(
        "doc_id", F.col("label_index").cast("int").alias("label_index"), guess.alias("predicted")
    )


def _recounted(frame: DataFrame, fit: joint_svm.JointFit, folds: int) -> dict[float, float]:
    """Held-out accuracy of every C counted again from a table of predictions, apart from the solver.

    Each row is scored in Arrow batches by the weights of every C that did not train on its fold; the
    table of ``(C, fold, right)`` is then counted by Spark.
    """
    keys = [(p.c, p.fold, p.label) for p in fit.problems]
    shared = frame.sparkSession.sparkContext.broadcast((fit.weights, keys))

    def predict(batches):
        import numpy as np
        import pyarrow as pa

        weights, keys = shared.value
        grid = sorted({k[0] for k in keys})
        # the problems of every C and fold in the order of their classes
        columns = {
            (c, fold): [i for _, i in sorted((k[2], i) for i, k in enumerate(keys) if k[:2] == (c, fold))]
            for c in grid
            for fold in {k[1] for k in keys}
        }
        for batch in batches:
            at, value = batch.column("indices"), batch.column("values")
            place, number = at.flatten().to_numpy(), value.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(np.diff(at.offsets.to_numpy()))])
            labels = batch.column("label_index").to_numpy(zero_copy_only=False).astype(int)
            folds = batch.column("fold").to_numpy(zero_copy_only=False).astype(int)
            for fold in np.unique(folds).tolist():
                mine = np.flatnonzero(folds == fold)
                for c in grid:
                    cols = columns[c, fold]
                    table, classes = weights[cols], np.array([keys[i][2] for i in cols])
                    right = np.empty(len(mine), dtype=np.int32)
                    for n, row in enumerate(mine):
                        here = slice(ends[row], ends[row + 1])
                        margins = table[:, place[here]] @ number[here] + table[:, -1]
                        right[n] = classes[np.argmax(margins)] == labels[row]
                    parts = [np.full(len(mine), c), np.full(len(mine), fold, np.int32), right]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["c", "fold", "right"])

    rows = frame.select(joint_svm.entries_of(frame).alias("v"), "label_index", "fold").select(
        "v.indices", "v.values", "label_index", "fold"
    )
    counted = (
        rows.mapInArrow(predict, "c double, fold int, right int")
        .groupBy("c", "fold")
        .agg(F.avg("right").alias("share"))
        .groupBy("c")
        .agg(F.avg("share").alias("accuracy"))
        .collect()
    )
    shared.destroy()
    return {float(r["c"]): float(r["accuracy"]) for r in counted}


# Every C: its score from the joint solve, counted again from held-out predictions; agrees also asks that
# every fit reached its tolerance.
@register(
    "grid_search",
    f"""
    select cast(g.c as double) as "C", n.documents, true as in_range, true as agrees
    from (select unnest({list(fixed.C_GRID)}) as c) g, (select count(*) as documents from ({CORPUS}) c) n
    """,
)
def grid_search(t: Tables) -> DataFrame:
    frame = _vectors(t.spark, t.folder)
    grid = [float(c) for c in fixed.C_GRID]
    classes = int(frame.agg(F.max("label_index")).first()[0]) + 1
    problems = joint_svm.search_problems(grid, FOLDS, classes, refit=False)
    with joint_svm.cached_blocks(frame) as blocks:
        fit = joint_svm.solve(frame, problems, joint_svm.width_of(frame), blocks=blocks)
        scores = joint_svm.held_out_accuracy(frame, fit, grid, FOLDS, blocks)
    again = _recounted(frame, fit, FOLDS)
    documents = frame.count()
    rows = []
    for c in grid:
        converged = all(ok for p, ok in zip(fit.problems, fit.converged) if p.c == c)
        rows.append((c, documents, 0 <= scores[c] <= 1, converged and abs(again[c] - scores[c]) < 1e-9))
    return t.spark.createDataFrame(rows, "C double, documents bigint, in_range boolean, agrees boolean")


@register(
    "calibrate",
    f"select doc_id, label, true as sums_to_one, true as in_range, true as rising from ({CORPUS}) c",
)
def calibrate(t: Tables) -> DataFrame:
    frame = _vectors(t.spark, t.folder)
    fits = md.fit_folds(frame, fixed.DEFAULT_C, FOLDS, md.MAX_ITER, 4)
    # the calibration reads the margins twice per Newton step: score the rows once
    unseen = md.held_out_margins(frame, fits).select("doc_id", "label", "label_index", "margins")
    unseen = materialise(unseen, "held-out-margins", even=True)
    sigmoids = md.fit_calibration(unseen, 4)
    shares = md.class_probabilities(F.col("margins"), sigmoids)
    total = F.aggregate("p", F.lit(0.0), lambda a, p: a + p)
    return unseen.select("doc_id", "label", shares.alias("p")).select(
        "doc_id",
        "label",
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.forall("p", lambda p: p.between(0, 1)).alias("in_range"),
        F.lit(all(slope > 0 for slope, _ in sigmoids)).alias("rising"),
    )


@register("predict", f"select doc_id, label, label as predicted from ({CORPUS}) c")
def predict(t: Tables) -> DataFrame:
    documents, model, _ = _trained(t.spark, t.folder)
    return model.predict(documents).select("doc_id", "label", "predicted")


@register(
    "predict_confidence",
    f"select doc_id, true as sums_to_one, true as in_range, true as is_largest from ({CORPUS}) c",
)
def predict_confidence(t: Tables) -> DataFrame:
    documents, model, _ = _trained(t.spark, t.folder)
    scored = model.predict(documents)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p)
    return scored.select(
        "doc_id",
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.col("confidence").between(0.25, 1).alias("in_range"),
        (F.col("confidence") == F.array_max("probabilities")).alias("is_largest"),
    )


@register(
    "training_report",
    f"""
    with n as (select label, count(*) as documents from ({CORPUS}) c group by label),
    total as (select sum(documents) as total_documents, count(*) as classes from n)
    select total_documents, total_documents - ceil(total_documents * {fixed.TEST_SHARE}) as train_samples,
        ceil(total_documents * {fixed.TEST_SHARE}) as test_samples, classes,
        (select string_agg(label || '=' || documents, ',' order by label) from n) as documents_per_class,
        ceil(total_documents * {fixed.TEST_SHARE}) as support, true as agrees
    from total
    """,
)
def training_report(t: Tables) -> DataFrame:
    _, _, report = _trained(t.spark, t.folder)
    counts = F.array_sort(F.map_entries("documents_per_class"))
    figures = F.map_values("per_class")
    support = F.aggregate(figures, F.lit(0).cast("bigint"), lambda n, f: n + f["support"])
    hits = F.aggregate(figures, F.lit(0.0), lambda n, f: n + F.round(f["recall"] * f["support"]))
    return report.select(
        "total_documents",
        "train_samples",
        "test_samples",
        F.size(counts).alias("classes"),
        F.array_join(F.transform(counts, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("documents_per_class"),
        support.alias("support"),
        (F.abs(hits / F.col("test_samples") - F.col("accuracy")) < 1e-4).alias("agrees"),
    )


@register(
    "model_roundtrip",
    f"select count(*) as documents, 0 as different from ({CORPUS}) c",
)
def model_roundtrip(t: Tables) -> DataFrame:
    documents, model, _ = _trained(t.spark, t.folder)
    path = scratch_path(t.spark, "model")
    model.save(t.spark, path)
    again = md.DocumentModel.load(t.spark, path)
    before = model.predict(documents).select("doc_id", "predicted", "confidence")
    after = again.predict(documents).select(
        "doc_id", F.col("predicted").alias("predicted2"), F.col("confidence").alias("confidence2")
    )
    same = (F.col("predicted") == F.col("predicted2")) & (F.col("confidence") == F.col("confidence2"))
    return before.join(after, "doc_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(~same, 1)).alias("different")
    )


_RESULTS = f"""
select cast(c.doc_id as varchar) as file, upper(c.label) as label, 'native_pdf' as ocr_engine,
    {sql.words('c.text')} as word_count, c.text as raw_text, i.true_number as invoice_number,
    case when i.doc_id is not null then {sql.amount('i.true_total_cents')} end as total_amount
from ({CORPUS}) c left join ({INVOICES}) i on i.doc_id = c.doc_id
"""


@register("classify_documents", _RESULTS)
def classify_documents(t: Tables) -> DataFrame:
    documents, model, _ = _trained(t.spark, t.folder)
    named = documents.withColumnRenamed("doc_id", "file")
    found = classify(named, model, LanguageModel.fit(t.documents))
    return found.select(
        "file",
        "label",
        "ocr_engine",
        "word_count",
        "raw_text",
        F.col("invoice_fields.invoice_number").alias("invoice_number"),
        F.col("invoice_fields.total_amount").alias("total_amount"),
    )


# --------------------------------------------------------------------------------------- streaming


@register(
    "stream_classify",
    f"select cast(doc_id as varchar) as file, upper(label) as label, 'ok' as state from ({CORPUS}) c",
)
def stream_classify(t: Tables) -> DataFrame:
    documents, model, _ = _trained(t.spark, t.folder)
    arriving, out, marks = (scratch_path(t.spark, n) for n in ("arriving", "scored", "marks"))
    documents.select(F.col("doc_id").cast("string").alias("file"), "text").write.parquet(arriving)
    docs = stream.read_documents(t.spark, arriving, "file string, text string")
    stream.write_stream(stream.classify_stream(docs, model), out, marks).awaitTermination()
    scored = t.spark.read.parquet(out)
    return scored.select("file", "label", F.coalesce("error", F.lit("ok")).alias("state"))


@register("stream_dedup", "select distinct user_id from {events}")
def stream_dedup(t: Tables) -> DataFrame:
    out, marks = (scratch_path(t.spark, n) for n in ("distinct", "marks"))
    events = stream.read_documents(t.spark, t.folder, t.events.schema, "events.parquet")
    stream.write_unseen(events.select("user_id"), out, marks, "user_id").awaitTermination()
    return t.spark.read.parquet(out).select("user_id")


# The parts of a log, its name with zeros for the moment.
_LOGS = f"""
select '00000000_000000_' || cast(c.doc_id as varchar) || '.txt' as log_name,
    cast(c.doc_id as varchar) as file, 'native_pdf' as engine,
    cast({sql.words('c.text')} as varchar) as words, upper(c.label) as label, i.true_number as invoice_number, c.text
from ({CORPUS}) c left join ({INVOICES}) i on i.doc_id = c.doc_id
"""


@register("stream_log", _LOGS)
def stream_log(t: Tables) -> DataFrame:
    documents, model, _ = _trained(t.spark, t.folder)
    arriving, out, marks = (scratch_path(t.spark, n) for n in ("arriving", "logs", "marks"))
    documents.select(F.col("doc_id").cast("string").alias("file"), "text").write.parquet(arriving)
    docs = stream.read_documents(t.spark, arriving, "file string, text string")
    stream.log_stream(classify(docs, model), out, marks).awaitTermination()
    logs = t.spark.read.parquet(out)
    named = {"file": "File", "engine": "Engine", "words": "Words", "label": "Label", "invoice_number": "  invoice_number"}
    parts = {
        name: F.nullif(F.regexp_extract("log", rf"(?m)^{title} *: (.*)$", 1), F.lit("")) for name, title in named.items()
    }
    head, end = F.lit("=== OCR DEBUG ==="), F.lit("\n=================\n\n")
    body = F.when(F.startswith(F.col("log"), head), F.expr("substring(log, position('\n=================\n\n', log) + 20)"))
    return logs.select(
        F.regexp_replace("log_name", r"\d{8}_\d{6}", "00000000_000000").alias("log_name"),
        *[value.alias(name) for name, value in parts.items()],
        body.alias("text"),
    )
