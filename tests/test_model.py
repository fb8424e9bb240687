"""Training, scoring, persistence and streams on a small corpus with clear classes."""

import datetime
import math

import pytest
from pyspark.errors import AnalysisException
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from foliospark.operators import model as md
from foliospark.operators.features import FeatureModel, prepared
from foliospark.operators.imaging import page_quality
from foliospark.operators.language import LanguageModel
from foliospark.plans.classify import classify, split_unreadable
from foliospark.plans.train import train
from foliospark.streaming import documents as stream

WORDS = {
    "Invoice": "invoice total amount due tax payment vendor balance $",
    "Email": "dear regards subject: forwarded meeting reply attached from: @example.com",
    "Questionnaire": "please tick rate scale [ ] strongly agree survey answer",
    "Resume": "experience education skills university degree employment objective",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows, at = [], 0
    for label, words in WORDS.items():
        pool = words.split()
        for i in range(30):
            picked = [pool[(i * 3 + j * (1 + i % 2)) % len(pool)] for j in range(6)]
            rows.append((at, label, " ".join(picked) + " the document of today"))
            at += 1
    return spark.createDataFrame(rows, "doc_id bigint, label string, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def trained(docs):
    return train(docs, c_grid=(0.1, 1.0), max_folds=2, max_iter=10)


def test_report(trained):
    _, report = trained
    row = report.first()
    assert (row["total_documents"], row["train_samples"], row["test_samples"]) == (120, 96, 24)
    assert row["accuracy"] >= 0.95 and row["cv_accuracy"] >= 0.95 and row["best_C"] in (0.1, 1.0)
    assert row["documents_per_class"] == dict.fromkeys(WORDS, 30)
    assert {k: v["support"] for k, v in row["per_class"].items()} == dict.fromkeys(WORDS, 6)


def test_scores_are_ranked_probabilities(trained, docs):
    model, _ = trained
    for row in model.predict(docs).collect():
        shares = [s["confidence"] for s in row["all_scores"]]
        assert shares == sorted(shares, reverse=True)
        assert math.isclose(sum(shares), 1.0, abs_tol=1e-9) and all(0 <= s <= 1 for s in shares)
        assert row["confidence"] == shares[0]
        assert row["predicted"] == row["label"]


def test_saved_model_predicts_the_same(spark, trained, docs, tmp_path):
    model, _ = trained
    model.save(spark, str(tmp_path / "model"))
    again = md.DocumentModel.load(spark, str(tmp_path / "model"))
    pick = ["doc_id", "predicted", "confidence"]
    assert sorted(model.predict(docs).select(pick).collect()) == sorted(
        again.predict(docs).select(pick).collect()
    )
    with pytest.raises(FileNotFoundError):
        md.DocumentModel.load(spark, str(tmp_path / "missing"))
    parts = {name: spark.read.parquet(str(tmp_path / "model" / name)) for name in ("vocabulary", "classes")}
    for name, rows in parts.items():
        rows.write.parquet(str(tmp_path / "old" / name))
    with pytest.raises(AnalysisException):
        md.DocumentModel.load(spark, str(tmp_path / "old"))
    assert set(md.DocumentModel.load(spark, str(tmp_path / "old"), unscaled=True).features.max_abs) == {1.0}


def test_guards(spark):
    schema = "doc_id int, label string, text string"
    with pytest.raises(ValueError):
        train(spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "b", " ")], schema))
    with pytest.raises(ValueError):
        train(spark.createDataFrame([(i, "a", "x") for i in range(5)], schema))
    many = spark.range(10_001).select("id", F.col("id").cast("string").alias("label"), F.lit("x").alias("text"))
    with pytest.raises(ValueError, match="more than 10000 classes"):
        train(many.withColumnRenamed("id", "doc_id"))


def test_single_row_class_is_fitted_without_a_split(spark, docs):
    odd = spark.createDataFrame([(999, "Other", "zebra zebra zebra")], docs.schema)
    _, report = train(docs.union(odd), max_folds=2, max_iter=4)
    row = report.first()
    assert math.isnan(row["accuracy"]) and row["test_samples"] == 0 and row["best_C"] is None


def test_features_of_the_train_part_only(docs):
    rare = F.when(F.col("doc_id") == 0, F.concat("text", F.lit(" onlyhere onlyhere"))).otherwise(F.col("text"))
    model, report = train(docs.withColumn("text", rare), grid=False, leak_free=True, max_folds=2, max_iter=10)
    row = report.first()
    assert row["accuracy"] >= 0.9 and row["test_samples"] == 24 and row["converged"] is not None
    assert "total" in model.features.vocabulary


def test_a_fit_tells_whether_it_converged(spark):
    rows = [(Vectors.dense([x]), float(x > 0)) for x in (-3.0, -2.0, -1.0, 1.0, 2.0, 3.0)]
    frame = spark.createDataFrame(rows, ["features", "label_index"])
    assert not md.fit_svm(frame, 1.0, max_iter=1).converged
    fit = md.fit_svm(frame, 10.0)
    # Squared hinge: by symmetry no offset; only x = -1 and 1 are inside the margin, so
    # f(w) = w^2 / 2 + 10 * 2 * (1 - w)^2 is least at w = 40 / 41.
    assert fit.converged and abs(fit.weights[1][0] - 40 / 41) < 1e-4 and abs(fit.intercepts[1]) < 1e-4


def test_features_do_not_depend_on_partitions(docs):
    one = FeatureModel.fit(docs.coalesce(1))
    many = FeatureModel.fit(docs.repartition(8))
    assert one == many
    left = sorted((r["doc_id"], r["features"]) for r in one.vectors(docs.coalesce(1)).collect())
    right = sorted((r["doc_id"], r["features"]) for r in many.vectors(docs.repartition(8)).collect())
    assert [str(v) for v in left] == [str(v) for v in right]


def test_empty_vocabulary_leaves_the_structural_block(spark):
    frame = spark.createDataFrame([(1, "total $5"), (2, "dear you")], "doc_id int, text string")
    model = FeatureModel.fit(frame)
    assert model.vocabulary == [] and model.width == 20
    assert [r["features"].size for r in model.vectors(frame).collect()] == [20, 20]


def test_scaling_of_unseen_documents_may_exceed_one(spark):
    fitted = FeatureModel.fit(spark.createDataFrame([(1, "total")], "doc_id int, text string"))
    more = spark.createDataFrame([(1, "total total total")], "doc_id int, text string")
    assert max(fitted.vectors(more).first()["features"].toArray()) == 2.0


def test_classify_has_no_shuffle_and_no_python(spark, trained, docs):
    import io
    from contextlib import redirect_stdout

    model, _ = trained
    languages = LanguageModel(["en", "fr"], ["the", "le "], [[-1.0, -3.0], [-3.0, -1.0]])
    fresh = spark.createDataFrame([("f", "x")], "file string, text string")
    frame = classify(fresh, model, languages)
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain()
    assert "Exchange" not in out.getvalue() and "EvalPython" not in out.getvalue()


def test_language_model(spark):
    rows = [("en", "the house and the garden are there"), ("fr", "les maisons et les jardins sont la")]
    model = LanguageModel.fit(spark.createDataFrame(rows * 3, "lang string, text string"))
    asked = [("the garden and the house are here with the other", "en"), ("les", "unknown")]
    asked += [("les jardins et les maisons sont dans la rue du nord", "fr"), ("1 " * 12, "unknown")]
    frame = spark.createDataFrame(asked, "text string, want string")
    assert all(r["detected_language"] == r["want"] for r in model.detect(frame).collect())


def test_unreadable_documents_become_error_rows(spark, trained, tmp_path):
    model, _ = trained
    rows = [("a", "invoice total amount due"), ("b", None), ("c", "  \n")]
    frame = spark.createDataFrame(rows, "file string, text string")
    good, bad = split_unreadable(frame)
    assert good.count() == 1 and bad.count() == 2
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    docs = stream.read_documents(spark, str(tmp_path / "in"), "file string, text string")
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    stream.write_stream(stream.classify_stream(docs, model), out, marks).awaitTermination()
    found = {r["file"]: r for r in spark.read.parquet(out).collect()}
    assert found["a"]["label"] == "INVOICE" and found["a"]["error"] is None
    assert found["b"]["label"] is None and found["b"]["error"] and found["c"]["error"]
    # Files seen before are not processed again.
    stream.write_stream(stream.classify_stream(docs, model), out, marks).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_keys_seen_before_are_dropped(spark, tmp_path):
    """Whatever the time of a row and of the key's last appearance, and by whichever source and run."""
    table, timings = str(tmp_path / "out"), str(tmp_path / "timings")
    schema = "path string, day date"

    def arrive(source, rows):
        frame = spark.createDataFrame([(p, datetime.date.fromisoformat(d)) for p, d in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / source))
        docs = stream.read_documents(spark, str(tmp_path / source), schema, files_per_trigger=1)
        stream.write_unseen(docs, table, str(tmp_path / f"marks-{source}"), timings=timings).awaitTermination()
        return sorted((r["path"] or "", str(r["day"])) for r in spark.read.parquet(table).collect())

    assert arrive("one", [("a", "2024-05-01"), ("a", "2024-05-01"), ("b", "2024-05-02")]) == [("a", "2024-05-01"), ("b", "2024-05-02")]
    assert len(arrive("one", [("old", "2001-01-01"), ("a", "2025-01-01"), (None, "2024-01-01")])) == 4
    assert len(arrive("two", [("b", "2030-01-01"), ("c", "1999-01-01"), (None, "2024-01-01")])) == 5
    found = stream.batch_timings(spark, timings).collect()
    assert sorted(r["input_rows"] for r in found) == [3, 3] and all(r["elapsed_ms"] > 0 for r in found)


def test_page_measurements(spark):
    def image(name, rows, channels=3):
        data = bytes(level for level in rows for _ in range(10 * channels))
        return ((name, len(rows), 10, channels, 16, data),)

    images = [
        image("white", [255] * 25),
        image("black", [0] * 25),
        image("dark", [90] * 25),
        image("header", [50] * 5 + [240] * 20),
        image("gray", [128] * 25, 1),
    ]
    schema = (
        "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    )
    found = {r["origin"]: r for r in page_quality(spark.createDataFrame(images, schema)).collect()}
    assert "near-white" in found["white"]["error"] and "black" in found["black"]["error"]
    assert found["dark"]["dark_page"] and found["dark"]["dark_bands"] == 0
    assert found["header"]["dark_bands"] == 2 and not found["header"]["dark_page"]
    assert found["gray"]["error"] is None and found["gray"]["mean_level"] == 128


def test_texts_taken_apart_before_give_the_same_model_and_scores(docs):
    apart = prepared(docs, keep_text=True)
    model, _ = train(docs, grid=False, max_folds=2)
    # no text is needed where its terms are there
    again, _ = train(apart.withColumn("text", F.lit("x")), grid=False, max_folds=2)
    assert again.features == model.features
    assert again.svm.weights == [pytest.approx(w, abs=1e-9) for w in model.svm.weights]
    wanted = {r["doc_id"]: r["predicted"] for r in model.predict(docs).collect()}
    got = {r["doc_id"]: r["predicted"] for r in model.predict(apart.drop("text")).collect()}
    assert got == wanted
