"""What the model queries write, and the recount of the search."""

import pytest
from pyspark.sql import functions as F

from foliospark.plans import check_model, train


def _recorded(monkeypatch, module):
    calls, write = [], module.materialise

    def spy(frame, name, even=False):
        calls.append((name, even))
        return write(frame, name, even)

    monkeypatch.setattr(module, "materialise", spy)
    return calls


def _documents(spark, rows=240):
    words = ["invoice total due", "dear regards subject", "please tick scale", "experience skills education"]
    data = [(i, f"{words[i % 4]} n{i % 7}x", "abcd"[i % 4]) for i in range(rows)]
    return spark.createDataFrame(data, "doc_id bigint, text string, label string")


def test_vectors_take_the_texts_apart_once_and_keep_their_rows(spark, monkeypatch):
    docs = _documents(spark)
    monkeypatch.setattr(check_model, "corpus", lambda t: docs)
    calls = _recorded(monkeypatch, check_model)
    frame = check_model._vectors(spark, "words-and-heads")
    assert calls == [("corpus", True), ("folds", True)]
    assert frame.columns == ["doc_id", "label", "label_index", "features", "fold"]
    assert frame.groupBy("label", "fold").count().where("count != 12").count() == 0 and frame.count() == 240


def test_held_out_margins_are_not_dealt_out_by_size(spark, monkeypatch):
    calls = _recorded(monkeypatch, train)
    model, _ = train.train(_documents(spark, 80), c_grid=[1.0])
    assert ("held-out-margins", True) in calls
    assert len(model.sigmoids) == 4


def test_recount_follows_the_weights(spark, monkeypatch):
    docs = _documents(spark).withColumn("label", F.when(F.col("doc_id") % 10 == 3, "a").otherwise(F.col("label")))
    monkeypatch.setattr(check_model, "corpus", lambda t: docs)
    frame = check_model._vectors(spark, "words-and-heads-recount")
    js = check_model.joint_svm
    fit = js.solve(frame, js.search_problems([0.1, 1.0], check_model.FOLDS, 4, refit=False), js.width_of(frame))
    scores = js.held_out_accuracy(frame, fit, [0.1, 1.0], check_model.FOLDS)
    assert check_model._recounted(frame, fit, check_model.FOLDS) == pytest.approx(scores, abs=1e-12)
    assert min(scores.values()) < 1
