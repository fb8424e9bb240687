"""Every registered query with SQL gives the rows of that SQL."""

import pytest
from comparing import FOLDER, connect, difference, plain

from foliospark.plans import registry

# These train models; test_model.py covers them on smaller input.
TRAINING = {
    "fit_svm", "predict", "model_roundtrip", "classify_documents", "stream_classify", "stream_log",
    "grid_search", "calibrate", "predict_confidence", "training_report",
}
NAMES = sorted(set(registry.oracle_sql()) - TRAINING)


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()
    assert len(want) > 0
    empty = [c for c in want if all(v is None or v == "" or v != v for v in map(plain, want[c]))]
    assert not empty, f"nothing to compare in {empty}"
    assert difference(got, want) is None


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
