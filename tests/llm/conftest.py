import pytest


@pytest.fixture
def frame(spark):
    """Rows of ``(doc_id, text)`` or with more columns as a DataFrame."""

    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make
