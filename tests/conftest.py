import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(__file__)]

from foliospark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture
def value(spark):
    """Evaluate an expression of one text column for a single text."""

    def run(expression, text):
        frame = spark.createDataFrame([(text,)], "text string")
        result = frame.select(expression("text").alias("v")).first()["v"]
        return result

    return run
