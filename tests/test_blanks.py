import random
import time

from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions import base


def test_normalise_space_equals_split_and_join(spark):
    rng = random.Random(3)
    pieces = [*base.SPACES, " ", " ", "a", "Bo", "1.", "é", "中", "\U0001f600", "\x00", "\x1b", "\x7f"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 8))) for _ in range(3000)]
    texts += [f"a{c}b" for c in base.SPACES] + [f"{c}a b{c}" for c in base.SPACES] + ["a b", " a b ", "a  b", "", " ", "  "]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in frame.select("id", base.normalise_space("text").alias("v")).collect():
        assert row["v"] == " ".join(texts[row["id"]].split()), repr(texts[row["id"]])


def test_a_line_without_blanks_to_replace_is_not_scanned_by_a_regex(spark):
    lines = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.concat(F.lit("Merchant of the Invoice "), F.col("id"), i))
    rows = spark.range(0, 40_000, 1, 8).select(lines.alias("lines")).persist()
    rows.count()

    def seconds(body):
        best = float("inf")
        for _ in range(3):
            start = time.perf_counter()
            rows.select(F.transform("lines", body)).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        return best

    scanned = f"[[^!-~]&&[{fixed.SPACE_CHARS}]]+"
    regex = seconds(lambda line: F.trim(F.regexp_replace(line, scanned, " ")))
    assert seconds(base.normalise_space) < 0.6 * regex
    rows.unpersist()
