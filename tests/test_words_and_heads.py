"""Word counts and the first-character test of patterns."""

import re

import pytest
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions.base import SPACES, flags
from foliospark.functions.text import word_count

TEXTS = ["", " ", "one", " one\ttwo\n\nthree ", f"a{SPACES}b", "a\u200bb c", "\U0001f600 x\u00a0y", SPACES, "a" * 50 + "  b", None]


def test_word_count_equals_split(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    counted = frame.select("id", word_count("text").alias("n"))
    assert [r["n"] for r in counted.orderBy("id").collect()] == [len((t or "").split()) for t in TEXTS]
    # no match object per word
    assert "regexp_extract_all" not in counted._jdf.queryExecution().optimizedPlan().toString()


ODD = ["\u0131nvo\u0130ce", "\u017fold to", "\u017feller", "ship to", "Bill\nTo", "bank\u212a", "xfrom y", "INV", "ref", "", "\u00e9due"]


@pytest.mark.parametrize("pattern", [fixed.ISSUER_LABEL, fixed.RECIPIENT_LABEL, fixed.TAX, r"\b(kilo|stone|ice)|\$x", *fixed.DUE_DATE_LABELS])
def test_first_character_test_changes_no_match(spark, pattern):
    pattern = f"{pattern}|{fixed.ISSUER_LABEL}|kind|due"
    texts = ODD + [o + w for o in ODD for w in ("from", "\u212aind", "KIND", "\u017felleR", "tax", "$x", "due by")]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.regexp_extract_all("text", F.lit(f"(?iUd){pattern}"), F.lit(0))
    headed = F.regexp_extract_all("text", F.lit(flags(pattern, "i")), F.lit(0))
    assert flags(pattern, "i").startswith("(?iUd)(?-i:(?=[")
    assert frame.where(~plain.eqNullSafe(headed)).count() == 0


def test_patterns_without_alternatives_or_known_first_letters_stay():
    for pattern in (r"total", r"\d+|a", r"(?:a|b)?c", r"^x|^y", r"\s*a|b", r"é|a"):
        assert flags(pattern) == f"(?Ud){pattern}"
    assert re.fullmatch(r"\(\?Ud\)\(\?-i:\(\?=\[ab\]\)\)\(\?:.*\)", flags("a|b"))
