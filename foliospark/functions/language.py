"""Language codes and character trigrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions.base import col


def language_name(code: Column | str) -> Column:
    """Name of a language, the upper-case code where it is not listed."""
    names = F.create_map(*[F.lit(v) for pair in fixed.LANGUAGE_NAMES.items() for v in pair])
    return F.coalesce(F.try_element_at(names, col(code)), F.upper(col(code)))


def is_non_english(code: Column | str) -> Column:
    return ~col(code).isin(fixed.TRUSTED_LANGUAGES)


def trigrams(text: Column | str) -> Column:
    """Overlapping three-character pieces of the lower-cased letters, words set apart by one blank.

    The look-ahead captures a piece at every position, in one pass over the text.
    """
    letters = F.regexp_replace(F.lower(col(text)), r"[^\p{L}]+", " ")
    padded = F.concat(F.lit(" "), F.trim(letters), F.lit(" "))
    return F.regexp_extract_all(padded, F.lit("(?s)(?=(...))"), F.lit(1))
