"""Text assembly, counting and clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions.base import (
    SPACE,
    col,
    flags,
    let,
    literal_first,
    normalise_space,
    strip_space,
)

__all__ = [
    "fix_ocr",
    "normalise_space",
    "strip_space",
    "suffix",
    "to_float",
    "word_count",
]


def word_count(text: Column | str) -> Column:
    """Whitespace-separated tokens; null counts as no text."""
    # Parting at single blanks makes no match object per word, which a count of matches does.
    single = F.trim(F.regexp_replace(col(text), f"{SPACE}+", " "))
    return let(single, lambda words: F.when(words != "", F.size(F.split(words, " "))).otherwise(0))


def is_blank(text: Column | str) -> Column:
    return F.coalesce(strip_space(col(text)), F.lit("")) == ""


def suffix(path: Column | str) -> Column:
    """Lower-case suffix of the last path component, '' without one.

    A leading dot makes a hidden file, not a suffix, and a trailing dot has none either.
    """
    return F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]+)$", 1))


def fix_ocr(text: Column | str) -> Column:
    """The ordered OCR corrections."""
    out = col(text)
    for position, (pattern, replacement) in enumerate(fixed.OCR_FIXES):
        if len(pattern) == 1:
            out = F.replace(out, F.lit(pattern), F.lit(replacement))
        else:
            out = F.regexp_replace(out, flags(literal_first(pattern)), replacement)
    return out


def to_float(value: Column | str) -> Column:
    """``1,234.56`` or ``1.234,56`` to double; null where it is no number."""
    # The cast alone would also read suffixes such as "1d"; the shape is therefore checked first.
    number = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"

    def plain(text: Column) -> Column:
        european = text.rlike(fixed.EUROPEAN_NUMBER)
        return F.when(european, F.translate(text, ",.", ".")).otherwise(
            F.replace(text, F.lit(","), F.lit(""))
        )

    def parse(text: Column) -> Column:
        return F.when(
            text.rlike(number), F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
        )

    return let(strip_space(value), lambda text: let(plain(text), parse))
