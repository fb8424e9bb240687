"""Small helpers that every column function shares."""

from __future__ import annotations

import re
from re import _parser as sre
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark import fixed

# Only ranges below U+10000: a negated range takes every code point and makes the search go by surrogates.
SPACE = f"[{fixed.SPACE_CHARS}]"
# Printable ASCII is decided by the first range; the long list of blanks is read for the rest only.
NOT_SPACE = f"[!-~[^{fixed.SPACE_CHARS}]]"
LINE_CHAR = f"[ -~[^{fixed.LINE_END_CHARS}]]"
SPACES = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
LINE_END = rf"\r\n|[{fixed.LINE_END_CHARS}]"


def flags(pattern: str, extra: str = "") -> str:
    """Give a pattern Python's reading of classes, boundaries and line ends.

    ``U``: Unicode classes and case folding; ``d``: only ``\\n`` ends a line; ``extra``: ``i``, ``m``.
    """
    return f"(?{extra}Ud){_headed(pattern, 'i' in extra)}"


# Characters beside the two cases of a letter that case-insensitive matching takes for it.
_ODD_CASES = {"i": "\u0131\u0130", "s": "\u017f", "k": "\u212a"}


def _first_letters(parsed) -> set[str] | None:
    """The ASCII characters that a match can begin with; None where it may begin with others or be empty."""
    for kind, value in parsed:
        name = str(kind)
        if name == "AT" and str(value) == "AT_BOUNDARY":
            continue  # stands before the first character
        if name == "LITERAL":
            return {chr(value)} if value < 128 else None
        if name == "IN":
            plain = all(str(k) == "LITERAL" and v < 128 for k, v in value)
            return {chr(v) for _, v in value} if plain else None
        if name == "SUBPATTERN":
            return _first_letters(value[3])
        if name == "BRANCH":
            parts = [_first_letters(part) for part in value[1]]
            return None if None in parts else set().union(*parts)
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            return _first_letters(value[2])
        return None
    return None


def _headed(pattern: str, ignore_case: bool) -> str:
    """Test the first character of a match ahead of several alternatives.

    One look at a small class passes over most places of a text where the alternatives would be tried
    one by one; the matches are the same.
    """
    try:
        letters = _first_letters(sre.parse(pattern))
    except re.error:  # a form that only Java reads
        return pattern
    if letters is None or len(letters) == 1:
        return pattern
    if ignore_case:
        letters = {c for letter in letters for c in letter.lower() + letter.upper() + _ODD_CASES.get(letter.lower(), "")}
    ahead = "".join(c if c.isalnum() else "\\" + c for c in sorted(letters))
    return f"(?-i:(?=[{ahead}]))(?:{pattern})"


def steady(pattern: str) -> str:
    """Make whitespace runs possessive, which keeps a long run of blanks from costing O(n^4).

    Only for patterns in which the first part after the runs that must match cannot start with
    whitespace: giving characters back could then never lead to another match.
    """
    for run in (r"\s*", r"[\s\-]*", r"[:\s]*"):
        pattern = pattern.replace(run, run + "+")
    return pattern


def by_line(pattern: str) -> str:
    r"""Let a match begin on its own line, not on blank lines before it.

    ``^\s*`` would scan a run of blank lines again from each of them.  Only for patterns in which what
    follows cannot start with whitespace.
    """
    return pattern.replace(r"^\s*", r"^[^\S\n]*+")


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between the bars outside of brackets."""
    parts, depth = [""], 0
    for piece in re.findall(r"\\.|\[(?:\\.|[^\]])*\]|.", pattern, re.S):
        depth += (piece == "(") - (piece == ")")
        if piece == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += piece
    return parts


def literal_first(pattern: str) -> str:
    """Move the look-behind or boundary at the head of each alternative behind the literal after it.

    ``(?<=[a-z])rn`` and ``rn(?<=[a-z]rn)`` match the same places, but the second only looks back where
    the literal stands, not at every character.
    """
    head = r"(?:\(\?<([=!])((?:\[[^\]]*\]|\\d))\)|(\\b))((?:\\\||\w)+)"

    def turn(found: re.Match) -> str:
        kind, before, boundary, literal = found.groups()
        return f"{literal}(?<{kind or '='}{before or boundary}{literal})"

    return "|".join(re.sub("^" + head, turn, part) for part in _alternatives(pattern))


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def null_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once per row and use it many times inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_space(value: Column | str) -> Column:
    """Remove whitespace of every kind at both ends (plain ``trim`` removes blanks only)."""
    return F.trim(col(value), F.lit(SPACES))


def normalise_space(value: Column | str) -> Column:
    """Every whitespace run becomes one blank, none at the ends; null becomes ''.

    ASCII without control blanks and double blanks, as most lines are, has nothing to replace: plain
    searches tell that in a fraction of a regex scan.
    """

    def single(filled: Column) -> Column:
        runs = (F.octet_length(filled) != F.length(filled)) | F.contains(filled, F.lit("  "))
        for blank in SPACES:
            if blank.isascii() and blank != " ":
                runs = runs | F.contains(filled, F.lit(blank))
        return F.trim(F.when(runs, F.regexp_replace(filled, f"{SPACE}+", " ")).otherwise(filled))

    return let(F.coalesce(col(value), F.lit("")), single)


def split_lines(value: Column) -> Column:
    return F.split(value, LINE_END)


def first_group(value: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return null_if_empty(F.regexp_extract(value, pattern, group))


def all_groups(value: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(group))


def count_matches(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern))


def first_of(values: Column) -> Column:
    return F.get(values, F.lit(0))


def text_in(value: Column, words: Sequence[str]) -> Column:
    return value.isin(list(words))


def constant_doubles(values: Sequence[float]) -> Column:
    """A constant array of doubles as one foldable literal (``array(lit, lit, ...)`` with thousands
    of children takes seconds to analyse)."""
    if not len(values):
        return F.array().cast("array<double>")
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def constant_strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def python_round(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even, as Python's ``round`` does.

    ``bround`` rounds the shortest decimal form instead and differs where that form is a tie.
    """
    return F.call_function("format_number", value, F.lit("0." + "0" * digits)).cast("double")
