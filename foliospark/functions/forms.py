"""Questionnaire fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions.base import all_groups, by_line, col, flags, let, strip_space


def _first_spellings(values: Column) -> Column:
    """Drop repeats that differ in case only; first spelling and order stay.  O(n log n) per row."""
    keyed = F.transform(
        values,
        lambda v, i: F.struct(F.lower(v).alias("key"), i.alias("at"), v.alias("value")),
    )

    def firsts(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda v, i: (i == 0) | (v["key"] != F.get(ordered, i - 1)["key"]),
        )

    kept = let(F.sort_array(keyed), firsts)
    in_place = F.sort_array(F.transform(kept, lambda v: F.struct(v["at"], v["value"])))
    return F.transform(in_place, lambda v: v["value"])


def questions(text: Column | str) -> Column:
    """Lines that end in a question mark, then numbered prompts."""
    # The blank before a lone question mark belongs to the question, so the blanks must be given back;
    # asking for a question mark on the line first keeps that from being tried in vain.
    asked = fixed.QUESTION_LINE.replace(r"^\s*", r"^(?=[^\n]*\?)[^\S\n]*").replace(r"\s*$", r"[^\S\n]*+$")
    found = F.concat(
        all_groups(col(text), flags(asked, "m"), 1),
        all_groups(col(text), flags(by_line(_linear_tail(fixed.NUMBERED_LINE)), "m"), 1),
    )
    return _first_spellings(F.filter(F.transform(found, strip_space), lambda q: q != ""))


def _linear_tail(pattern: str) -> str:
    r"""The pattern with its last group ``(.+?)\s*$`` taken in one pass.

    The lazy group stops at the last non-blank character of the line, or takes one blank where the line
    holds no other; ``(.*\S|(?=\s).)`` finds the same end without trying ``\s*$`` again from every
    character, so a long run of blanks inside the group costs its length once.
    """
    tail = r"(.+?)\s*$"
    assert pattern.endswith(tail), pattern
    return pattern[: -len(tail)] + r"(.*\S|(?=\s).)\s*$"


def _pairs(text: Column | str, pattern: str, left: str, right: str) -> Column:
    return F.zip_with(
        all_groups(col(text), pattern, 1),
        all_groups(col(text), pattern, 2),
        lambda a, b: F.struct(a.alias(left), b.alias(right)),
    )


def checkboxes(text: Column | str) -> Column:
    """Tick boxes with their labels."""
    found = _pairs(text, flags(by_line(_linear_tail(fixed.CHECKBOX_LINE)), "im"), "box", "label")
    return F.transform(
        found,
        lambda item: F.struct(
            strip_space(item["label"]).alias("label"),
            F.lower(item["box"]).contains("x").alias("checked"),
        ),
    )


def key_values(text: Column | str) -> Column:
    """``key : value`` or ``key - value`` lines."""
    found = _pairs(text, flags(by_line(_linear_tail(fixed.KEY_VALUE_LINE)), "m"), "question", "answer")
    cleaned = F.transform(
        found,
        lambda item: F.struct(
            strip_space(item["question"]).alias("question"),
            strip_space(item["answer"]).alias("answer"),
        ),
    )
    return F.filter(cleaned, lambda item: (item["question"] != "") & (item["answer"] != ""))


def form_fields(text: Column | str) -> Column:
    return F.struct(
        questions(text).alias("questions"),
        checkboxes(text).alias("checkboxes"),
        key_values(text).alias("key_values"),
    )
