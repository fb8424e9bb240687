"""Resume fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions.base import (
    all_groups,
    col,
    first_group,
    first_of,
    flags,
    let,
    split_lines,
    strip_space,
)
from foliospark.functions.mail import ADDRESS


def first_email(text: Column | str) -> Column:
    return first_group(col(text), ADDRESS, 0)


def phone(text: Column | str) -> Column:
    """First run that looks like a phone number."""
    found = first_group(col(text), flags(fixed.PHONE), 0)
    return strip_space(found)


def links(text: Column | str) -> Column:
    return all_groups(col(text), flags(fixed.LINK, "i"))


def candidate_name(text: Column | str) -> Column:
    """First line that is neither contact data, nor a heading, nor too long."""

    def is_name(line: Column) -> Column:
        heading = F.lit(False)
        for word in fixed.NAME_HEADINGS:
            heading = heading | F.startswith(F.lower(line), F.lit(word))
        return (
            F.length(line).between(1, fixed.NAME_LIMIT)
            & ~F.contains(line, F.lit("@"))
            & ~line.rlike(flags(fixed.NAME_DIGITS))
            & ~heading
        )

    return first_of(F.filter(F.transform(split_lines(col(text)), strip_space), is_name))


def sections(text: Column | str) -> Column:
    """Map from heading to the text below it; of repeated headings the last with a body counts.

    Splitting at the headings and listing them go through the same matches, so the n-th heading
    belongs to piece n+1: no exploding and no shuffle.
    """
    # A mark may stand lines below its heading; else the heading ends with its line.  Blank lines around
    # it are stripped from the bodies.
    line_end = r"[^\S\n]*+$"
    heading = rf"^[^\S\n]*+({'|'.join(fixed.RESUME_HEADINGS)})(?:\s*+[:\-]{line_end}|{line_end})"
    pattern = flags(heading, "im")
    titles = F.transform(all_groups(col(text), pattern, 1), lambda t: F.upper(strip_space(t)))
    pieces = F.split(col(text), pattern)
    bodies = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), strip_space)
    entries = F.filter(
        F.zip_with(titles, bodies, lambda t, b: F.struct(t.alias("key"), b.alias("value"))),
        lambda e: e["value"] != "",
    )

    def last_of_each(found: Column) -> Column:
        known = F.array(*[F.lit(h.upper()) for h in fixed.RESUME_HEADINGS])
        latest = F.transform(
            known,
            lambda h: F.try_element_at(F.filter(found, lambda e: e["key"] == h), F.lit(-1)),
        )
        return F.map_from_entries(F.filter(latest, lambda e: e.isNotNull()))

    return let(entries, last_of_each)


def resume_fields(text: Column | str) -> Column:
    return F.struct(
        candidate_name(text).alias("name"),
        first_email(text).alias("email"),
        phone(text).alias("phone"),
        links(text).alias("links"),
        sections(text).alias("sections"),
    )
