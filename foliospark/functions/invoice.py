"""Invoice fields as expressions over one text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions.base import (
    LINE_CHAR,
    NOT_SPACE,
    SPACE,
    all_groups,
    col,
    first_group,
    first_of,
    flags,
    let,
    normalise_space,
    null_if_empty,
    split_lines,
    steady,
)
from foliospark.functions.text import to_float

def invoice_number(text: Column | str, strict: bool = False) -> Column:
    """First acceptable identifier over five patterns, tried in order, first match of each.

    The third and fourth pattern also match inside words ("References" gives "erences").  With
    ``strict`` every pattern must start at a word boundary.
    """
    def accept(found: Column) -> Column:
        return F.when((F.length(found) >= 2) & ~found.rlike(flags(r"^\d{1,2}$")), found)

    tries = []
    for pattern in fixed.INVOICE_NUMBERS:
        ignore_case = pattern.startswith("(?i)")
        body = steady(pattern.removeprefix("(?i)"))
        if strict:
            body = r"\b" + body
        found = F.regexp_extract(col(text), flags(body, "i" if ignore_case else ""), 1)
        tries.append(let(F.rtrim(found, F.lit(".")), accept))
    return F.coalesce(*tries)


def all_dates(text: Column | str) -> Column:
    """Every date as written, blanks normalised, first occurrence of each kept in order."""
    found = all_groups(col(text), flags(fixed.DATE, "i"))
    return F.array_distinct(F.transform(found, normalise_space))


def _labelled_date(text: Column | str, labels: list[str]) -> Column:
    pattern = rf"(?:{'|'.join(labels)})\s*[:\-]?\s*(?:\n\s*)?"
    found = F.regexp_extract(col(text), flags(steady(pattern) + f"({fixed.DATE})", "i"), 1)
    return null_if_empty(normalise_space(found))


def invoice_date(text: Column | str) -> Column:
    """Date right after an invoice-date label."""
    return _labelled_date(text, fixed.INVOICE_DATE_LABELS)


def due_date(text: Column | str) -> Column:
    """Date right after a due-date label."""
    return _labelled_date(text, fixed.DUE_DATE_LABELS)


def total_amount(text: Column | str) -> Column:
    """Amount after the most specific total label that has one, as written but without blanks."""
    tries = []
    for label in fixed.TOTAL_LABELS:
        lead = rf"{label}\s*[:\-]?\s*{fixed.CURRENCY}?\s*{fixed.CURRENCY}?\s*"
        raw = first_group(col(text), flags(steady(lead) + fixed.TOTAL_AMOUNT, "i"))
        tries.append(F.rtrim(F.regexp_replace(raw, f"{SPACE}+", ""), F.lit(".")))
    return F.coalesce(*tries)


def format_amount(value: Column) -> Column:
    """Thousands separators and two decimals."""
    return F.format_number(value, 2)


def math_check(text: Column | str, total: Column) -> Column:
    """Whether subtotal + tax is the total; null ("N/A") unless all three are there and not zero."""
    parts = F.struct(
        to_float(F.regexp_extract(col(text), flags(steady(fixed.SUBTOTAL), "i"), 1)).alias("net"),
        to_float(F.regexp_extract(col(text), flags(steady(fixed.TAX), "i"), 1)).alias("tax"),
    )

    def check(part: Column) -> Column:
        known = (part["net"] != 0) & (part["tax"] != 0) & total.isNotNull()
        return F.when(known, F.abs(part["net"] + part["tax"] - total) < fixed.MATH_TOLERANCE)

    return let(parts, check)


def _first_name(lines: Column, skip: str, number_line: str) -> Column:
    """First line that is long and short enough and reads like a name."""

    def is_name(line: Column) -> Column:
        return (
            F.length(line).between(fixed.NAME_MIN, fixed.NAME_MAX)
            & ~line.rlike(flags(skip, "i"))
            & ~line.rlike(flags(f"^{number_line}$"))
        )

    return first_of(F.filter(F.transform(lines, normalise_space), is_name))


def name_from_snippet(snippet: Column) -> Column:
    """First name-like line of a piece of text that follows a party label."""

    def search(lines: Column) -> Column:
        # Mostly one of the first two lines is the name; the rest is only read when neither is.
        near = F.slice(lines, F.lit(1), F.lit(2))
        return F.coalesce(
            _first_name(near, fixed.SNIPPET_SKIP, fixed.SNIPPET_NUMBER_LINE),
            _first_name(lines, fixed.SNIPPET_SKIP, fixed.SNIPPET_NUMBER_LINE),
        )

    return let(split_lines(snippet), search)


def _party(text: Column | str, label: str) -> Column:
    snippet = F.regexp_extract(
        col(text), flags(rf"{label}([\s\S]{{0,{fixed.SNIPPET_CHARS}}})", "i"), 1
    )
    return name_from_snippet(snippet)


def recipient(text: Column | str) -> Column:
    """Name after the first bill-to label."""
    return _party(text, fixed.RECIPIENT_LABEL)


def issuer_from_top(text: Column | str) -> Column:
    """First name-like line among the top non-empty lines."""

    def within(count: int) -> Column:
        # Only the head that holds these lines is cut out before it is split.
        head = rf"^((?:{SPACE}*+{NOT_SPACE}{LINE_CHAR}*+){{0,{count}}})"
        lines = split_lines(F.regexp_extract(col(text), head, 1))
        return _first_name(lines, fixed.TOP_SKIP, fixed.TOP_NUMBER_LINE)

    # The answer is mostly in the first lines; the others are only read when it is not.
    return F.coalesce(within(2), within(fixed.TOP_LINES))


def issuer(text: Column | str) -> Column:
    """Name after the first issuer label, else from the top of the document."""
    return F.coalesce(_party(text, fixed.ISSUER_LABEL), issuer_from_top(text))


def total_value(text: Column | str, spatial_total: Column | None = None) -> Column:
    """The total as a number: the one found by position when given, else the one in the text."""
    from_text = to_float(total_amount(text))
    return from_text if spatial_total is None else F.coalesce(spatial_total, from_text)


def dates_with_fallback(text: Column | str) -> Column:
    """Labelled invoice and due date; the first and second date of the text where a label lacks.

    The list of all dates is only built for rows that need it.
    """
    labelled = F.struct(invoice_date(text).alias("issued"), due_date(text).alias("due"))

    def complete(found: Column) -> Column:
        missing = found["issued"].isNull() | found["due"].isNull()
        return let(
            F.when(missing, all_dates(text)),
            lambda dates: F.struct(
                F.coalesce(found["issued"], F.get(dates, F.lit(0))).alias("issued"),
                F.coalesce(found["due"], F.get(dates, F.lit(1))).alias("due"),
            ),
        )

    return let(labelled, complete)


def amounts_with_check(text: Column | str, spatial_total: Column | None = None) -> Column:
    """Formatted total and the result of the sum check."""
    return let(
        total_value(text, spatial_total),
        lambda total: F.struct(
            format_amount(total).alias("total"), math_check(text, total).alias("passed")
        ),
    )


def invoice_fields(text: Column | str, spatial_total: Column | None = None) -> Column:
    """All seven fields as one struct."""
    parts = F.struct(
        dates_with_fallback(text).alias("dates"),
        amounts_with_check(text, spatial_total).alias("amounts"),
    )
    return let(
        parts,
        lambda part: F.struct(
            invoice_number(text).alias("invoice_number"),
            part["dates"]["issued"].alias("invoice_date"),
            part["dates"]["due"].alias("due_date"),
            issuer(text).alias("issuer_name"),
            recipient(text).alias("recipient_name"),
            part["amounts"]["total"].alias("total_amount"),
            part["amounts"]["passed"].alias("validation_math_passed"),
        ),
    )


FIELD_NAMES = [
    "invoice_number",
    "invoice_date",
    "due_date",
    "issuer_name",
    "recipient_name",
    "total_amount",
    "validation_math_passed",
]
FIELDS_TYPE = (
    "struct<invoice_number:string,invoice_date:string,due_date:string,issuer_name:string,"
    "recipient_name:string,total_amount:string,validation_math_passed:boolean>"
)
