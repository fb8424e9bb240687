"""Registered queries: field extraction.

Rendered documents are checked against the table values they were written from; free texts and web
pages against the same patterns on the other engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions import forms, invoice, mail, resume
from foliospark.functions.base import normalise_space
from foliospark.functions.dispatch import fields_by_class
from foliospark.operators.words import total_spatial as largest_low_amount
from foliospark.plans import oracle_parts as sql
from foliospark.plans.registry import register
from foliospark.plans.rendered import (
    CORPUS,
    EMAILS,
    FORMS,
    INVOICES,
    RESUMES,
    SEEDED_PAGES,
    SEEDED_PROSE,
    Tables,
)

# ------------------------------------------------------------------------------------- invoices


def _invoice(name: str, truth: str, job) -> None:
    @register(name, f"select doc_id, {truth} as {name} from ({INVOICES}) i")
    def run(t: Tables) -> DataFrame:
        return t.derive(INVOICES).select("doc_id", job("text").alias(name))


_PASSED = (
    "case when true_tax_cents is not null then "
    "abs(true_sub_cents + true_tax_cents - true_total_cents) < 5 end"
)

_invoice("invoice_number", "true_number", invoice.invoice_number)
_invoice("invoice_date", "true_issued", invoice.invoice_date)
_invoice("due_date", "true_due", invoice.due_date)
_invoice("recipient", "true_recipient", invoice.recipient)
_invoice("issuer", "true_issuer", invoice.issuer)


def _joined(values: Column) -> Column:
    return F.array_join(values, " | ")


@register(
    "all_dates",
    f"select doc_id, true_issued || ' | ' || true_due as all_dates from ({INVOICES}) i",
)
def all_dates(t: Tables) -> DataFrame:
    return t.derive(INVOICES).select("doc_id", _joined(invoice.all_dates("text")).alias("all_dates"))


# Texts whose dates carry no label: only the first two lines and the date values of an invoice.
_UNLABELLED = f"""
select doc_id, true_issuer || chr(10) || true_issued || ', then ' || true_due || chr(10)
    || 'and 3rd of March, ' || substr(true_issued, 1, 4) || '; ' || true_issued as text,
    true_issued, true_due
from ({INVOICES}) i
"""


@register(
    "date_fallback",
    f"""
    select doc_id, true_issued as invoice_date, true_due as due_date,
        true_issued || ' | ' || true_due || ' | 3rd of March, ' || substr(true_issued, 1, 4)
            as all_dates
    from ({_UNLABELLED}) u
    """,
)
def date_fallback(t: Tables) -> DataFrame:
    dates = invoice.dates_with_fallback("text")
    found = t.derive(_UNLABELLED).select(
        "doc_id", dates.alias("d"), _joined(invoice.all_dates("text")).alias("all_dates")
    )
    return found.select(
        "doc_id", F.col("d.issued").alias("invoice_date"), F.col("d.due").alias("due_date"), "all_dates"
    )


@register(
    "total_text",
    f"select doc_id, format('{{:.2f}}', true_total_cents / 100.0) as total_text from ({INVOICES}) i",
)
def total_text(t: Tables) -> DataFrame:
    return t.derive(INVOICES).select("doc_id", invoice.total_amount("text").alias("total_text"))


@register(
    "total_format",
    f"select doc_id, {sql.amount('true_total_cents')} as total_amount from ({INVOICES}) i",
)
def total_format(t: Tables) -> DataFrame:
    total = invoice.format_amount(invoice.total_value("text"))
    return t.derive(INVOICES).select("doc_id", total.alias("total_amount"))


@register("math_check", f"select doc_id, {_PASSED} as passed from ({INVOICES}) i")
def math_check(t: Tables) -> DataFrame:
    passed = invoice.math_check("text", invoice.total_value("text"))
    return t.derive(INVOICES).select("doc_id", passed.alias("passed"))


# Word boxes: every line item of an order is a word, its page position follows from its date.
_WORDS = """
select l_orderkey as doc_id,
    cast(round(l_extendedprice * 100) as bigint) * 8 + l_linenumber as word_idx,
    '$' || cast(cast(floor(l_quantity * 100) as bigint) as string) || '.5' as text,
    l_partkey % 7 as top
from {lineitem}
union all
select l_orderkey, l_linenumber - 100, l_returnflag || l_linestatus, 9 from {lineitem}
union all
select l_orderkey, l_linenumber - 200, '0.00', 8 from {lineitem}
"""


@register(
    "total_spatial",
    """
    select doc_id, max(amount) as total from (
        select l_orderkey as doc_id, floor(l_quantity * 100) + 0.5 as amount,
            row_number() over (partition by l_orderkey order by l_partkey % 7 desc,
                cast(round(l_extendedprice * 100) as bigint) * 8 + l_linenumber) as place
        from {lineitem}
    ) w where place <= 5 group by doc_id
    """,
)
def total_spatial(t: Tables) -> DataFrame:
    return largest_low_amount(t.derive(_WORDS))


_FIELDS = f"""
select doc_id, true_number as invoice_number, true_issued as invoice_date, true_due as due_date,
    true_issuer as issuer_name, true_recipient as recipient_name,
    {sql.amount('true_total_cents')} as total_amount, {_PASSED} as validation_math_passed
from ({INVOICES}) i
"""


@register("invoice_fields", _FIELDS)
def invoice_fields(t: Tables) -> DataFrame:
    packed = t.derive(INVOICES).select("doc_id", invoice.invoice_fields("text").alias("f"))
    return packed.select("doc_id", "f.*")


# A snippet in which lines of every refused kind come before the name.
_SNIPPET = f"""
select doc_id, true_recipient, 'Bill To:' || chr(10) || 'Invoice ' || true_number || chr(10)
    || '+1 (555) 123-4567' || chr(10) || 'x' || chr(10) || '  ' || true_recipient || chr(9) || 'Ltd '
    || chr(10) || 'Second Name' as text
from ({INVOICES}) i
"""


@register(
    "name_from_snippet",
    f"select doc_id, true_recipient || ' Ltd' as name from ({_SNIPPET}) s",
)
def name_from_snippet(t: Tables) -> DataFrame:
    return t.derive(_SNIPPET).select("doc_id", invoice.recipient("text").alias("name"))


# -------------------------------------------------------------------------- invoice rules on prose


@register(
    "dates_in_prose",
    f"""
    select doc_id, coalesce(array_to_string(list_transform(
        regexp_extract_all(text, {sql.quoted('(?i)' + fixed.DATE)}),
        lambda d: {sql.normalise('d')}), ' | '), '') as dates
    from ({SEEDED_PROSE}) s
    """,
)
def dates_in_prose(t: Tables) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("(?iUd)" + fixed.DATE), F.lit(0))
    dates = F.array_join(F.transform(found, normalise_space), " | ")
    return t.derive(SEEDED_PROSE).select("doc_id", dates.alias("dates"))


def _re2_total() -> str:
    tries = [
        f"nullif(regexp_extract(text, {sql.quoted('(?i)' + label + lead)}, 1), '')"
        for label in fixed.TOTAL_LABELS
        for lead in [rf"\s*[:\-]?\s*{fixed.CURRENCY}?\s*{fixed.CURRENCY}?\s*{fixed.TOTAL_AMOUNT}"]
    ]
    return f"rtrim(regexp_replace(coalesce({', '.join(tries)}), '\\s', '', 'g'), '.')"


# Invoices whose lines are put in reverse order: what follows a label is then another line.
_REVERSED = f"""
select doc_id, true_issuer || ' - Total' || chr(10) || true_due || chr(10) || 'Tax 7 Net amount: '
    || chr(10) || true_issued || ' due date ' || true_due || ' Total: 1.' || chr(10) || text as text
from ({INVOICES}) i
"""


@register(
    "total_in_odd_layout",
    f"select doc_id, {_re2_total()} as total_text from ({_REVERSED}) r",
)
def total_in_odd_layout(t: Tables) -> DataFrame:
    return t.derive(_REVERSED).select("doc_id", invoice.total_amount("text").alias("total_text"))


def _re2_number() -> str:
    tries = []
    for pattern in fixed.INVOICE_NUMBERS:
        found = f"rtrim(regexp_extract(text, {sql.quoted(pattern)}, 1), '.')"
        tries.append(
            f"case when length({found}) >= 2 and not regexp_full_match({found}, '\\d{{1,2}}') "
            f"then {found} end"
        )
    return f"coalesce({', '.join(tries)})"


_ASCII_PROSE = rf"select doc_id, regexp_replace(text, '[^\x00-\x7f]', '_', 'g') as text from ({SEEDED_PROSE}) s"
_ASCII_PAGES = rf"select page_id, regexp_replace(html, '[^\x00-\x7f]', '_', 'g') as text from ({SEEDED_PAGES}) s"


def _ascii(column: str) -> Column:
    return F.regexp_replace(column, r"[^\x00-\x7f]", "_")


@register(
    "number_in_prose",
    f"select doc_id, {_re2_number()} as invoice_number from ({_ASCII_PROSE}) d",
)
def number_in_prose(t: Tables) -> DataFrame:
    plain = t.derive(SEEDED_PROSE).select("doc_id", _ascii("text").alias("text"))
    return plain.select("doc_id", invoice.invoice_number("text").alias("invoice_number"))


def _re2_lines(x: str) -> str:
    ends = sql.re2(fixed.LINE_END_CHARS)
    return f"list_transform(string_split_regex({x}, '\\r\\n|[{ends}]'), lambda l: {sql.normalise('l')})"


def _re2_name(lines: str, skip: str, numbers: str) -> str:
    return (
        f"list_filter({lines}, lambda l: length(l) between {fixed.NAME_MIN} and {fixed.NAME_MAX} "
        f"and not regexp_matches(l, {sql.quoted('(?i)' + skip)}) "
        f"and not regexp_full_match(l, {sql.quoted(numbers)}))[1]"
    )


def _re2_party(label: str) -> str:
    snippet = f"regexp_extract(text, {sql.quoted('(?i)' + label + '([^~]{0,300})')}, 1)"
    return _re2_name(_re2_lines(snippet), fixed.SNIPPET_SKIP, fixed.SNIPPET_NUMBER_LINE)


_TOP = f"list_filter({_re2_lines('text')}, lambda l: l <> '')[:{fixed.TOP_LINES}]"
# The tilde stands for "no character" in the checking pattern, so it is taken out of the texts.
_NO_TILDE = f"select doc_id, replace(text, '~', '_') as text from ({_ASCII_PROSE}) d"


@register(
    "parties_in_prose",
    f"""
    select doc_id, {_re2_party(fixed.RECIPIENT_LABEL)} as recipient,
        coalesce({_re2_party(fixed.ISSUER_LABEL)},
            {_re2_name(_TOP, fixed.TOP_SKIP, fixed.TOP_NUMBER_LINE)}) as issuer
    from ({_NO_TILDE}) d
    """,
)
def parties_in_prose(t: Tables) -> DataFrame:
    plain = t.derive(SEEDED_PROSE).select("doc_id", F.replace(_ascii("text"), F.lit("~"), F.lit("_")).alias("text"))
    return plain.select(
        "doc_id",
        invoice.recipient("text").alias("recipient"),
        invoice.issuer("text").alias("issuer"),
    )


# --------------------------------------------------------------------------------------- e-mail


@register(
    "email_headers",
    f"""
    select doc_id, true_sender as sender, true_recipient as recipient, true_sent as date,
        true_subject as subject
    from ({EMAILS}) e
    """,
)
def email_headers(t: Tables) -> DataFrame:
    return t.derive(EMAILS).select(
        "doc_id",
        mail.email_header("text", "From").alias("sender"),
        mail.email_header("text", "To").alias("recipient"),
        mail.email_header("text", "Date").alias("date"),
        mail.email_header("text", "Subject").alias("subject"),
    )


@register(
    "email_addresses", f"select doc_id, true_addresses as addresses from ({EMAILS}) e"
)
def email_addresses(t: Tables) -> DataFrame:
    found = F.array_join(mail.email_addresses("text"), " ")
    return t.derive(EMAILS).select("doc_id", found.alias("addresses"))


_ADDRESS = rf"[{fixed.ADDRESS_CHARS}]+@{fixed.ADDRESS_DOMAIN}"


@register(
    "addresses_in_prose",
    f"""
    select doc_id, array_to_string(regexp_extract_all(text, {sql.quoted(_ADDRESS)}), ' ')
        as addresses, nullif(regexp_extract(text, {sql.quoted(_ADDRESS)}), '') as first_address
    from {{documents}}
    """,
)
def addresses_in_prose(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        F.array_join(mail.email_addresses("text"), " ").alias("addresses"),
        resume.first_email("text").alias("first_address"),
    )


# -------------------------------------------------------------------------------- questionnaires


@register(
    "questions",
    f"""
    select doc_id, '1. Which pages did you use? | Which pages did you use?' as questions
    from ({FORMS}) f
    """,
)
def questions(t: Tables) -> DataFrame:
    return t.derive(FORMS).select("doc_id", _joined(forms.questions("text")).alias("questions"))


@register(
    "checkboxes",
    f"select doc_id, true_ticked as ticked, 'click error purchase signup view' as labels from ({FORMS}) f",
)
def checkboxes(t: Tables) -> DataFrame:
    boxes = t.derive(FORMS).select("doc_id", forms.checkboxes("text").alias("boxes"))

    def labels(kept: Column) -> Column:
        return F.array_join(F.transform(kept, lambda b: b["label"]), " ")

    return boxes.select(
        "doc_id",
        labels(F.filter("boxes", lambda b: b["checked"])).alias("ticked"),
        labels(F.col("boxes")).alias("labels"),
    )


@register("key_values", f"select doc_id, 'Name=' || true_name as answers from ({FORMS}) f")
def key_values(t: Tables) -> DataFrame:
    pairs = F.transform(
        forms.key_values("text"), lambda p: F.concat(p["question"], F.lit("="), p["answer"])
    )
    return t.derive(FORMS).select("doc_id", _joined(pairs).alias("answers"))


def _re2_all(pattern: str, group: int) -> str:
    return f"regexp_extract_all(text, {sql.quoted('(?m)' + pattern)}, {group})"


@register(
    "questions_in_prose",
    f"""
    with found as (
        select doc_id, list_transform(list_concat({_re2_all(fixed.QUESTION_LINE, 1)},
            {_re2_all(fixed.NUMBERED_LINE, 1)}), lambda q: {sql.strip('q')}) as q
        from ({_ASCII_PROSE}) d
    ),
    prompts as (select doc_id, unnest(q) as q, generate_subscripts(q, 1) as n from found),
    firsts as (
        select doc_id, q, n, row_number() over (partition by doc_id, lower(q) order by n) as place
        from prompts where q <> ''
    )
    select f.doc_id, coalesce(string_agg(r.q, ' | ' order by r.n), '') as questions
    from found f left join firsts r on r.doc_id = f.doc_id and r.place = 1
    group by f.doc_id
    """,
)
def questions_in_prose(t: Tables) -> DataFrame:
    plain = t.derive(SEEDED_PROSE).select("doc_id", _ascii("text").alias("text"))
    return plain.select("doc_id", _joined(forms.questions("text")).alias("questions"))


@register(
    "key_values_in_prose",
    f"""
    select doc_id, array_to_string(list_transform(list_zip(
        {_re2_all(fixed.KEY_VALUE_LINE, 1)}, {_re2_all(fixed.KEY_VALUE_LINE, 2)}),
        lambda p: {sql.strip('p[1]')} || '=' || {sql.strip('p[2]')}), ' | ') as answers
    from ({_ASCII_PROSE}) d
    """,
)
def key_values_in_prose(t: Tables) -> DataFrame:
    pairs = F.transform(
        forms.key_values("text"), lambda p: F.concat(p["question"], F.lit("="), p["answer"])
    )
    plain = t.derive(SEEDED_PROSE).select("doc_id", _ascii("text").alias("text"))
    return plain.select("doc_id", _joined(pairs).alias("answers"))


# -------------------------------------------------------------------------------------- resumes


def _resume(name: str, truth: str, job) -> None:
    @register(name, f"select doc_id, {truth} as {name} from ({RESUMES}) r")
    def run(t: Tables) -> DataFrame:
        return t.derive(RESUMES).select("doc_id", job("text").alias(name))


_resume("resume_name", "true_name", resume.candidate_name)
_resume("resume_email", "true_email", resume.first_email)
_resume("resume_phone", "true_phone", resume.phone)
_resume("resume_links", "true_link", lambda text: F.array_join(resume.links(text), " "))


@register(
    "resume_sections",
    f"""
    select doc_id, 3 as sections, true_experience as experience, 'Example University' as education,
        'programming' as skills
    from ({RESUMES}) r
    """,
)
def resume_sections(t: Tables) -> DataFrame:
    found = t.derive(RESUMES).select("doc_id", resume.sections("text").alias("s"))
    return found.select(
        "doc_id",
        F.size("s").alias("sections"),
        F.try_element_at("s", F.lit("EXPERIENCE")).alias("experience"),
        F.try_element_at("s", F.lit("EDUCATION")).alias("education"),
        F.try_element_at("s", F.lit("SKILLS")).alias("skills"),
    )


@register(
    "links_in_pages",
    f"""
    select page_id, array_to_string(regexp_extract_all(text, {sql.quoted('(?i)' + fixed.LINK)}), ' ')
        as links
    from ({_ASCII_PAGES}) p
    """,
)
def links_in_pages(t: Tables) -> DataFrame:
    plain = t.derive(SEEDED_PAGES).select("page_id", _ascii("html").alias("text"))
    return plain.select("page_id", F.array_join(resume.links("text"), " ").alias("links"))


@register(
    "phone_in_prose",
    f"""
    select doc_id, nullif({sql.strip(f"regexp_extract(text, {sql.quoted(fixed.PHONE)})")}, '')
        as phone
    from {{documents}}
    """,
)
def phone_in_prose(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", resume.phone("text").alias("phone"))


# --------------------------------------------------------------------------------------- by class


@register(
    "extract_by_class",
    f"""
    select c.doc_id, c.label, i.true_number as invoice_number, e.true_subject as subject,
        case when f.doc_id is not null then 5 end as boxes, r.true_phone as phone
    from ({CORPUS}) c
    left join ({INVOICES}) i on i.doc_id = c.doc_id
    left join ({EMAILS}) e on e.doc_id = c.doc_id
    left join ({FORMS}) f on f.doc_id = c.doc_id
    left join ({RESUMES}) r on r.doc_id = c.doc_id
    """,
)
def extract_by_class(t: Tables) -> DataFrame:
    packed = t.derive(CORPUS).select("doc_id", "label", fields_by_class("label", "text").alias("f"))
    boxes = F.col("f.questionnaire.checkboxes")
    return packed.select(
        "doc_id",
        "label",
        F.col("f.invoice.invoice_number").alias("invoice_number"),
        F.col("f.email.subject").alias("subject"),
        F.when(boxes.isNotNull(), F.size(boxes)).alias("boxes"),
        F.col("f.resume.phone").alias("phone"),
    )
