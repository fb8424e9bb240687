"""Documents of the four classes written out from the star-schema tables, and other inputs derived
from the tables.

The statements use functions that Spark and DuckDB share, so both sides of a check start from the same
rows.  A document carries its true field values in ``true_*`` columns, taken from the tables and not
from the text.  ``{name}`` stands for a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
Reader = Callable[[str, str], DataFrame]


def _padded(expression: str, width: int) -> str:
    return f"lpad(cast({expression} as string), {width}, '0')"


def _money(cents: str) -> str:
    whole = f"cast(cast(floor({cents} / 100) as bigint) as string)"
    return f"{whole} || '.' || {_padded(f'{cents} % 100', 2)}"


def _iso(day: str) -> str:
    return f"{_padded(f'year({day})', 4)} || '-' || {_padded(f'month({day})', 2)} || '-' || {_padded(f'day({day})', 2)}"


def _slashed(day: str) -> str:
    return f"{_padded(f'day({day})', 2)} || '/' || {_padded(f'month({day})', 2)} || '/' || {_padded(f'year({day})', 4)}"


# Label variants follow the order's priority and status and the amount, so every label list is used.
INVOICES = f"""
select
    order_key * 4 as doc_id,
    'Invoice' as label,
    issuer || chr(10)
        || case priority
             when '1-URGENT' then 'Invoice No: ' || number
             when '2-HIGH' then 'Invoice: ' || number
             when '3-MEDIUM' then 'Reference: ' || number
             when '4-NOT SPECIFIED' then 'Order No. ' || number || '.'
             else number
           end || chr(10)
        || case status when 'F' then 'Invoice Date: ' when 'O' then 'Date of Issue: '
             else 'Billing Date - ' end || issued || chr(10)
        || case status when 'F' then 'Due Date: ' when 'O' then 'Payment due: '
             else 'Please pay by ' end || due || chr(10)
        || 'Bill To:' || chr(10) || recipient || chr(10)
        || 'Subtotal: $' || {_money('sub_cents')} || chr(10)
        || case when tax_cents is null then '' else 'Tax: $' || {_money('tax_cents')} || chr(10) end
        || case total_cents % 4
             when 0 then 'Grand Total: $'
             when 1 then 'Total due EUR '
             when 2 then 'Amount payable: '
             else 'TOTAL '
           end || {_money('total_cents')} || chr(10)
        || 'Thank you' as text,
    number as true_number,
    issued as true_issued,
    due as true_due,
    issuer as true_issuer,
    recipient as true_recipient,
    total_cents as true_total_cents,
    sub_cents as true_sub_cents,
    tax_cents as true_tax_cents
from (
    select
        order_key, priority, status, issuer, recipient, issued, due, sub_cents, tax_cents,
        case priority
            when '1-URGENT' then 'INV-' || {_padded('order_key', 6)}
            when '2-HIGH' then 'A/' || {_padded('order_key', 6)} || '/X'
            when '3-MEDIUM' then 'REF-' || {_padded('order_key', 6)}
            when '4-NOT SPECIFIED' then {_padded('order_key', 6)} || '-B'
            else 'PO_' || {_padded('order_key', 6)} || 'X'
        end as number,
        sub_cents + coalesce(tax_cents, 0) + case when sub_cents % 7 = 0 then 100 else 0 end
            as total_cents
    from (
        select
            o.o_orderkey as order_key,
            o.o_orderpriority as priority,
            o.o_orderstatus as status,
            'Merchant ' || cast(l.supplier_key as string) as issuer,
            c.c_name as recipient,
            {_iso('o.o_orderdate')} as issued,
            {_slashed("o.o_orderdate + interval '30' day")} as due,
            l.cents as sub_cents,
            case when l.cents % 11 = 0 then null else cast(floor(l.cents / 10) as bigint) end
                as tax_cents
        from (
            select
                l_orderkey,
                min(l_suppkey) as supplier_key,
                sum(cast(round(l_extendedprice * 100) as bigint)) as cents
            from {{lineitem}}
            group by l_orderkey
        ) l
        join {{orders}} o on o.o_orderkey = l.l_orderkey
        join {{customer}} c on c.c_custkey = o.o_custkey
    ) base
) numbered
"""

EMAILS = f"""
select
    (conv_id * 100 + turn) * 4 + 1 as doc_id,
    'Email' as label,
    'From: ' || sender || chr(10)
        || 'To: Desk <desk@example.com>' || chr(10)
        || 'Date: ' || sent || chr(10)
        || 'Subject: ' || subject || chr(10) || chr(10)
        || 'Dear Desk, please read this. Regards, ' || role as text,
    sender as true_sender,
    'Desk <desk@example.com>' as true_recipient,
    sent as true_sent,
    subject as true_subject,
    address || ' desk@example.com' as true_addresses
from (
    select
        conv_id, turn, role,
        'u' || cast(conv_id as string) || '@example.com' as address,
        role || ' ' || cast(conv_id as string) || ' <u' || cast(conv_id as string)
            || '@example.com>' as sender,
        '2024-01-' || {_padded('turn + 1', 2)} as sent,
        'Conversation ' || cast(conv_id as string) || ' turn ' || cast(turn as string) as subject
    from {{conversations}}
) mail
"""


def _box(kind: str) -> str:
    return f"case when n_{kind} * 5 >= n_all then '[x] ' else '[ ] ' end || '{kind}'"


def _ticked(kind: str) -> str:
    return f"case when n_{kind} * 5 >= n_all then '{kind} ' else '' end"


_KINDS = ["click", "error", "purchase", "signup", "view"]

FORMS = f"""
select
    user_id * 4 + 2 as doc_id,
    'Questionnaire' as label,
    'CUSTOMER FORM' || chr(10)
        || 'Name: User ' || cast(user_id as string) || chr(10)
        || '1. Which pages did you use?' || chr(10)
        || {" || chr(10) || ".join(_box(kind) for kind in _KINDS)} || chr(10)
        || 'Please tick and rate the scale.' as text,
    'User ' || cast(user_id as string) as true_name,
    trim({" || ".join(_ticked(kind) for kind in _KINDS)}) as true_ticked
from (
    select
        user_id,
        count(*) as n_all,
        {", ".join(f"sum(case when event_type = '{kind}' then 1 else 0 end) as n_{kind}" for kind in _KINDS)}
    from {{events}}
    group by user_id
) users
"""

RESUMES = f"""
select
    c.c_custkey * 4 + 3 as doc_id,
    'Resume' as label,
    'Candidate ' || cast(c.c_custkey as string) || chr(10)
        || 'c' || cast(c.c_custkey as string) || '@example.com' || chr(10)
        || '+1 (555) 123-' || {_padded('c.c_custkey % 10000', 4)} || chr(10)
        || 'https://example.com/c/' || cast(c.c_custkey as string) || chr(10)
        || 'EXPERIENCE' || chr(10)
        || c.c_mktsegment || ' analyst in ' || n.n_name || chr(10)
        || 'EDUCATION' || chr(10)
        || 'Example University' || chr(10)
        || 'SKILLS' || chr(10)
        || 'programming' as text,
    'Candidate ' || cast(c.c_custkey as string) as true_name,
    'c' || cast(c.c_custkey as string) || '@example.com' as true_email,
    '+1 (555) 123-' || {_padded('c.c_custkey % 10000', 4)} as true_phone,
    'https://example.com/c/' || cast(c.c_custkey as string) as true_link,
    c.c_mktsegment || ' analyst in ' || n.n_name as true_experience
from {{customer}} c
join {{nation}} n on n.n_nationkey = c.c_nationkey
"""

CORPUS = f"""
select doc_id, label, text from ({INVOICES}) i
union all select doc_id, label, text from ({EMAILS}) e
union all select doc_id, label, text from ({FORMS}) f
union all select doc_id, label, text from ({RESUMES}) r
"""

# Rendered documents and the free texts together.
ALL_TEXTS = f"""
select doc_id, text from ({CORPUS}) c
union all select -1 - doc_id as doc_id, text from {{documents}}
"""

# Files: one per document, suffixes of mixed case, some unsupported, sizes on both sides of the cap.
FILES = """
select
    'data/raw/' || lang || '/' || source || '_' || cast(doc_id as string)
        || case doc_id % 9
             when 0 then '.pdf' when 1 then '.PNG' when 2 then '.jpg' when 3 then '.JPEG'
             when 4 then '.tiff' when 5 then '.tif' when 6 then '.bmp' when 7 then '.docx'
             else ''
           end as path,
    doc_id,
    lang,
    n_chars * 16384 as length
from {documents}
"""

# Texts cached so far: those of the labelled documents.
CACHE = f"""
select f.path, d.text
from ({FILES}) f
join {{documents}} d on d.doc_id = f.doc_id
join {{labels}} l on l.doc_id = f.doc_id
"""

# Class scores that are exact quotients of small integers; ties and shares below the limit occur.
SCORED = f"""
select
    s.*,
    w_email / w_all as p_email,
    w_invoice / w_all as p_invoice,
    w_form / w_all as p_form,
    w_resume / w_all as p_resume
from (
    select
        w.*,
        w_email + w_invoice + w_form + w_resume as w_all
    from (
        select
            i.*,
            'scan_' || cast(doc_id as string) || ' (' || cast(doc_id % 5 as string) || ').pdf' as file,
            case doc_id % 3 when 0 then 'tesseract' when 1 then 'easyocr' else 'native_pdf' end
                as ocr_engine,
            case doc_id % 5 when 0 then 'fr' when 1 then 'unknown' when 2 then 'sv' else 'en' end
                as detected_language,
            cast(doc_id % 7 + 1 as double) as w_email,
            cast(doc_id % 11 + case when doc_id % 3 = 0 then 20 else 1 end as double) as w_invoice,
            cast(doc_id % 5 + 1 as double) as w_form,
            cast(doc_id % 6 + case when doc_id % 13 = 0 then 30 else 1 end as double) as w_resume
        from ({INVOICES}) i
    ) w
) s
"""

# A label and a prediction per document; the class "es" is never predicted.
PREDICTED = """
select
    doc_id,
    lang as label,
    case n_chars % 5 when 0 then 'en' when 1 then 'fr'
      else case when lang = 'es' then 'de' else lang end end as predicted
from {documents}
"""


# The documents' prose with lines that a pattern has to find: questions and a numbered prompt, a
# recipient, dates; and the pages with their own address as a link.
SEEDED_PROSE = """
select doc_id, case doc_id % 3
    when 0 then replace(text, '.' || chr(10), '?' || chr(10)) || chr(10) || '2) Which of ' || source || chr(10)
    when 1 then 'Attention: Client ' || source || ' Ltd' || chr(10) || text
    else text || chr(10) || 'from 0' || cast(doc_id % 9 + 1 as string) || '/12/2024 to 2024-01-1'
        || cast(doc_id % 10 as string)
  end as text
from {documents}
"""
SEEDED_PAGES = "select page_id, url || ' ' || html || ' (' || url || ')' as html from {pages}"


class Tables:
    """The parquet tables of one folder, and derived inputs."""

    def __init__(self, spark: SparkSession, folder: str, read: Reader | None = None):
        self.spark, self.folder = spark, folder
        self.read = read or (lambda name, path: spark.read.parquet(path))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.read(name, f"{self.folder}/{name}.parquet")

    def derive(self, statement: str) -> DataFrame:
        used = {name: getattr(self, name) for name in TABLES if "{" + name + "}" in statement}
        return self.spark.sql(statement, **used)


def for_duckdb(statement: str) -> str:
    for name in TABLES:
        statement = statement.replace("{" + name + "}", name)
    return statement
