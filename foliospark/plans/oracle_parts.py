"""SQL pieces for the checking side, written for an engine whose regular expressions know neither
look-around nor Unicode word boundaries."""

from __future__ import annotations

import re

from foliospark import fixed


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    r"""``\uXXXX`` as ``\x{XXXX}``."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", pattern)


SPACES = re2(fixed.SPACE_CHARS)
WORD = r"\p{L}\p{N}_"


def strip(x: str) -> str:
    return (
        f"regexp_replace(regexp_replace({x}, '^[{SPACES}]+', ''), '[{SPACES}]+$', '')"
    )


def normalise(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{SPACES}]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '[^{SPACES}]+'))"


def _replace(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def fix_ocr(x: str) -> str:
    """The corrections with captured context; run twice where matches may share a character."""
    edge, end = rf"(^|[^{WORD}])", rf"($|[^{WORD}])"
    steps = [
        (r"(^|[^A-Za-z0-9])\|($|[^A-Za-z0-9])", r"\1I\2", 2),
        (r"\|([a-z])", r"I\1", 1),
        (rf"{edge}rn{end}", r"\1m\2", 2),
        (r"([a-z])rn([a-z])", r"\1m\2", 2),
        (r"([a-z])vv([a-z])", r"\1w\2", 2),
        (r"([A-Za-z])0([A-Za-z])", r"\1O\2", 2),
        (r"(\d)l(\d)", r"\11\2", 2),
        (rf"{edge}l(\d)", r"\11\2", 1),
        (rf"{edge}S[{SPACES}](\d)", r"\1$ \2", 1),
    ]
    for pattern, by, times in steps:
        for _ in range(times):
            x = _replace(x, pattern, by)
    for odd, even in [("\ufb01", "fi"), ("\ufb02", "fl"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\f", "\n")]:
        x = f"replace({x}, chr({ord(odd)}), {quoted(even) if even != chr(10) else 'chr(10)'})"
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def suffix(x: str) -> str:
    return f"lower(regexp_extract({x}, '[^/](\\.[^./]+)$', 1))"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def values_table(name: str, columns: list[str], rows: list[tuple]) -> str:
    body = ", ".join(
        "(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    )
    return f"{name}({', '.join(columns)}) as (values {body})"


def amount(cents: str) -> str:
    """Thousands separators and two decimals."""
    return f"format('{{:,.2f}}', {cents} / 100.0)"


STOP = in_list(fixed.STOP_WORDS)
LEMMAS = values_table("lemmas", ["form", "lemma"], list(fixed.LEMMAS.items()))


def tokens(source: str) -> str:
    """``(doc_id, list of cleaned, filtered, lemmatised tokens)`` as common table expressions."""
    return f"""
    {LEMMAS},
    pieces as (
        select doc_id, unnest(w) as form, generate_subscripts(w, 1) as at
        from (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as w from {source}) s
    ),
    kept as (
        select p.doc_id, p.at, coalesce(l.lemma, p.form) as token,
            row_number() over (partition by p.doc_id order by p.at) as n
        from pieces p left join lemmas l on l.form = p.form
        where length(p.form) > 2 and p.form not in {STOP}
    ),
    grams as (
        select doc_id, token as term from kept
        union all
        select a.doc_id, a.token || ' ' || b.token
        from kept a join kept b on a.doc_id = b.doc_id and b.n = a.n + 1
    ),
    counted as (select doc_id, term, count(*) as tf from grams group by doc_id, term)"""


def vocabulary() -> str:
    """Common table expressions ``vocab(term, df, cf, term_index)``; needs ``counted``."""
    return f"""
    totals as (
        select term, count(*) as df, sum(tf) as cf from counted group by term
        having count(*) >= {fixed.MIN_DF}
    ),
    ranked as (select *, row_number() over (order by cf desc, term) as place from totals),
    vocab as (
        select term, df, cf, row_number() over (order by term) - 1 as term_index
        from ranked where place <= {fixed.MAX_FEATURES}
    )"""


def structural_count(text: str, pattern: str) -> str:
    """Matches of a feature pattern.  Accented letters are first turned into a word character, since
    boundaries here only know ASCII; currency signs and box symbols stay."""
    plain = f"regexp_replace({text}, '[\\x{{aa}}\\x{{b5}}\\x{{ba}}\\x{{c0}}-\\x{{d6}}\\x{{d8}}-\\x{{f6}}\\x{{f8}}-\\x{{24f}}]', '_', 'g')"
    return f"len(regexp_extract_all({plain}, {quoted('(?im)' + re2(pattern))}))"
