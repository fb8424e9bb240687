"""Registered queries: text assembly, OCR clean-up, numbers, language, image measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions import language as lang
from foliospark.functions import text as tx
from foliospark.operators import pages as pg
from foliospark.operators.imaging import page_quality as measure_pages
from foliospark.operators.language import PROFILE_SIZE, LanguageModel
from foliospark.plans import oracle_parts as sql
from foliospark.plans.check_sources import document_lines
from foliospark.plans.registry import register
from foliospark.plans.rendered import Tables
from foliospark.session import materialise

# Conversations as documents: a conversation's turns are its pages.  In the OCR form the assistant's
# pages are unreadable.
_BREAK = "chr(10) || chr(10)"


@register(
    "assemble_pages",
    f"""
    select doc_id, case when length(whole) >= {fixed.MIN_NATIVE_CHARS}
        then {sql.fix_ocr('whole')} end as text
    from (
        select conv_id as doc_id,
            {sql.strip(f"string_agg(coalesce(text, ''), {_BREAK} order by turn)")} as whole
        from {{conversations}} group by conv_id
    ) j
    """,
)
def assemble_pages(t: Tables) -> DataFrame:
    pages = t.conversations.withColumnsRenamed({"conv_id": "doc_id", "turn": "page_no"})
    return pg.assemble_pages(pages)


@register(
    "assemble_ocr_pages",
    f"""
    select doc_id, case when blank then null else whole end as text,
        case when blank then {sql.quoted(fixed.NO_TEXT_ERROR)} end as error
    from (
        select doc_id, whole, {sql.strip("coalesce(whole, '')")} = '' as blank
        from (
            select conv_id * 10 + turn % 2 as doc_id,
                string_agg(case when role = 'assistant' or text = '' then null else text end,
                    {_BREAK} order by turn) as whole
            from {{conversations}} group by conv_id * 10 + turn % 2
        ) j
    ) k
    """,
)
def assemble_ocr_pages(t: Tables) -> DataFrame:
    unreadable = F.col("role") == "assistant"
    pages = t.conversations.select(
        (F.col("conv_id") * 10 + F.col("turn") % 2).alias("doc_id"),
        F.col("turn").alias("page_no"),
        F.when(unreadable, "").otherwise(F.col("text")).alias("text"),
    )
    return pg.assemble_ocr_pages(pages)


# Attempts: every line is the block-layout text of its own page, the automatic-layout text of the page
# before and the second engine's text of the one before that.
def ocr_attempts(t: Tables) -> DataFrame:
    def attempt(back: int, engine: str, psm: int | None) -> F.Column:
        return F.struct(
            (F.col("line_no") - back).alias("page_no"),
            F.lit(engine).alias("engine"),
            F.lit(psm).cast("int").alias("psm"),
        )

    kinds = F.array(
        attempt(0, "tesseract", 6), attempt(1, "tesseract", 3), attempt(2, "easyocr", None)
    )
    # dealt out by document as single lines: the attempts, three times that text, then meet where they are made
    lines = document_lines(t).repartition("doc_id")
    spread = lines.select("doc_id", "text", F.explode(kinds).alias("a"))
    return spread.select("doc_id", "a.page_no", "a.engine", "a.psm", "text")


_ATTEMPTS = f"""
    lines as (
        select doc_id, unnest(w) as text, generate_subscripts(w, 1) as line_no
        from (select doc_id, string_split(text, chr(10)) as w from {{documents}}) s
    ),
    tries as (
        select doc_id, line_no as page_no, 'block' as kind, {sql.strip('text')} as text from lines
        union all select doc_id, line_no - 1, 'auto', {sql.strip('text')} from lines
        union all select doc_id, line_no - 2, 'second', {sql.strip('text')} from lines
    ),
    wide as (
        select doc_id, page_no,
            coalesce(max(case when kind = 'block' then text end), '') as block,
            coalesce(max(case when kind = 'auto' then text end), '') as auto,
            coalesce(max(case when kind = 'second' then text end), '') as second
        from tries group by doc_id, page_no
    ),
    picked as (
        select doc_id, page_no, second,
            case when {sql.words('block')} < {fixed.MIN_ENGINE_WORDS}
                and {sql.words('auto')} > {sql.words('block')} then auto else block end as raw
        from wide
    ),
    fixed_texts as (
        select doc_id, page_no, {sql.fix_ocr('raw')} as one, {sql.fix_ocr('second')} as two
        from picked
    ),
    counts as (
        select *, {sql.words('one')} as n_one, {sql.words('two')} as n_two from fixed_texts
    ),
    final as (
        select doc_id, page_no,
            case when n_one >= {fixed.MIN_ENGINE_WORDS} then 'tesseract' else 'easyocr' end as engine,
            case when n_one < {fixed.MIN_ENGINE_WORDS} and n_two > n_one then two else one end as text,
            case when n_one < {fixed.MIN_ENGINE_WORDS} then greatest(n_one, n_two) else n_one end as n
        from counts
    )"""


@register(
    "choose_ocr",
    f"""
    with {_ATTEMPTS}
    select doc_id, page_no, n as word_count,
        case when n >= {fixed.MIN_USABLE_WORDS} then engine end as ocr_engine,
        case when n >= {fixed.MIN_USABLE_WORDS} then text end as text,
        case when n < {fixed.MIN_USABLE_WORDS} then {sql.quoted(fixed.LOW_QUALITY_ERROR)} end as error
    from final
    """,
)
def choose_ocr(t: Tables) -> DataFrame:
    return pg.choose_ocr(ocr_attempts(t))


@register(
    "ocr_documents",
    f"""
    with {_ATTEMPTS},
    joined as (
        select doc_id, string_agg(case when n >= {fixed.MIN_USABLE_WORDS} then nullif(text, '') end,
            {_BREAK} order by page_no) as whole,
            arg_max(engine, page_no) filter (n >= {fixed.MIN_USABLE_WORDS}) as engine,
            arg_max(n, page_no) filter (n >= {fixed.MIN_USABLE_WORDS}) as last_words
        from final group by doc_id
    )
    select doc_id, whole as text, engine as ocr_engine, {sql.words('whole')} as all_words, last_words,
        case when whole is null then {sql.quoted(fixed.NO_TEXT_ERROR)} end as error
    from joined
    """,
)
def ocr_documents(t: Tables) -> DataFrame:
    # both forms read the same joined pages: the attempts are cleaned, compared and joined once
    pages = materialise(pg.join_chosen(pg.choose_ocr(ocr_attempts(t))), "joined-pages", even=True)
    joined = pg.ocr_documents(pages).withColumnRenamed("word_count", "all_words")
    last = pg.ocr_documents(pages, compat_last_page=True)
    return joined.join(
        last.select("doc_id", F.col("word_count").alias("last_words")), "doc_id"
    ).withColumn("all_words", F.coalesce("all_words", F.lit(0)))


@register("fix_ocr", f"select doc_id, {sql.fix_ocr('text')} as text from {{documents}}")
def fix_ocr(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.fix_ocr("text").alias("text"))


@register("word_count", f"select doc_id, {sql.words('text')} as word_count from {{documents}}")
def word_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.word_count("text").alias("word_count"))


@register(
    "quality_flags",
    f"""
    select doc_id, n as word_count, n >= {fixed.MIN_USABLE_WORDS} as usable,
        n < {fixed.LOW_QUALITY_WORDS} as low_quality
    from (select doc_id, {sql.words('text')} as n from {{documents}}) c
    """,
)
def quality_flags(t: Tables) -> DataFrame:
    flagged = pg.quality_flags(t.documents)
    return flagged.select("doc_id", "word_count", "usable", "low_quality")


@register("normalise_space", f"select doc_id, {sql.normalise('text')} as text from {{documents}}")
def normalise_space(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.normalise_space("text").alias("text"))


# Amounts written in five ways; the cents are the truth.
_AMOUNTS = """
select o_orderkey, cents, o_orderkey % 5 as form,
    case o_orderkey % 5
        when 0 then whole || '.' || rest
        when 1 then substr(whole, 1, length(whole) - 3) || ',' || right(whole, 3) || '.' || rest
        when 2 then substr(whole, 1, length(whole) - 3) || '.' || right(whole, 3) || ',' || rest
        when 3 then '  ' || whole || ' '
        else whole || ' EUR'
    end as written
from (
    select o_orderkey, cents, cast(cast(floor(cents / 100) as bigint) as string) as whole,
        lpad(cast(cents % 100 as string), 2, '0') as rest
    from (
        select o_orderkey, cast(round(o_totalprice * 100) as bigint) + 100000 as cents from {orders}
    ) c
) w
"""


@register(
    "to_float",
    f"""
    select o_orderkey, written, case form
        when 3 then cast(floor(cents / 100) as double)
        when 4 then null
        when 2 then case when cents < 100000000 then cents / 100.0 end
        else cents / 100.0 end as value
    from ({_AMOUNTS}) a
    """,
)
def to_float(t: Tables) -> DataFrame:
    return t.derive(_AMOUNTS).select("o_orderkey", "written", tx.to_float("written").alias("value"))


# ------------------------------------------------------------------------------------ language

_GRAMS = r"""
    padded as (
        select doc_id, lang, text,
            ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' as p
        from {documents}
    ),
    letters as (select doc_id, lang, regexp_extract_all(p, '.') as c from padded),
    pieces as (
        select doc_id, lang, unnest(list_transform(range(1, len(c) - 1),
            lambda i: c[i] || c[i + 1] || c[i + 2])) as gram
        from letters
    ),
    per_doc as (select doc_id, lang, gram, count(*) as tf from pieces group by all),"""

_PROFILE = f"""
    counts as (select lang, gram, sum(tf) as n from per_doc where lang is not null group by all),
    best as (
        select distinct gram from (
            select gram, row_number() over (partition by lang order by n desc, gram) as place
            from counts
        ) r where place <= {PROFILE_SIZE}
    ),
    known as (select c.* from counts c join best b on b.gram = c.gram),
    mass as (
        select lang, sum(n) + (select count(*) from best) as mass from known group by lang
    )"""


@register(
    "language_profile",
    f"""
    with {_GRAMS} {_PROFILE}
    select k.lang, k.gram, round(ln((k.n + 1) / m.mass), 6) as log_p,
        round(ln(1 / m.mass), 6) as unseen_log_p
    from known k join mass m on m.lang = k.lang
    """,
)
def language_profile(t: Tables) -> DataFrame:
    from foliospark.operators.language import language_profile as profile

    fitted = profile(t.documents)
    return fitted.select(
        "lang",
        "gram",
        F.round("log_p", 6).alias("log_p"),
        F.round("unseen_log_p", 6).alias("unseen_log_p"),
    )


@register(
    "detect_language",
    f"""
    with {_GRAMS} {_PROFILE},
    scores as (
        select d.doc_id, m.lang, sum(d.tf * ln((coalesce(k.n, 0) + 1) / m.mass)) as score
        from per_doc d
        join best b on b.gram = d.gram
        join mass m on true
        left join known k on k.gram = d.gram and k.lang = m.lang
        group by d.doc_id, m.lang
    ),
    winners as (
        select doc_id, lang from (
            select *, row_number() over (partition by doc_id order by score desc, lang) as place
            from scores
        ) r where place = 1
    )
    select d.doc_id,
        case when {sql.words('d.text')} >= {fixed.MIN_LANGUAGE_WORDS}
            then coalesce(w.lang, 'unknown') else 'unknown' end as detected_language
    from {{documents}} d left join winners w on w.doc_id = d.doc_id
    """,
)
def detect_language(t: Tables) -> DataFrame:
    model = LanguageModel.fit(t.documents)
    return model.detect(t.documents).select("doc_id", "detected_language")


# Codes beyond the four of the documents, so that the fallback is met.
_CODES = """
select doc_id, case doc_id % 6 when 0 then 'unknown' when 1 then 'sv' when 2 then 'zh-cn'
    else lang end as code
from {documents}
"""


@register(
    "language_name",
    "select doc_id, code, coalesce(n.name, upper(code)) as language_name from "
    f"({_CODES}) c left join (values "
    + ", ".join(f"('{k}', '{v}')" for k, v in fixed.LANGUAGE_NAMES.items())
    + ") n(key, name) on n.key = c.code",
)
def language_name(t: Tables) -> DataFrame:
    codes = t.derive(_CODES)
    return codes.select("doc_id", "code", lang.language_name("code").alias("language_name"))


@register(
    "non_english",
    f"select doc_id, code not in ('en', 'unknown') as is_non_english from ({_CODES}) c",
)
def non_english(t: Tables) -> DataFrame:
    return t.derive(_CODES).select("doc_id", lang.is_non_english("code").alias("is_non_english"))


# --------------------------------------------------------------------------------------- images

# Each embedding becomes a one-channel page with one row per value; three quarters of the pages are
# pushed to white, black and a dark top.
_LEVEL = {
    "spark": "cast(floor(abs(cast(x as double)) * 2000) as int) % 256",
    "duckdb": "cast(floor(abs(cast(x as double)) * 2000) as int) % 256",
}


@register(
    "page_quality",
    f"""
    with levels as (
        select id as origin, list_transform(embedding, lambda x, i: case id % 4
            when 0 then 255
            when 1 then 0
            when 2 then case when i <= 32 then 10 else 200 + ({_LEVEL['duckdb']}) % 56 end
            else {_LEVEL['duckdb']} end) as g
        from (select vec_id as id, embedding from {{embeddings}}) e
    ),
    measured as (
        select origin, len(g) as n, g,
            len(list_filter(g, lambda v: v >= {fixed.WHITE_LEVEL})) / len(g) as white_share,
            len(list_filter(g, lambda v: v <= {fixed.BLACK_LEVEL})) / len(g) as black_share,
            list_avg(g) as mean_level,
            greatest(1, len(g) // {fixed.BANDS}) as band
        from levels
    )
    select origin, round(white_share, 6) as white_share, round(black_share, 6) as black_share,
        round(mean_level, 6) as mean_level, mean_level < {fixed.DARK_PAGE_MEAN} as dark_page,
        case when mean_level < {fixed.DARK_PAGE_MEAN} then 0 else
            len(list_filter(range(0, n, band),
                lambda s: list_avg(g[s + 1 : s + band]) < {fixed.DARK_BAND_MEAN})) end as dark_bands,
        case when white_share >= {fixed.BLANK_SHARE} then {sql.quoted(fixed.BLANK_WHITE_ERROR)}
            when black_share >= {fixed.BLANK_SHARE} then {sql.quoted(fixed.BLANK_BLACK_ERROR)} end
            as error
    from measured
    """,
)
def page_quality(t: Tables) -> DataFrame:
    level = F.expr(
        "transform(embedding, (x, i) -> case id % 4 when 0 then 255 when 1 then 0 when 2 then "
        f"case when i < 32 then 10 else 200 + ({_LEVEL['spark']}) % 56 end else {_LEVEL['spark']} end)"
    )
    pages = t.embeddings.withColumnRenamed("vec_id", "id").withColumn("g", level)
    digits = F.array_join(F.transform("g", lambda v: F.lpad(F.hex(v), 2, "0")), "")
    image = F.struct(
        F.col("id").cast("string").alias("origin"),
        F.size("g").alias("height"),
        F.lit(1).alias("width"),
        F.lit(1).alias("nChannels"),
        F.lit(0).alias("mode"),
        F.unhex(digits).alias("data"),
    )
    found = measure_pages(pages.select(image.alias("image")))
    return found.select(
        F.col("origin").cast("bigint").alias("origin"),
        *[F.round(c, 6).alias(c) for c in ("white_share", "black_share", "mean_level")],
        "dark_page",
        "dark_bands",
        "error",
    )
