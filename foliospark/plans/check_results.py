"""Registered queries: result packing, response, log and card."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions import results as rs
from foliospark.functions.dispatch import gated_invoice_fields
from foliospark.functions.invoice import FIELD_NAMES
from foliospark.functions.text import word_count
from foliospark.plans import oracle_parts as sql
from foliospark.plans.registry import register
from foliospark.plans.rendered import SCORED, Tables

# Class order is alphabetical.
CLASSES = ["Email", "Invoice", "Questionnaire", "Resume"]
SHARES = ["p_email", "p_invoice", "p_form", "p_resume"]


def scored(t: Tables) -> DataFrame:
    """Rendered invoices with class scores, as the input of the packing."""
    rows = t.derive(SCORED)
    ranked = rs.rank_scores(CLASSES, [F.col(p) for p in SHARES])
    return rows.withColumn("all_scores", ranked)


def results(t: Tables, fields: bool = True) -> DataFrame:
    """Packed results; ``fields`` runs the gated invoice extraction."""
    rows = scored(t).withColumn("word_count", word_count("text"))
    if fields:
        label = rs.top_class("all_scores")["label"]
        rows = rows.withColumn("invoice_fields", gated_invoice_fields(label, F.col("text")))
    return rs.pack_result(rows.withColumnRenamed("text", "raw_text"))


_RANKED = f"""
    scored as ({SCORED}),
    flat as (
        {" union all ".join(
            f"select doc_id, {i} as position, '{c}' as class, {p} as share from scored"
            for i, (c, p) in enumerate(zip(CLASSES, SHARES)))}
    ),
    ranked as (
        select *, row_number() over (partition by doc_id order by share desc, position) as place
        from flat
    )"""

_AN = "case when substr(upper(r.class), 1, 1) in ('A', 'E', 'I', 'O', 'U') then 'an' else 'a' end"
_LANGUAGE = "case s.detected_language when 'fr' then 'French' when 'en' then 'English' else upper(s.detected_language) end"
_PACKED = f"""
    {_RANKED},
    packed as (
        select s.*, r.class, upper(r.class) as label_shown, r.share as confidence,
            r.share < {fixed.UNCERTAIN_BELOW} as is_uncertain,
            case when r.share < {fixed.UNCERTAIN_BELOW}
                then 'Uncertain — closest match is ' || upper(r.class) || '.'
                else 'This is ' || {_AN} || ' ' || upper(r.class) || '.' end as summary,
            {sql.words('s.text')} as word_count,
            {_LANGUAGE} as language_name,
            s.detected_language not in ('en', 'unknown') as is_non_english,
            cast(format('{{:.1f}}', r.share * 100) as double) as percent,
            r.class = 'Invoice' as shows_fields,
            {sql.amount('s.true_total_cents')} as true_amount
        from scored s join ranked r on r.doc_id = s.doc_id and r.place = 1
    )"""
_TRUTH = {
    "invoice_number": "true_number",
    "invoice_date": "true_issued",
    "due_date": "true_due",
    "issuer_name": "true_issuer",
    "recipient_name": "true_recipient",
    "total_amount": "true_amount",
}


@register(
    "rank_scores",
    f"with {_RANKED} select doc_id, place, class as label, share as confidence from ranked",
)
def rank_scores(t: Tables) -> DataFrame:
    ranked = scored(t).select("doc_id", F.posexplode("all_scores").alias("at", "s"))
    return ranked.select(
        "doc_id", (F.col("at") + 1).alias("place"), "s.label", "s.confidence"
    )


@register(
    "top_class",
    f"with {_PACKED} select doc_id, class as label, confidence from packed",
)
def top_class(t: Tables) -> DataFrame:
    top = rs.top_class("all_scores")
    return scored(t).select(
        "doc_id", top["label"].alias("label"), top["confidence"].alias("confidence")
    )


@register("uncertain", f"with {_PACKED} select doc_id, is_uncertain from packed")
def uncertain(t: Tables) -> DataFrame:
    top = rs.top_class("all_scores")["confidence"]
    return scored(t).select("doc_id", rs.is_uncertain(top).alias("is_uncertain"))


@register("summary", f"with {_PACKED} select doc_id, summary from packed")
def summary(t: Tables) -> DataFrame:
    top = rs.top_class("all_scores")
    return scored(t).select("doc_id", rs.summary(top["label"], top["confidence"]).alias("summary"))


@register("percent", f"with {_PACKED} select doc_id, percent from packed")
def percent(t: Tables) -> DataFrame:
    top = rs.top_class("all_scores")["confidence"]
    return scored(t).select("doc_id", rs.percent(top).alias("percent"))


@register(
    "confidence_tier",
    f"""
    with {_PACKED} select doc_id, case when percent >= {fixed.TIER_HIGH} then 'high'
        when percent >= {fixed.TIER_MID} then 'mid' else 'low' end as tier from packed
    """,
)
def confidence_tier(t: Tables) -> DataFrame:
    top = rs.percent(rs.top_class("all_scores")["confidence"])
    return scored(t).select("doc_id", rs.confidence_tier(top).alias("tier"))


@register(
    "engine_label",
    f"""
    select doc_id, case ocr_engine when 'easyocr' then 'EasyOCR (handwriting)' else 'Tesseract' end
        as engine from ({SCORED}) s
    """,
)
def engine_label(t: Tables) -> DataFrame:
    return t.derive(SCORED).select("doc_id", rs.engine_label("ocr_engine").alias("engine"))


def _warning(words: str, foreign: str, name: str) -> str:
    few = fixed.FEW_WORDS_WARNING.split("%d")
    tongue = fixed.LANGUAGE_WARNING.split("%s")
    parts = (
        f"case when {words} < {fixed.LOW_QUALITY_WORDS} then {sql.quoted(few[0])} || {words} || "
        f"{sql.quoted(few[1])} end, "
        f"case when {foreign} then {sql.quoted(tongue[0])} || {name} || {sql.quoted(tongue[1])} end"
    )
    return f"nullif(concat_ws(' ', {parts}), '')"


@register(
    "warnings",
    f"""
    select doc_id, n < {fixed.LOW_QUALITY_WORDS} or foreign_text as warning,
        {_warning('n', 'foreign_text', 'name')} as warning_msg
    from (
        select doc_id, {sql.words('text')} as n, lang <> 'en' as foreign_text,
            case lang when 'fr' then 'French' when 'de' then 'German' when 'es' then 'Spanish' end
                as name
        from {{documents}}
    ) d
    """,
)
def warnings(t: Tables) -> DataFrame:
    words = word_count("text")
    return t.documents.select(
        "doc_id",
        (rs.low_quality(words) | rs.is_non_english("lang")).alias("warning"),
        rs.warning_message(words, "lang").alias("warning_msg"),
    )


@register(
    "gated_extraction",
    f"""
    with {_PACKED}
    select doc_id, shows_fields as has_fields,
        {", ".join(f"case when shows_fields then {v} end as {k}" for k, v in _TRUTH.items())}
    from packed
    """,
)
def gated_extraction(t: Tables) -> DataFrame:
    label = rs.top_class("all_scores")["label"]
    fields = gated_invoice_fields(label, F.col("text"))
    found = scored(t).select("doc_id", fields.alias("f"))
    return found.select(
        "doc_id", F.col("f").isNotNull().alias("has_fields"), *[f"f.{n}" for n in FIELD_NAMES[:-1]]
    )


@register(
    "pack_result",
    f"""
    with {_PACKED}
    select file, label_shown as label, confidence, is_uncertain, summary, ocr_engine, word_count,
        detected_language, language_name, is_non_english, text as raw_text,
        case when shows_fields then true_number end as invoice_number
    from packed
    """,
)
def pack_result(t: Tables) -> DataFrame:
    packed = results(t)
    number = F.col("invoice_fields.invoice_number").alias("invoice_number")
    return packed.select(
        *[c for c in packed.columns if c not in ("all_scores", "invoice_fields")], number
    )


@register(
    "result_json",
    f"""
    with {_PACKED}
    select file, label_shown as label, confidence, word_count,
        substr(text, 1, {fixed.PREVIEW_CHARS}) as raw_text_preview
    from packed
    """,
)
def result_json(t: Tables) -> DataFrame:
    stored = rs.with_preview(results(t, fields=False))
    return stored.select("file", "label", "confidence", "word_count", "raw_text_preview")


@register(
    "preview_of_documents",
    f"select doc_id, substr(text, 1, {fixed.PREVIEW_CHARS}) as raw_text_preview from {{documents}}",
)
def preview_of_documents(t: Tables) -> DataFrame:
    named = t.documents.select("doc_id", F.col("text").alias("raw_text"))
    return rs.with_preview(named)


@register(
    "api_response",
    f"""
    with {_PACKED},
    texts as (
        select doc_id, string_agg(class || '=' || format('{{:.1f}}', share * 100), ' ' order by place)
            as scores
        from ranked group by doc_id
    )
    select p.file, p.label_shown as label, p.percent as confidence, p.is_uncertain, p.summary,
        t.scores, p.ocr_engine, p.word_count, {sql.strip('p.text')} as text_preview,
        p.detected_language, p.language_name, p.is_non_english,
        p.word_count < {fixed.LOW_QUALITY_WORDS} or p.is_non_english as warning,
        {_warning('p.word_count', 'p.is_non_english', 'p.language_name')} as warning_msg,
        case when p.shows_fields then p.true_amount end as total_amount
    from packed p join texts t on t.doc_id = p.doc_id
    """,
)
def api_response(t: Tables) -> DataFrame:
    response = rs.to_response(results(t))
    scores = F.array_join(
        F.transform(
            "all_scores",
            lambda s: F.concat(s["label"], F.lit("="), s["confidence"].cast("string")),
        ),
        " ",
    )
    return response.withColumn("scores", scores).withColumn(
        "total_amount", F.col("invoice_fields.total_amount")
    ).drop("all_scores", "invoice_fields")


@register(
    "display_fields",
    f"""
    with {_PACKED}
    select file, label_shown as label,
        case when percent >= {fixed.TIER_HIGH} then 'high'
            when percent >= {fixed.TIER_MID} then 'mid' else 'low' end as tier,
        case ocr_engine when 'easyocr' then 'EasyOCR (handwriting)' else 'Tesseract' end as engine,
        {", ".join(
            f"case when shows_fields then coalesce({v}, '{fixed.EM_DASH}') end as {k}"
            for k, v in _TRUTH.items())},
        text as text_shown
    from packed
    """,
)
def display_fields(t: Tables) -> DataFrame:
    return rs.display_fields(rs.to_response(results(t)))


_FIELD_LINES = " || chr(10) || ".join(
    ["'--- Invoice fields ---'"]
    + [f"'  {k:<16}: ' || coalesce({v}, 'None')" for k, v in _TRUTH.items()]
)


@register(
    "debug_log",
    f"""
    with {_PACKED}
    select file,
        '20240102_030405_' || regexp_replace(file, '[^{sql.WORD}\\-.]', '_', 'g') || '.txt' as log_name,
        '=== OCR DEBUG ===' || chr(10) || 'File      : ' || file || chr(10)
            || 'Engine    : ' || ocr_engine || chr(10) || 'Words     : ' || word_count || chr(10)
            || 'Label     : ' || label_shown || chr(10)
            || case when shows_fields then {_FIELD_LINES} || chr(10) else '' end
            || '=================' || chr(10) || chr(10) || text as log
    from packed
    """,
)
def debug_log(t: Tables) -> DataFrame:
    return rs.debug_log(results(t), F.lit("2024-01-02 03:04:05").cast("timestamp"))


_BAR = (
    "'    ' || rpad(class, 18, ' ') || ' ' "
    "|| lpad(format('{:.1f}', share * 100) || '%', 5, ' ') || '  ' "
    "|| repeat('█', cast(floor(share * 20) as int))"
)


@register(
    "result_card",
    f"""
    with {_PACKED},
    bars as (
        select doc_id, string_agg({_BAR}, chr(10) order by place) as bars from ranked group by doc_id
    )
    select p.file, repeat('=', 56) || chr(10) || '  CLASSIFICATION RESULT' || chr(10)
        || repeat('=', 56) || chr(10) || '  File         : ' || p.file || chr(10)
        || '  Label        : ' || p.label_shown
        || case when p.is_uncertain then '  [UNCERTAIN]' else '' end || chr(10)
        || '  Confidence   : ' || format('{{:.1f}}', p.confidence * 100) || '%' || chr(10)
        || '  OCR engine   : ' || p.ocr_engine || chr(10)
        || '  Words found  : ' || p.word_count || chr(10)
        || chr(10) || '  All scores:' || chr(10) || b.bars || chr(10) || repeat('=', 56) || chr(10)
        || chr(10) || '--- RAW TEXT ---' || chr(10) || chr(10)
        || substr(p.text, 1, {fixed.CARD_CHARS})
        || case when length(p.text) > {fixed.CARD_CHARS} then chr(10) || chr(10) || '  … ['
            || format('{{:,}}', length(p.text) - {fixed.CARD_CHARS}) || ' more characters]' else '' end
        as card
    from packed p join bars b on b.doc_id = p.doc_id
    """,
)
def result_card(t: Tables) -> DataFrame:
    return rs.result_card(results(t, fields=False))
