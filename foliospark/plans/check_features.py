"""Registered queries: tokens, structural counts, vocabulary and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions import features as ff
from foliospark.operators import features as fo
from foliospark.plans import oracle_parts as sql
from foliospark.plans.registry import register
from foliospark.plans.rendered import ALL_TEXTS, CORPUS, Tables
from foliospark.session import materialise

NAMES = fo.STRUCTURAL_NAMES


@register(
    "clean_text",
    """
    select doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') as tokens
    from {documents}
    """,
)
def clean_text(t: Tables) -> DataFrame:
    tokens = F.array_join(ff.clean_tokens("text"), " ")
    return t.documents.select("doc_id", tokens.alias("tokens"))


@register(
    "stop_filter",
    f"""
    select doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z]+'),
        lambda w: length(w) > 2 and w not in {sql.STOP}), ' ') as tokens
    from {{documents}}
    """,
)
def stop_filter(t: Tables) -> DataFrame:
    tokens = F.array_join(ff.remove_stopwords(ff.clean_tokens("text")), " ")
    return t.documents.select("doc_id", tokens.alias("tokens"))


_TOKENS = f"with {sql.tokens('(select * from {documents})')}"
_CORPUS_TOKENS = f"with {sql.tokens('(' + ALL_TEXTS + ')')}"


@register(
    "lemmatise",
    f"""
    {_CORPUS_TOKENS}
    select doc_id, string_agg(token, ' ' order by n) as tokens from kept group by doc_id
    """,
)
def lemmatise(t: Tables) -> DataFrame:
    tokens = ff.lemmatise(ff.remove_stopwords(ff.clean_tokens("text")))
    joined = t.derive(ALL_TEXTS).select("doc_id", F.array_join(tokens, " ").alias("tokens"))
    return joined.where(F.col("tokens") != "")


# A lemma table taken from the data: every part name word stands for the part's first word.
@register(
    "lemmatise_with_table",
    """
    with words as (select distinct lower(n_name) as form, 'nation' as lemma from {nation}),
    pieces as (
        select c.doc_id, unnest(w) as form, generate_subscripts(w, 1) as n
        from (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as w from ("""
    + CORPUS
    + """) x) c
    )
    select p.doc_id, string_agg(coalesce(l.lemma, p.form), ' ' order by p.n) as tokens
    from pieces p left join words l on l.form = p.form group by p.doc_id
    """,
)
def lemmatise_with_table(t: Tables) -> DataFrame:
    lemmas = t.nation.select(F.lower("n_name").alias("form"), F.lit("nation").alias("lemma")).distinct()
    tokens = t.derive(CORPUS).select("doc_id", ff.clean_tokens("text").alias("tokens"))
    replaced = fo.lemmatise_with(tokens, lemmas)
    return replaced.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@register("ngrams", f"{_TOKENS} select doc_id, term, tf from counted")
def ngrams(t: Tables) -> DataFrame:
    return fo.document_terms(t.documents)


@register(
    "vocabulary",
    f"{_TOKENS}, {sql.vocabulary()} select term, term_index, df, cf from vocab",
)
def vocabulary(t: Tables) -> DataFrame:
    return fo.fit_vocabulary(fo.document_terms(t.documents))


_IDF = "ln((1.0 + (select count(*) from {documents})) / (1 + v.df)) + 1"


@register(
    "idf",
    f"{_TOKENS}, {sql.vocabulary()} select v.term, round({_IDF}, 6) as idf from vocab v",
)
def idf(t: Tables) -> DataFrame:
    fitted = fo.fit_idf(fo.fit_vocabulary(fo.document_terms(t.documents)), t.documents)
    return fitted.select("term", F.round("idf", 6).alias("idf"))


@register(
    "sublinear_tf",
    f"{_TOKENS} select doc_id, term, round(1 + ln(tf), 6) as weight from counted",
)
def sublinear_tf(t: Tables) -> DataFrame:
    weight = F.round(fo.sublinear_tf(F.col("tf")), 6)
    return fo.document_terms(t.documents).select("doc_id", "term", weight.alias("weight"))


_WEIGHTS = f"""
    {_TOKENS}, {sql.vocabulary()},
    raw as (
        select c.doc_id, v.term_index, (1 + ln(c.tf)) * ({_IDF}) as w
        from counted c join vocab v on v.term = c.term
    ),
    norms as (select doc_id, sqrt(sum(w * w)) as norm from raw group by doc_id)"""


@register(
    "tfidf",
    f"""
    {_WEIGHTS}
    select d.doc_id, r.term_index, round(r.w / n.norm, 6) as weight
    from {{documents}} d left join norms n on n.doc_id = d.doc_id
    left join raw r on r.doc_id = d.doc_id
    """,
)
def tfidf(t: Tables) -> DataFrame:
    weights = fo.tfidf_long(fo.FeatureModel.fit(t.documents), t.documents)
    return weights.select("doc_id", "term_index", F.round("weight", 6).alias("weight"))


_COUNTS = ", ".join(
    f"{sql.structural_count('text', pattern)} as {name}"
    for name, pattern in fixed.STRUCTURAL_FEATURES.items()
)


@register("structural_features", f"select doc_id, {_COUNTS} from ({ALL_TEXTS}) t")
def structural_features(t: Tables) -> DataFrame:
    return t.derive(ALL_TEXTS).select("doc_id", *ff.structural_counts("text"))


_DAMPED = ", ".join(f"ln(1 + {n}) as {n}" for n in NAMES)
_TOPS = ", ".join(f"max({n}) as {n}" for n in NAMES)
_SCALED = ", ".join(f"round(d.{n} / case when m.{n} = 0 then 1 else m.{n} end, 6) as {n}" for n in NAMES)
_SCALING = f"""
    counts as (select doc_id, {_COUNTS} from ({ALL_TEXTS}) t),
    damped as (select doc_id, {_DAMPED} from counts),
    tops as (select {_TOPS} from damped)"""


def damped(t: Tables) -> DataFrame:
    counts = [ff.damped(c).alias(n) for n, c in zip(NAMES, ff.structural_counts("text"))]
    return t.derive(ALL_TEXTS).select("doc_id", *counts)


@register(
    "log_damping",
    f"with {_SCALING} select doc_id, {', '.join(f'round({n}, 6) as {n}' for n in NAMES)} from damped",
)
def log_damping(t: Tables) -> DataFrame:
    return damped(t).select("doc_id", *[F.round(n, 6).alias(n) for n in NAMES])


@register("maxabs_scale", f"with {_SCALING} select d.doc_id, {_SCALED} from damped d, tops m")
def maxabs_scale(t: Tables) -> DataFrame:
    # read by the maxima and by the scaling: the texts are written out and counted once
    features = materialise(damped(t), "damped")
    scaled = fo.apply_maxabs(features, fo.fit_maxabs(features, NAMES), NAMES)
    return scaled.select("doc_id", *[F.round(n, 6).alias(n) for n in NAMES])


_LONG_STRUCTURAL = " union all ".join(
    f"select doc_id, {i} as position, {n} as v from damped" for i, n in enumerate(NAMES)
)


@register(
    "feature_vector",
    f"""
    {_WEIGHTS},
    counts as (select doc_id, {_COUNTS} from {{documents}}),
    damped as (select doc_id, {_DAMPED} from counts),
    flat as ({_LONG_STRUCTURAL}),
    tops as (select position, max(v) as top from flat group by position)
    select r.doc_id, r.term_index as position, round(r.w / n.norm, 6) as value
    from raw r join norms n on n.doc_id = r.doc_id
    union all
    select f.doc_id, (select count(*) from vocab) + f.position, round(f.v / t.top, 6)
    from flat f join tops t on t.position = f.position where f.v <> 0
    """,
)
def feature_vector(t: Tables) -> DataFrame:
    vectors = fo.FeatureModel.fit(t.documents).vectors(t.documents)
    opened = vectors.select("doc_id", F.unwrap_udt("features").alias("v"))
    pairs = F.explode(F.arrays_zip("v.indices", "v.values")).alias("e")
    return opened.select("doc_id", pairs).select(
        "doc_id", F.col("e.indices").alias("position"), F.round("e.values", 6).alias("value")
    )


@register(
    "matrix_shape",
    f"""
    {_TOKENS}, {sql.vocabulary()}
    select (select count(*) from {{documents}}) as documents, count(*) as tfidf_features,
        {len(NAMES)} as structural_features, count(*) + {len(NAMES)} as total_features
    from vocab
    """,
)
def matrix_shape(t: Tables) -> DataFrame:
    return fo.matrix_shape(t.documents, fo.fit_vocabulary(fo.document_terms(t.documents)))
