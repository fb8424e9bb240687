"""Per-document feature expressions: tokens, n-grams, term counts, structural counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions.base import by_line, col, count_matches, flags, let, literal_first


def clean_tokens(text: Column | str) -> Column:
    """Lower-case words of the letters a to z; every other character parts words."""
    letters = F.trim(F.regexp_replace(F.lower(col(text)), "[^a-z]+", " "))
    return F.filter(F.split(letters, " "), lambda t: t != "")


def remove_stopwords(tokens: Column | str, stop_words: list[str] | None = None) -> Column:
    """Drop stop words and tokens of one or two letters; repeats stay."""
    words = fixed.STOP_WORDS if stop_words is None else stop_words
    return F.filter(col(tokens), lambda t: (F.length(t) > 2) & ~t.isin(list(words)))


def lemmatise(tokens: Column | str, lemmas: dict[str, str] | None = None) -> Column:
    """Replace listed forms by their lemma.

    For a short table that fits into the expression; ``operators.features.lemmatise_with`` takes a table
    of any size.
    """
    table = fixed.LEMMAS if lemmas is None else lemmas
    pairs = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    # Membership is a hash lookup; the map, which is searched linearly, is only read on a hit.
    return F.transform(
        col(tokens),
        lambda t: F.when(t.isin(list(table)), F.try_element_at(pairs, t)).otherwise(t),
    )


def vector_tokens(tokens: Column | str) -> Column:
    """Tokens the vectoriser accepts: two letters and more."""
    return F.filter(col(tokens), lambda t: F.length(t) >= 2)


def ngrams(tokens: Column | str) -> Column:
    """Single tokens, then pairs of neighbours in the filtered list."""

    def pairs(words: Column) -> Column:
        shorter = F.greatest(F.size(words) - 1, F.lit(0))
        following = F.slice(words, F.lit(2), shorter)
        leading = F.slice(words, F.lit(1), shorter)
        both = F.zip_with(leading, following, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(words, both)

    return let(col(tokens), pairs)


def terms(text: Column | str) -> Column:
    """Raw text to n-gram terms."""
    return ngrams(vector_tokens(lemmatise(remove_stopwords(clean_tokens(text)))))


def term_counts(term_list: Column | str) -> Column:
    """``array<struct<term, tf>>`` in term order.

    Sorting the row's own array and reading off the runs counts its terms without a shuffle of single
    tokens by document.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda start, n: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(at, n + 1), F.size(ordered)) - start).alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return let(
        F.sort_array(col(term_list)), lambda o: F.when(F.size(o) > 0, runs(o)).otherwise(empty)
    )


# Pieces of text without which the feature's pattern cannot match, in lower case.  A plain search for
# them costs a fraction of a regex scan; features without an entry are always scanned.
_NEEDS = {
    "inv_total": ["total"],
    "inv_amount_due": ["due"],
    "inv_invoice_kw": ["invoice"],
    "inv_bill_to": ["bill", "ship", "sold"],
    "inv_subtotal": ["total", "tax", "vat"],
    "inv_number": ["inv"],
    "email_at": ["@"],
    "email_dear": ["dear"],
    "email_regards": ["regards", "sincerely", "wishes", "thank"],
    "email_subject": ["subject"],
    "email_from": [":", "fwd", "forwarded"],
    "res_experience": ["experience", "employment", "history"],
    "res_education": ["education", "degree", "university", "college", "gpa"],
    "res_skills": ["skills", "proficient", "programming", "certif"],
    "res_objective": ["objective", "summary", "profile", "references"],
    "que_checkbox": ["[", "(", "\u25a1", "\u2610", "\u2611", "\u2612"],
    "que_scale": ["agree", "rate", "scale", "likert"],
    "que_circle": ["please"],
}


def _folded(raw: Column) -> Column:
    """Lower case, with the four letters that case-insensitive matching takes for s, i, i and k."""
    for odd, letter in (("\u017f", "s"), ("\u0131", "i"), ("\u0130", "i"), ("\u212a", "k")):
        raw = F.replace(raw, F.lit(odd), F.lit(letter))
    return F.lower(raw)


def _counts(folded: Column, guarded: bool) -> list[Column]:
    out = []
    for name, pattern in fixed.STRUCTURAL_FEATURES.items():
        # The text is folded, so the pattern need not fold every letter again at each place it tries.
        count = count_matches(folded, flags(literal_first(by_line(pattern)), "m"))
        if guarded and name in _NEEDS:
            present = F.lit(False)
            for piece in _NEEDS[name]:
                present = present | F.contains(folded, F.lit(piece))
            count = F.when(present, count).otherwise(0)
        out.append(count.alias(name))
    return out


def structural_counts(text: Column | str, guarded: bool = True) -> list[Column]:
    """One named count per structural feature, on the raw text."""
    return _counts(_folded(F.coalesce(col(text), F.lit(""))), guarded)


def damped(count: Column | str) -> Column:
    return F.log1p(col(count))


def structural_features(text: Column | str) -> Column:
    """Damped counts as one array of 20 doubles; the text is folded once for all of them."""
    folded = _folded(F.coalesce(col(text), F.lit("")))
    return let(folded, lambda f: F.array(*[damped(c) for c in _counts(f, True)]))
