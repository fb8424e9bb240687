"""Classifiers on held-out rows, and their odd inputs."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from foliospark.llm import language_id, quality, subword, toxicity

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


def remainder(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


@pytest.mark.parametrize(
    "kind, module, divisor, rest, accuracy", [("quality", quality, 5, 0, 0.99), ("toxic", toxicity, 4, 2, 0.95)]
)
def test_held_out_rows(spark, kind, module, divisor, rest, accuracy):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    scored = module.scored(docs.join(labels, "doc_id", "left_semi"), module.fit(docs, labels))
    rows = scored.join(labels, "doc_id").toPandas()
    assert (rows.held_out == [remainder(d, divisor) == rest for d in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    out = rows[rows.held_out]
    assert len(out) > 500 and (out.predicted == out[kind]).mean() >= accuracy


def test_only_training_rows_are_learned_from(spark, frame):
    rows = [(i, f"good{i % 3} words here" if i % 2 else f"bad{i % 3} things there") for i in range(300)]
    docs = frame(rows)
    right = [(i, i % 2, 0) for i, _ in rows]
    wrong = [(i, (i % 2) ^ (remainder(i, 5) == 0), 0) for i, _ in rows]  # other labels on held-out rows
    odd = [(None, 1, 0), (5, None, 0), (9999, 1, 0), (3, 1, 0), (1, 7, 0)]
    schema = "doc_id long, quality int, toxic int"
    one = quality.fit(docs, frame(right, schema))
    other = quality.fit(docs, frame(wrong + odd[:3], schema))
    assert np.array_equal(one.weights, other.weights)
    assert np.isfinite(quality.fit(docs, frame(right + odd, schema)).weights).all()


def test_misspelt_words_share_grams():
    rng = random.Random(4)
    calm = ["river", "stone", "meadow", "window", "garden", "bottle", "paper", "cloud"]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(calm) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randint(0, 29)] = rng.choice(["horrible", "nastyword"])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = subword.train(pa.array(texts), np.array(labels), toxicity.SETTINGS)
    calm_text = " ".join(calm * 3)
    scores = model.scores(pa.array([calm_text, calm_text + " HORRIBBLE", calm_text + " nastywords"]))
    assert scores[0] < 0.3 and (scores[1:] > 0.3).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(frame, module):
    labels = frame([], "doc_id long, quality int, toxic int")
    rows = [(None, None, 1), (1, "", 1), (1, "", 1), (2, "\t\n", 1), (3, "é" * 300_000, 1), (4, "w " * 200_000, 1)]
    docs = frame(rows, "doc_id long, text string, score int")
    model = module.fit(docs, labels)
    got = module.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    assert module.scored(frame([]), model).count() == 0


def test_pieces_do_not_change_scores(monkeypatch):
    texts = pa.array(["some words", "", None, "Ähnliche Wörter é", "x"] * 20)
    settings = subword.Settings(grams=(1, 3), pairs=True, epochs=2)
    model = subword.train(texts.fill_null(""), np.arange(100) % 2, settings)
    whole = model.scores(texts)
    monkeypatch.setattr(subword.pieces, "__defaults__", (5,))
    assert np.allclose(whole, model.scores(texts))


def test_word_pairs_within_a_text():
    def ids(texts):
        column = pa.array(texts)
        return [b[0].tolist() for b in subword.bags(column, subword.Settings(grams=(), pairs=True))]

    a, b, both = ids(["a b", "b a", "a a"])
    assert len(a) == 3 and len(set(a) & set(b)) == 2 and len(both) == 2
    assert ids(["a b", "c"])[1] == ids(["c"])[0]
    assert set(ids(["q q"])[0]) & set(both) == {0}


def test_language(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = language_id.predicted(docs, language_id.fit(docs)).join(docs, "doc_id").toPandas()
    out = rows[rows.held_out]
    assert len(out) > 20 and (out.lang_pred == out.lang).mean() > 0.95


def test_language_counts(frame):
    """The matrix against counts by hand, over several partitions and flushes."""
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abc d") for _ in range(rng.randint(0, 40))), rng.choice(["x", "y", None])) for i in range(200)]
    rows += [(900, None, "x"), (901, "abc", None)]
    docs = frame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language_id.fit(docs, grams=(1, 2))
    counts = {}
    for doc, text, lang in rows:
        if lang and remainder(doc, 4) != 2:
            grams = counts.setdefault(lang, {})
            for word in (text or "").split():
                padded = f" {word} "
                for gram in [*word, *(padded[i : i + 2] for i in range(len(padded) - 1))]:
                    grams[gram] = grams.get(gram, 0) + 1
    assert model.languages == sorted(counts)
    for k, lang in enumerate(model.languages):
        seen = np.exp(model.logs[k]) * (sum(counts[lang].values()) + 0.5 * 2**15) - 0.5
        assert sorted(np.round(seen[seen > 0.5]).astype(int)) == sorted(counts[lang].values())


def test_odd_languages(frame):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "123 !?", "x", 1), (None, "abc", "y", 1), (4, "abc", "x", 1), (4, "abc", "x", 1)]
    docs = frame(rows, "doc_id long, text string, lang string, score int")
    got = language_id.predicted(docs, language_id.fit(docs)).collect()
    assert len(got) == 6
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"] or 0)][1:4] == ["und"] * 3
    nothing = language_id.fit(docs.where("false"))
    assert {(r["lang_pred"], r["score"]) for r in language_id.predicted(docs, nothing).collect()} == {("und", 0.0)}
    assert language_id.predicted(frame([]), nothing).count() == 0


def test_too_many_languages(frame, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_MATRIX_BYTES", 4 << 16)
    docs = frame([(i, "abc", f"l{i}") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="use fewer bits"):
        language_id.fit(docs)
