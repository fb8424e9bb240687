import math

import numpy as np
import pytest

from foliospark.llm import whitening as W


def plain(vectors):
    """Components of the covariance of the distinct grid vectors, by numpy."""
    ys = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], dtype=float)
    fit = np.unique(ys, axis=0)
    cov = np.cov(fit.T, bias=True)
    values, vectors_ = np.linalg.eigh(cov)
    order = np.argsort(-values)
    return ys, fit, values[order], vectors_[:, order]


def test_rank_one_updates_match_eigh():
    rng = np.random.default_rng(3)
    rows = rng.integers(-64, 64, size=(200, 12)).astype(float)
    centre = rows.mean(axis=0)
    lam, q = W.spectrum_of(rows, centre, 12)
    expected = np.linalg.eigvalsh((rows - centre).T @ (rows - centre))
    assert np.allclose(lam, expected, rtol=1e-9, atol=1e-6)
    assert np.allclose(q.T @ q, np.eye(12), atol=1e-9)


def test_merged_spectra_equal_whole():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(90, 6))
    centre = rows.mean(axis=0)
    parts = [W.spectrum_of(rows[i::3], centre, 6) for i in range(3)]
    lam, q = W.merged(parts)
    whole = (rows - centre).T @ (rows - centre)
    assert np.allclose(q @ np.diag(lam) @ q.T, whole, atol=1e-9)


def test_repeated_eigenvalues_deflate():
    lam, q = W.spectrum_of(np.eye(5) * 3.0, np.zeros(5), 5)
    assert np.allclose(lam, [9] * 5)
    assert np.allclose(q.T @ q, np.eye(5))


def test_against_numpy(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(120, 8)).astype(np.float32)
    vecs[5] = vecs[4]  # a repeated vector counts once in the fit list
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(vecs)]
    rows.append((1000, [float(c) for c in vecs[4]], 1))  # repeated row again
    rows.append((None, [float(c) for c in vecs[3]], 1))  # null id stays
    rows.append((2000, None, 0))
    rows.append((2001, [1.0, None] + [0.0] * 6, 0))
    rows.append((2002, [float("nan")] * 8, 0))
    rows.append((2003, [float("inf")] + [0.0] * 7, 0))
    rows.append((2004, [0.5, 0.5], 0))  # other length
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = W.whitened(df).toPandas()
    kept = [r for r in rows if r[1] is not None and len(r[1]) == 8 and all(c is not None and math.isfinite(c) for c in r[1])]
    assert len(got) == len(kept) * 8
    assert set(got.component) == set(range(1, 9))
    ys, fit, values, vectors = plain([np.float32(r[1]).astype(float) for r in kept])
    n = len(fit)
    assert (got.n == n).all()
    got = got.assign(key=got.vec_id.fillna(-1))
    for (vec_id, _, _), y in zip(kept, ys):
        mine = got[got.key == (-1 if vec_id is None else vec_id)].sort_values("component").iloc[:8]
        centred = y - fit.sum(axis=0) / n
        expected = (centred @ vectors) / np.sqrt(values)
        assert np.allclose(np.abs(mine.whitened.to_numpy()), np.abs(expected), atol=1e-8)
        assert int(mine.deviation.iloc[0]) == int(((n * y - fit.sum(axis=0)) ** 2).sum())
    assert np.allclose(got.sort_values("component").groupby("component").explained.first(), values / values.sum(), rtol=1e-9)
    assert got.identity_error.iloc[0] < 1e-9


def test_constant_direction_and_empty(spark):
    rows = [(i, [float(i % 7) / 10, 0.25, float(i % 3)], 0) for i in range(30)]
    got = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).toPandas()
    third = got[got.component == 3]
    assert third.whitened.isna().all()  # the constant entry has no spread
    assert got[got.component < 3].whitened.notna().all()
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert W.whitened(empty).count() == 0
    clash = spark.createDataFrame([(1, [0.1, 0.2], "x")], "vec_id long, embedding array<float>, whitened string")
    assert W.whitened(clash).count() == 2
