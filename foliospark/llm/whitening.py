"""Whitening of embeddings by an incremental eigendecomposition.

The covariance of the embeddings is taken apart into eigenpairs without ever forming one big matrix of
rows:

1. One pass sums the fit list exactly (count, per-dimension sums, integer scatter matrix), partial
   sums per partition, added up by Spark.  From them the centre ``S/n`` and the exact covariance ``V``.
2. Every partition starts from the empty spectrum and adds its rows one at a time as centred rank-one
   updates ``A + z z^T``: the new eigenvalues are the roots of the secular equation
   ``1 + sum_i w_i^2 / (d_i - t) = 0`` (``w = Q^T z``), found by bisection on shifted origins; equal
   eigenvalues and negligible weights are deflated first; the eigenvectors come from the weights
   recomputed from the roots (Gu and Eisenstat), so they stay orthogonal.
3. Spectra of partitions are combined in a tree of Spark groups: a spectrum ``sum_j l_j q_j q_j^T`` is
   added to another as ``l_j`` rank-one updates with ``z = sqrt(l_j) q_j``.
4. The final basis is refined by Rayleigh-Ritz against the exact ``V``: ``H = Q^T V Q``, its
   eigenvectors ``W``, components ``Q W``.  This makes the components exact to double precision
   whatever the rounding the updates gathered.

Nothing of size growing with the rows passes the driver: one ``d x d`` spectrum per partition goes
through the tree, each group of at most ``FAN`` spectra in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spectra combined in one task of the merge tree.
FAN = 16
#: Components returned for each row.
COMPONENTS = 16
#: Scale and offset of the integer grid the entries are put on.
GRID, OFFSET = 64, 1_000_000
#: Bisection steps of a secular root: enough to reach the resolution of a double from any bracket.
STEPS = 110


# --------------------------------------------------------------------------- rank-one updates


def rank_one(lam: np.ndarray, q: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``q diag(lam) q^T + z z^T``, ``lam`` ascending; returns the same form."""
    d = lam.size
    w = q.T @ z
    norm2 = float(w @ w)
    if norm2 == 0.0:
        return lam, q
    scale = max(abs(lam[-1]), abs(lam[0]), norm2)
    tol = 8 * np.finfo(float).eps * scale
    q = q.copy()
    # deflate equal eigenvalues: a reflection inside each cluster leaves one weight
    start = 0
    while start < d:
        end = start + 1
        while end < d and lam[end] - lam[start] <= tol:
            end += 1
        if end - start > 1:
            part = w[start:end].copy()
            size = float(np.linalg.norm(part))
            if size > 0:
                sign = 1.0 if part[0] >= 0 else -1.0
                v = part
                v[0] += sign * size
                v /= np.linalg.norm(v)
                block = q[:, start:end]
                q[:, start:end] = block - 2.0 * np.outer(block @ v, v)
                w[start:end] = 0.0
                w[start] = -sign * size
        start = end
    active = np.abs(w) > np.sqrt(tol) * 1e-8 * math.sqrt(norm2) / max(1.0, math.sqrt(scale))
    active &= np.abs(w) > 0
    k = int(active.sum())
    if k == 0:
        return lam, q
    dk, wk = lam[active], w[active]
    w2 = wk * wk
    # roots t_j = dk[j] + tau_j, tau_j in (0, gap_j)
    gaps = np.append(np.diff(dk), float(w2.sum()))
    delta = dk[None, :] - dk[:, None]  # delta[j, i] = d_i - d_j
    # safeguarded Newton on each bracket: a Newton point inside the bracket, else its middle
    lo, hi = np.zeros(k), gaps.copy()
    x = 0.5 * (lo + hi)
    eps = np.finfo(float).eps
    for _ in range(STEPS):
        inverse = 1.0 / (delta - x[:, None])
        f = 1.0 + (w2[None, :] * inverse).sum(axis=1)
        slope = (w2[None, :] * inverse * inverse).sum(axis=1)
        neg = f < 0
        lo = np.where(neg, x, lo)
        hi = np.where(neg, hi, x)
        newton = x - f / slope
        inside = (newton > lo) & (newton < hi)
        step_to = np.where(inside, newton, 0.5 * (lo + hi))
        scale_j = np.maximum(np.abs(dk), np.abs(x))
        if np.all((np.abs(step_to - x) <= 4 * eps * scale_j) | (hi - lo <= 2 * eps * scale_j)):
            x = step_to
            break
        x = step_to
    tau = x
    t = dk + tau
    # differences t_j - d_i on shifted origins: (d_j - d_i) + tau_j
    diff = (dk[None, :] - dk[:, None]) + tau[None, :]  # diff[i, j] = t_j - d_i
    # Gu-Eisenstat weights: w_i^2 = prod_j (t_j - d_i) / prod_{j != i} (d_j - d_i), paired as ratios
    # pair numerator j with denominator j below i and j + 1 from i on: every ratio stays near one
    if k > 1:
        gaps_to = dk[None, :] - dk[:, None]  # gaps_to[i, j] = d_j - d_i
        cols = np.arange(k - 1)[None, :]
        den = np.where(cols < np.arange(k)[:, None], gaps_to[:, :-1], gaps_to[:, 1:])
        what2 = diff[:, k - 1] * np.prod(diff[:, :-1] / den, axis=1)
    else:
        what2 = diff[:, 0].copy()
    what = np.sqrt(np.abs(what2)) * np.sign(wk)
    vecs = what[:, None] / (-diff)  # vecs[i, j] = what_i / (d_i - t_j)
    vecs /= np.linalg.norm(vecs, axis=0)[None, :]
    q_active = q[:, active] @ vecs
    lam = lam.copy()
    lam[active] = t
    q[:, active] = q_active
    order = np.argsort(lam, kind="stable")
    return lam[order], q[:, order]


def spectrum_of(rows: np.ndarray, centre: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of the centred scatter of ``rows``, one rank-one update a row."""
    lam, q = np.zeros(d), np.eye(d)
    for row in rows:
        lam, q = rank_one(lam, q, row - centre)
    return lam, q


def merged(spectra: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of spectra, the first taken as it is and the others added as rank-one updates."""
    lam, q = spectra[0]
    for other_lam, other_q in spectra[1:]:
        for j in np.argsort(-other_lam):
            if other_lam[j] > 0:
                lam, q = rank_one(lam, q, math.sqrt(other_lam[j]) * other_q[:, j])
    return lam, q


# --------------------------------------------------------------------------- Spark passes

SPECTRUM = T.StructType(
    [
        T.StructField("group", T.LongType()),
        T.StructField("lam", T.ArrayType(T.DoubleType())),
        T.StructField("q", T.ArrayType(T.DoubleType())),
    ]
)


def cleaned(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``y = floor(64 c)`` (the grid less its offset) of usable rows.

    Dropped: null vectors, vectors with a null, NaN or infinite entry, empty vectors, and vectors whose
    length is not the dimension ``d`` of the table: the most frequent length (ties: the larger).
    """
    entry = F.col(vec_col)
    usable = embeddings.select(F.col(id_col).alias("vec_id"), entry.alias("vec")).where(
        F.col("vec").isNotNull()
        & (F.size("vec") > 0)
        & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    )
    return usable.select(
        "vec_id", F.transform("vec", lambda c: F.floor(c.cast("double") * GRID).cast("long")).alias("y")
    )


def _dimension(rows: DataFrame) -> int | None:
    counts = rows.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return None if counts is None else int(counts["d"])


def _sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray, list[list[int]]]:
    """``n``, ``S`` of ``y`` and the scatter ``sum y y^T``, exact: int64 per partition, decimals across."""

    def partial(batches):
        n, s, m = 0, np.zeros(d, dtype=np.int64), np.zeros((d, d), dtype=np.int64)
        for batch in batches:
            ys = np.array(batch["y"].tolist(), dtype=np.int64).reshape(-1, d)
            n += ys.shape[0]
            s += ys.sum(axis=0)
            m += ys.T @ ys
        yield pd.DataFrame({"n": [n], "sums": [np.concatenate([s, m.ravel()]).tolist()]})

    parts = fit.mapInPandas(partial, "n long, sums array<long>")
    total = (
        parts.select("n", F.posexplode("sums").alias("pos", "v"))
        .groupBy("pos")
        .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        .collect()
    )
    values = dict((int(r["pos"]), int(r["v"])) for r in total)
    n = int(total[0]["n"]) if total else 0
    s = [values[i] for i in range(d)]
    m = [[values[d + i * d + j] for j in range(d)] for i in range(d)]
    return n, s, m


def _tree(fit: DataFrame, centre: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of the partitions, merged ``FAN`` at a time in Spark groups down to one."""

    def per_partition(batches):
        rows = [np.array(batch["y"].tolist(), dtype=float).reshape(-1, d) for batch in batches]
        ys = np.concatenate(rows) if rows else np.zeros((0, d))
        if ys.shape[0] == 0:
            return
        lam, q = spectrum_of(ys, centre, d)
        from pyspark import TaskContext

        yield pd.DataFrame({"group": [TaskContext.get().partitionId()], "lam": [lam.tolist()], "q": [q.ravel().tolist()]})

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        spectra = [(np.array(l), np.array(q).reshape(d, d)) for l, q in zip(frame["lam"], frame["q"])]
        lam, q = merged(spectra)
        return pd.DataFrame({"group": [int(frame["group"].iloc[0]) // FAN], "lam": [lam.tolist()], "q": [q.ravel().tolist()]})

    spectra = fit.mapInPandas(per_partition, SPECTRUM)
    groups = fit.rdd.getNumPartitions()  # partition ids bound the groups; no job to count them
    while groups > 1:
        spectra = (
            spectra.withColumn("key", F.floor(F.col("group") / FAN))
            .groupBy("key")
            .applyInPandas(lambda f: combine(f[["group", "lam", "q"]]), SPECTRUM)
        )
        groups = (groups + FAN - 1) // FAN
    row = spectra.first()
    if row is None:
        return np.zeros(d), np.eye(d)
    return np.array(row["lam"]), np.array(row["q"]).reshape(d, d)


def components(fit: DataFrame, d: int) -> dict:
    """Exact sums, the merged spectrum, and its Rayleigh-Ritz refinement against the exact covariance.

    Returns ``n``, ``S`` (of ``y``), ``vectors`` (``d x d``, columns by falling eigenvalue, the largest
    entry of each positive) and ``values`` (the eigenvalues of ``V``, falling).
    """
    n, s, m = _sums(fit, d)
    if n == 0:
        return {"n": 0, "S": [0] * d, "vectors": np.eye(d), "values": np.zeros(d), "trace": 0.0}
    # n^2 V = n M - S S^T, exact in integers; one division makes V
    v = np.array([[(n * m[i][j] - s[i] * s[j]) for j in range(d)] for i in range(d)], dtype=object)
    cov = (v / (n * n)).astype(float)
    centre = np.array(s, dtype=float) / n
    _, basis = _tree(fit, centre, d)
    basis, _ = np.linalg.qr(basis)
    projected = basis.T @ cov @ basis
    values, rotation = np.linalg.eigh(0.5 * (projected + projected.T))
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], basis @ rotation[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])
    vectors = vectors * np.where(signs == 0, 1.0, signs)[None, :]
    trace = float(sum(v[i][i] for i in range(d))) / (n * n)
    return {"n": n, "S": s, "vectors": vectors, "values": values, "trace": trace}


OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Each usable row against each of the first ``k`` components of the covariance of the fit list.

    The fit list holds each distinct integer vector ``x = floor(64 c) + 1000000`` once.  Rows: ``vec_id``,
    ``component`` (1 for the largest eigenvalue ``e``), ``n``, ``deviation`` = ``sum (n x - S)^2``
    (exact), ``whitened`` = ``(x - S/n) . u / sqrt(e)`` and ``explained`` = ``e / trace(V)``, plus
    ``identity_error``: the largest absolute entry of the covariance of the whitened fit list less the
    identity.  Repeated rows and rows of equal vectors each keep their own rows; null ``vec_id`` stays.

    Defined results: an empty or wholly unusable table gives no rows; a component of eigenvalue zero
    (at most ``1e-12`` of the trace: a constant direction) gets null ``whitened`` and is left out of
    ``identity_error``; ``explained`` is null where the trace is zero.  The components are unit
    eigenvectors of either sign, the same for all rows.  Extra columns of the input are not carried.
    """
    spark = embeddings.sparkSession
    rows = cleaned(embeddings, id_col, vec_col)
    d = _dimension(rows)
    if d is None:
        return spark.createDataFrame([], OUTPUT + ", identity_error double")
    rows = rows.where(F.size("y") == d)
    fit = rows.select("y").distinct()
    found = components(fit, d)
    n, s = found["n"], found["S"]
    k = min(k, d)
    values = found["values"][:k]
    trace = found["trace"]
    alive = values > 1e-12 * max(trace, 0.0)
    basis = found["vectors"][:, :k]
    centre = np.array(s, dtype=float) / n
    scale = np.where(alive, 1.0 / np.sqrt(np.where(alive, values, 1.0)), np.nan)
    explained = (values / trace).tolist() if trace > 0 else [None] * k
    shared = spark.sparkContext.broadcast((basis, centre, scale, n, s, explained))  # d x k: bounded by d

    def project(batches):
        basis, centre, scale, n, s, explained = shared.value
        sums = np.array(s, dtype=object)
        for batch in batches:
            ys = np.array(batch["y"].tolist(), dtype=np.int64).reshape(-1, d)
            white = ((ys - centre) @ basis) * scale[None, :]
            spread = n * ys.astype(object) - sums[None, :]
            deviation = (spread * spread).sum(axis=1)
            m = ys.shape[0]
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"].astype("Int64").repeat(k).reset_index(drop=True),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                    "n": np.full(m * k, n, dtype=np.int64),
                    "deviation": np.repeat(np.array([int(x) for x in deviation], dtype=np.int64), k),
                    "whitened": white.ravel(),
                    "explained": np.tile(np.array(explained, dtype=float), m),
                }
            )

    def moments(batches):
        basis, centre, scale, *_ = shared.value
        count, first, second = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            ys = np.array(batch["y"].tolist(), dtype=np.int64).reshape(-1, d)
            white = np.nan_to_num(((ys - centre) @ basis) * scale[None, :])
            count += ys.shape[0]
            first += white.sum(axis=0)
            second += white.T @ white
        yield pd.DataFrame({"sums": [np.concatenate([[count], first, second.ravel()]).tolist()]})

    totals = (
        fit.mapInPandas(moments, "sums array<double>")
        .select(F.posexplode("sums").alias("pos", "v"))
        .groupBy("pos")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    got = dict((int(r["pos"]), float(r["v"])) for r in totals)
    mean = np.array([got[1 + i] for i in range(k)]) / n
    second = np.array([[got[1 + k + i * k + j] for j in range(k)] for i in range(k)]) / n
    cov = second - np.outer(mean, mean)
    live = np.flatnonzero(alive)
    error = float(np.abs(cov[np.ix_(live, live)] - np.eye(live.size)).max()) if live.size else 0.0
    out = rows.mapInPandas(project, OUTPUT)
    return out.withColumn("whitened", F.when(~F.isnan("whitened"), F.col("whitened"))).withColumn(
        "identity_error", F.lit(error)
    )
