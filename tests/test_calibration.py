import math

import numpy as np

from foliospark.operators import model as md


def plain_platt(m, positive, high, low):
    """Least cross-entropy of sigmoid(a m + b) against smoothed targets, by Newton in numpy."""
    t = np.where(positive, high, low)
    a, b = 0.0, math.log((positive.sum() + 1) / ((~positive).sum() + 1))
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * m + b)))
        g = np.array([((p - t) * m).sum(), (p - t).sum()])
        v = p * (1 - p)
        h = np.array([[(v * m * m).sum(), (v * m).sum()], [(v * m).sum(), v.sum()]])
        step = np.linalg.solve(h, -g)
        a, b = a + step[0], b + step[1]
        if np.abs(g).sum() < 1e-12:
            break
    return a, b


def test_all_classes_match_plain_newton(spark):
    rng = np.random.default_rng(0)
    n, classes = 400, 3
    labels = rng.integers(0, classes, n)
    margins = rng.normal(size=(n, classes)) + 2.0 * np.eye(classes)[labels] - 1.0
    frame = spark.createDataFrame(
        [(int(l), [float(x) for x in row]) for l, row in zip(labels, margins)], "label_index int, margins array<double>"
    )
    got = md.fit_calibration(frame, classes)
    for k in range(classes):
        positive = labels == k
        inside = positive.sum()
        a, b = plain_platt(margins[:, k], positive, (inside + 1) / (inside + 2), 1 / (n - inside + 2))
        assert abs(got[k][0] - a) < 1e-6 and abs(got[k][1] - b) < 1e-6
        assert got[k][0] > 0


def test_hand_solved_symmetric_case(spark):
    # margins +1 for the class, -1 for the other, equal counts: by symmetry b = 0, and
    # sigmoid(a) = (n + 1) / (n + 2) at the optimum, so a = log(n + 1).
    n = 50
    rows = [(0, [1.0, -1.0])] * n + [(1, [-1.0, 1.0])] * n
    frame = spark.createDataFrame(rows, "label_index int, margins array<double>")
    got = md.fit_calibration(frame, 2)
    for a, b in got:
        assert abs(a - math.log(n + 1)) < 1e-8 and abs(b) < 1e-8


def test_rows_without_margins_or_label_and_steps_that_overshoot(spark):
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 300)
    # far apart margins: the full Newton step from no slope does not lower the loss everywhere
    margins = np.where(labels[:, None] == np.arange(2)[None, :], 40.0, -0.5) + rng.normal(size=(300, 2)) * 5
    rows = [(int(l), [float(x) for x in row]) for l, row in zip(labels, margins)]
    schema = "label_index int, margins array<double>"
    got = md.fit_calibration(spark.createDataFrame(rows, schema), 2)
    for k in range(2):
        positive = labels == k
        inside = positive.sum()
        high, low = (inside + 1) / (inside + 2), 1 / (300 - inside + 2)
        t = np.where(positive, high, low)
        p = 1 / (1 + np.exp(-(got[k][0] * margins[:, k] + got[k][1])))
        assert abs(((p - t) * margins[:, k]).sum()) + abs((p - t).sum()) < 1e-5
    # a row without margins counts in the targets only
    with_gaps = md.fit_calibration(spark.createDataFrame(rows + [(None, None)], schema), 2)
    assert np.allclose(with_gaps, got, atol=1e-8)


def test_calibration_runs_one_pass_a_step(spark):
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 400)
    margins = rng.normal(size=(400, 3)) + 2.0 * np.eye(3)[labels] - 1.0
    frame = spark.createDataFrame(
        [(int(l), [float(x) for x in row]) for l, row in zip(labels, margins)], "label_index int, margins array<double>"
    )
    spark.sparkContext.setJobGroup("calibration", "")
    try:
        md.fit_calibration(frame, 3)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("calibration")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 1 < len(jobs) <= 14  # 5 or 6 steps; two aggregates of several jobs each before
