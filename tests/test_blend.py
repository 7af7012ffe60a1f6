"""Projected Newton blend weights against grids and stationarity; class factors at exact break points."""

import itertools

import numpy as np
import pytest

from tokenfold.operators import search as X
from tokenfold.operators.latent import NotConverged


def made(spark, n, m, c, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, c, n)
    p = rng.dirichlet(np.ones(c), (n, m))
    for j in range(m):
        p[np.arange(n), j, y] += 0.15 * (j + 1)
    p /= p.sum(axis=2, keepdims=True)
    rows = [(int(y[i]), {j: p[i, j].tolist() for j in range(m)}) for i in range(n)]
    return spark.createDataFrame(rows, "y int, m map<int,array<double>>"), y, np.log(np.clip(p, 1e-12, 1))


def objective(w, y, logs, target, l2):
    s = np.einsum("j,njc->nc", w, logs)
    s = s - s.max(axis=1, keepdims=True)
    q = np.exp(s)
    q /= q.sum(axis=1, keepdims=True)
    return -np.log(np.maximum(q[np.arange(len(y)), y], 1e-12)).mean() + l2 * ((w - target) ** 2).sum()


@pytest.mark.parametrize("bounds", [{0: (0, 1), 1: (0, 1), 2: (0, 1)}, {0: (0.3, 0.7), 1: (0.1, 0.4), 2: (0.1, 0.4)}, {0: (0.5, 0.5), 1: (0, 0.2), 2: (0, 1)}])
def test_three_models_reach_the_grid_optimum(spark, bounds):
    df, y, logs = made(spark, 300, 3, 4, 5)
    target = np.array([0.5, 0.25, 0.25])
    got = X.newton_blend(df, bounds, dict(enumerate(target))).collect()
    w = np.array([r["weight"] for r in got])
    assert abs(w.sum() - 1) < 1e-9 and all(lo - 1e-12 <= x <= hi + 1e-12 for x, (lo, hi) in zip(w, bounds.values()))
    best = min(objective(np.array(g), y, logs, target, 0.01) for g in X.simplex_grid(list(bounds), 100, bounds))
    assert objective(w, y, logs, target, 0.01) <= best + 1e-9
    assert got[0]["objective"] == pytest.approx(objective(w, y, logs, target, 0.01), abs=1e-9)


def test_six_models_in_few_steps(spark):
    df, y, logs = made(spark, 400, 6, 3, 8)
    bounds = {j: (0.02, 0.5) for j in range(6)}
    target = np.full(6, 1 / 6)
    got = X.newton_blend(df, bounds, dict(enumerate(target))).collect()
    w = np.array([r["weight"] for r in got])
    assert got[0]["steps"] < 20
    here = objective(w, y, logs, target, 0.01)
    for a, b in itertools.permutations(range(6), 2):  # no feasible exchange of weight improves
        move = np.zeros(6)
        move[a], move[b] = 1e-4, -1e-4
        if w[a] + 1e-4 <= 0.5 and w[b] - 1e-4 >= 0.02:
            assert objective(w + move, y, logs, target, 0.01) >= here - 1e-10
    with pytest.raises(NotConverged):
        X.newton_blend(df, bounds, {0: 0.5, **{j: 0.1 for j in range(1, 6)}}, most_steps=0)


def test_blend_edges(spark):
    empty = spark.createDataFrame([], "y int, m map<int,array<double>>")
    got = X.newton_blend(empty, {0: (0, 1), 1: (0, 1)}, {0: 0.5, 1: 0.5}).collect()
    assert [(r["weight"], r["logloss"], r["steps"]) for r in got] == [(0.5, None, 0)] * 2
    with pytest.raises(ValueError):
        X.newton_blend(empty, {0: (0, 0.2), 1: (0, 0.2)}, {0: 0.5, 1: 0.5})
    holes = spark.createDataFrame([(0, {0: [0.9, 0.1], 1: [0.8, 0.2]}), (1, {0: [0.5, 0.5]}), (None, {0: [0.5, 0.5], 1: [0.5, 0.5]})], "y int, m map<int,array<double>>")
    assert X.newton_blend(holes, {0: (0, 1), 1: (0, 1)}, {0: 0.5, 1: 0.5}, l2=0.0).first()["weight"] == pytest.approx(1.0, abs=1e-6)


def test_thresholds_at_exact_break_points(spark):
    # p_1 / f meets p_0 exactly at f = 0.5: the lower class keeps the row, the next smaller factor moves it
    rows = [(i, i % 2, 1, [0.5, 0.25]) for i in range(6)] + [(6 + i, i % 2, 0, [0.9, 0.1]) for i in range(6)]
    df = spark.createDataFrame(rows, "sample_id int, fold int, y int, p array<double>")
    got = {(r["part"], r["class_id"]): r["factor"] for r in X.class_thresholds(df, 2, [0.5, 1.0], 2, shrinkage=0.0).collect()}
    assert got[(-1, 0)] == 1.0 and got[(-1, 1)] == 1.0
    got = {(r["part"], r["class_id"]): r["factor"] for r in X.class_thresholds(df, 2, [0.4, 0.5, 1.0], 2, shrinkage=0.0).collect()}
    assert got[(-1, 1)] == 0.4
