"""Nested selection over the count cube: held rows never reach a choice, and plain loops agree."""

import numpy as np
from pyspark.sql import functions as F

from tokenfold.operators import folds as J
from tokenfold.operators import search as X

NAMES, SUBS = [0, 1], [(0,), (1,), (0, 1)]


def made(spark, spoil=None, n=240, c=3):
    rng = np.random.default_rng(6)
    y = rng.integers(0, c, n)
    p = rng.dirichlet(np.ones(c), (n, 2))
    p[np.arange(n), 0, y] += 0.2
    p[np.arange(n), 1, y] += 0.25
    fold = np.arange(n) % 3
    if spoil is not None:  # other labels and probabilities in one fold
        on = fold == spoil
        y[on] = (y[on] + 1) % c
        p[on] = p[on][:, ::-1, ::-1]
    rows = [(i, int(fold[i]), int(y[i]), {j: p[i, j].tolist() for j in range(2)}) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id int, fold int, y int, m map<int,array<double>>"), y, p, fold


def inner_of(spark, n=240):
    d = spark.range(n).select(F.col("id").cast("int").alias("sample_id"), F.concat(F.lit("c"), F.col("id") % 2).alias("label"), (F.col("id") % 3).cast("int").alias("fold"))
    return J.nested_folds(d, 3, 2, 1)


def test_choices_equal_loops(spark):
    df, y, p, fold = made(spark)
    inner = inner_of(spark)
    trials = X.subset_trials(NAMES, SUBS)
    place = {(r["sample_id"], r["outer_fold"]): r["inner_fold"] for r in inner.collect()}
    got = {(r["outer"], r["rule"]): r for r in X.nested_select(X.nested_cube(df, NAMES, trials, inner), trials, 3).collect()}
    hats = [np.argmax(p[:, list(s)].mean(axis=1), axis=1) for s in SUBS]

    def score(rows, hat):
        f = []
        for c in range(3):
            tp = ((y[rows] == c) & (hat[rows] == c)).sum()
            f.append(2 * tp / max((y[rows] == c).sum() + (hat[rows] == c).sum(), 1))
        return sum(f) / 3

    for o in range(3):
        stats = []
        for g, hat in enumerate(hats):
            inside = [score(np.array([i for i in range(len(y)) if place.get((i, o)) == v]), hat) for v in range(2)]
            stats.append((np.mean(inside), np.std(inside, ddof=1) / 2**0.5, len(SUBS[g]), score(np.flatnonzero(fold == o), hat)))
        best = min(range(3), key=lambda g: (-round(stats[g][0], 9), g))
        near = [g for g in range(3) if round(stats[g][0], 9) >= round(stats[best][0] - stats[best][1], 9)]
        plain = min(near, key=lambda g: (stats[g][2], -round(stats[g][0], 9), g))
        for rule, g in (("best", best), ("one_se", plain)):
            r = got[(o, rule)]
            assert r["g"] == g and np.allclose([r["inner_mean"], r["inner_se"], r["held"]], [stats[g][0], stats[g][1], stats[g][3]])


def test_held_rows_never_reach_a_choice(spark):
    inner, trials = inner_of(spark), X.subset_trials(NAMES, SUBS)
    choice = lambda df: {(r["outer"], r["rule"]): (r["g"], r["inner_mean"], r["inner_se"], r["held"])
                         for r in X.nested_select(X.nested_cube(df, NAMES, trials, inner), trials, 3).collect()}
    clean, spoiled = choice(made(spark)[0]), choice(made(spark, spoil=1)[0])
    for rule in ("best", "one_se"):
        assert clean[(1, rule)][:3] == spoiled[(1, rule)][:3] and clean[(1, rule)][3] != spoiled[(1, rule)][3]
        assert clean[(0, rule)][1] != spoiled[(0, rule)][1]  # the other parts do learn from it


def test_cube_edges(spark):
    inner, trials = inner_of(spark), X.subset_trials(NAMES, SUBS)
    empty = made(spark)[0].limit(0)
    cube = X.nested_cube(empty, NAMES, trials, inner)
    assert cube.count() == 0 and X.nested_select(cube, trials, 3).count() == 0
    alone = X.nested_cube(made(spark)[0], NAMES, trials, inner.limit(0))
    assert {r["inner"] for r in alone.collect()} == {X.HELD}
