"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenfold.llm import negatives as N

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    fit = [(i, c, [int(np.floor(scale * x)) for x in v]) for i, c, v in rows
           if i is not None and c is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    dim = max([len(v) for _, _, v in fit], default=0)
    fit = [(i, c, v + [0] * (dim - len(v))) for i, c, v in fit]
    out = []
    for i, c, v in {(i, c, tuple(v)) for i, c, v in fit if anchor(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, x)), j, d) for j, d, x in fit if j != i)
        for s, j, _ in [x for x in scored if x[2] == c][:positives]:
            hard = [(t, k) for t, k, d in scored if d != c and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, j, n, k, -s, -t) for n, (t, k) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "v", "tag", "low", "own", "xb", "slices")})
    return sorted(tuple(r) for r in N.hard_negatives(df, F.col("vec_id") % 5 == 0, **more).collect())


def clusters(n, dim, spread, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dim))
    own = rng.integers(0, 4, n)
    x = centre[own] + spread * rng.normal(size=(n, dim))
    return [(i, int(rng.integers(0, 3)), (x[i] / np.linalg.norm(x[i])).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 0.5, 3.0])
def test_negatives_equal_brute_force(spark, spread):
    rows = clusters(300, 6, spread, 5)
    want = brute(rows, lambda i: i % 5 == 0)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, per_block=40, per_anchors=16, pilot=20) == want


def test_negatives_odd_rows(spark):
    same = [1.0, 0.5]
    rows = [
        (0, 1, same), (0, 1, same), (1, 1, [1.0, 0.25]), (1, 1, [1.0, 0.25]), (2, 1, [1.0, 0.25]), (3, 2, [0.75, 0.25]), (4, 2, [0.75, 0.25]),
        (5, None, same), (10, 1, None), (15, 1, []), (20, 1, [1.0, None]), (25, 1, [float("nan"), 1.0]), (30, 1, [float("inf"), 1.0]), (None, 1, same),
        (35, 3, [0.5]), (36, 3, [0.5, 0.5]), (37, 4, [0.0, 0.0]), (40, 5, [-1.0, -1.0]), (41, 5, [0.5, 0.5]), (45, 6, [0.0, 0.0]), (46, 6, [0.0, 0.0]),
    ]
    want = brute(rows, lambda i: i % 5 == 0)
    assert want and mined(spark, rows) == want
    assert {r[0] for r in want} >= {0, 45}


def test_negatives_ties_go_to_smaller_ids(spark):
    rows = [(i, 0, [1.0, 0.0]) for i in range(8)] + [(100 + i, 1, [0.75, float(i % 2)]) for i in range(9)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_negatives_empty_table_and_one_label(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(i, 1, [1.0, float(i)]) for i in range(12)]) == []


def test_lists_show_every_row_that_beats_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (400, 5))
    lists = N.Lists(x, first=4)
    for q in rng.integers(-9, 9, (30, 5)):
        for depth, bound in zip(lists.depths[1:], lists.thresholds(q[None])[0, 1:]):
            unseen = np.setdiff1d(np.arange(400), lists.shown(q, depth))
            assert (x[unseen] @ q <= bound).all()


def test_lists_stop_early_on_separated_vectors(monkeypatch):
    """On vectors with a few large components most of the block is never scored."""
    rng = np.random.default_rng(3)
    x = np.zeros((4000, 8), np.int64)
    x[np.arange(4000), rng.integers(0, 8, 4000)] = rng.integers(1, 5000, 4000)
    q = x[:20].copy()
    read = []
    products = N.products
    monkeypatch.setattr(N, "products", lambda a, b: (read.append(len(b)), products(a, b))[1])
    every = np.ones(4000, bool)
    scores = q @ x.T
    floor = np.sort(scores, axis=1)[:, [-12]]
    top = np.full((20, 1), np.iinfo(np.int64).max)
    got = {i: set(s.tolist()) for i, _, _, s in N.block_best(q, floor, top, x, np.arange(4000), lambda i: every, 3)}
    assert all(got[i] == set(np.sort(scores[i])[-3:].tolist()) for i in got) and len(got) == 20
    assert sum(read[2:]) < 20 * 4000 / 4
