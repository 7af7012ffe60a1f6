"""Nearest-neighbour mutual information against loops over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenfold.operators import selection as X

PSI = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def plain(x, y, k):
    keep = [i for i in range(len(x)) if sum(b == y[i] for b in y) > 1]
    x, y = x[keep], y[keep]
    n, pk, pl, pm = len(x), 0.0, 0.0, 0.0
    for i in range(n):
        t = sorted(abs(x[j] - x[i]) for j in range(n) if j != i and y[j] == y[i])
        kk = min(k, len(t))
        r = t[kk - 1]
        m = sum(x[j] == x[i] or x[i] - r < x[j] < x[i] + r for j in range(n))
        pk, pl, pm = pk + PSI(kk), pl + PSI(len(t) + 1), pm + PSI(m)
    return max(0.0, PSI(n) + (pk - pl - pm) / n)


def test_digamma(spark):
    got = spark.range(1, 400).select("id", X.digamma(F.col("id")).alias("p")).collect()
    assert all(math.isclose(r["p"], PSI(r["id"]), abs_tol=1e-12) for r in got)


def test_equals_loops(spark):
    rng = np.random.default_rng(3)
    n = 500
    y = np.where(np.arange(n) % 3 == 0, "hot", rng.choice(["a", "b", "c"], n)).astype(object)
    y[7] = "single"
    cols = {"normal": rng.normal(size=n) + (y == "hot"), "ties": rng.integers(0, 9, n).astype(float), "noise": rng.random(n)}
    values = spark.createDataFrame([(i, f, float(v[i])) for f, v in cols.items() for i in range(n)], "sample_id int, feature string, value double")
    samples = spark.createDataFrame([(i, y[i]) for i in range(n)], "sample_id int, label string")
    got = {r["feature"]: r for r in X.neighbour_information(values, samples, 3).collect()}
    for f, v in cols.items():
        assert got[f]["n"] == n - 1 and got[f]["mi"] == pytest.approx(plain(v, y, 3), abs=1e-9)
    assert got["normal"]["mi"] > got["noise"]["mi"]


def test_edges(spark):
    samples = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, "b"), (4, "a")], "sample_id int, label string")
    rows = [(0, "f", 1.0), (1, "f", 2.0), (2, "f", 3.0), (3, "f", 4.0), (4, "f", None), (0, "g", float("nan")), (1, "g", float("inf")), (4, "g", 1.0)]
    got = X.neighbour_information(spark.createDataFrame(rows, "sample_id int, feature string, value double"), samples).collect()
    assert [(r["feature"], r["n"]) for r in got] == [("f", 2)]
    empty = spark.createDataFrame([], "sample_id int, feature string, value double")
    assert X.neighbour_information(empty, samples).count() == 0
