"""Factorisations in blocks against numpy."""

import re

import numpy as np
import pytest

from tokenfold.operators import blocked as B
from tokenfold.operators import latent as L


def long_table(spark, x):
    rows = [(int(i), f"f{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, "sample_id int, feature string, value double")


def vectors(state, m):
    got = {r["feature"]: r["v"] for r in state.collect()}
    return np.array([got[f"f{j}"] for j in range(m)])


def test_products_in_small_blocks_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((70, 40)) * (rng.random((70, 40)) < 0.3)
    x[0] = x[:, 0] = 1
    blocked = B.Blocked.of(long_table(spark, x), 5, cells=60, per_block=50)
    assert blocked.row_blocks > B.FAN_IN / 4 and blocked.column_blocks > 1
    v = blocked.random(3, lambda r, shape: r.standard_normal(shape))
    dense = {r["feature"]: r["v"] for r in B.named(blocked.columns, "feature", v, 5, "v").collect()}
    dense = np.array([dense[f"f{j}"] for j in range(40)])
    turn = rng.standard_normal((5, 5))
    y = blocked.times(v, turn)
    got = {r["sample_id"]: r["y"] for r in B.named(blocked.rows, "sample_id", y, 5, "y").collect()}
    assert np.allclose([got[i] for i in range(70)], x @ dense @ turn)
    assert np.allclose(blocked.gram(y, blocked.row_blocks), (x @ dense @ turn).T @ (x @ dense @ turn))
    back = {r["feature"]: r["z"] for r in B.named(blocked.columns, "feature", blocked.back(y), 5, "z").collect()}
    assert np.allclose([back[f"f{j}"] for j in range(40)], x.T @ x @ dense @ turn)


def test_128_singular_vectors(spark):
    rng = np.random.default_rng(1)
    x = (rng.random((400, 220)) < 0.2) * rng.integers(1, 4, (400, 220)) * np.linspace(3, 0.3, 220)
    state = L.svd_state(long_table(spark, x), 128, extra=40, cells=20_000)
    v, s = vectors(state, 220), np.array(state.first()["s"])
    want = np.linalg.svd(x, compute_uv=False)[:128]
    assert v.shape == (220, 128) and np.allclose(v.T @ v, np.eye(128), atol=1e-8)
    assert np.abs(s - want).max() <= 1e-3 * want[0] and np.allclose(s[:20], want[:20], rtol=1e-3)
    assert (np.linalg.norm(x.T @ (x @ v) - v * s**2, axis=0) <= 1.01e-3 * want[0] * s).all()


def test_dominant_direction_doesnt_drown_the_others(spark):
    rng = np.random.default_rng(2)
    x = 20 + rng.standard_normal((200, 60))
    s = np.array(L.svd_state(long_table(spark, x), 5, extra=20, tolerance=1e-5).first()["s"])
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False)[:5], rtol=1e-5)


def test_low_rank_and_empty_tables(spark):
    x = np.outer([1.0, 2, 0, 3], [1.0, 1, 2])
    state = L.svd_state(long_table(spark, x), 3)
    assert np.allclose(state.first()["s"][0], np.linalg.norm(x)) and all(abs(a) < 1e-6 for a in state.first()["s"][1:])
    none = spark.createDataFrame([], "sample_id int, feature string, value double")
    assert L.svd_state(none, 3).count() == 0 and L.svd_apply(long_table(spark, x), L.svd_state(none, 3)).count() == 0
    assert L.nmf_state(none, 2).count() == 0 and L.nmf_apply(long_table(spark, x), L.nmf_state(none, 2)).count() == 0
    unseen = spark.createDataFrame([(9, "f0", 1.0), (9, "other", 5.0)], "sample_id int, feature string, value double")
    got = {r["feature"]: r["value"] for r in L.svd_apply(unseen, state).collect()}
    assert np.isclose(got["svd_0"], 1 / np.sqrt(6))


def test_rounds_that_dont_suffice_are_an_error(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = long_table(spark, rng.standard_normal((80, 60)))
    monkeypatch.setattr(L, "MOST_ROUNDS", 1)
    with pytest.raises(L.NotConverged):
        L.svd_state(df, 5, extra=2)
    assert L.svd_state(df, 5, extra=2, rounds=1).count() == 60
    monkeypatch.setattr(L, "MOST_ITERATIONS", 2)
    with pytest.raises(L.NotConverged):
        L.nmf_state(long_table(spark, rng.random((30, 20))), 4)


def test_modules_fit_as_well_as_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.random((60, 3)) @ rng.random((3, 25))
    df = long_table(spark, x)
    state = L.nmf_state(df, 3, tolerance=1e-5)
    v = vectors(state, 25)
    w = np.zeros((60, 3))
    for r in L.nmf_apply(df, state, steps=2000).collect():
        w[r["sample_id"], r["module"]] = r["value"]
    assert (w >= 0).all() and (v >= 0).all() and np.linalg.norm(x - w @ v.T) < 0.02 * np.linalg.norm(x)


def test_few_features_are_solved_without_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.round(rng.random((300, 90)) * (rng.random((300, 90)) < 0.3), 3)  # a flat spectrum, wider than the block of vectors
    x[0] = x[:, 0] = 1
    monkeypatch.setattr(B.Blocked, "of", lambda *a, **k: pytest.fail("a narrow table goes through rounds"))
    df = long_table(spark, x)
    state = L.svd_state(df.unionByName(spark.createDataFrame([(None, "f3", 5.0), (4, None, 5.0)], df.schema)), 8)
    _, s, vt = np.linalg.svd(x)
    first = state.first()
    assert np.allclose(first["s"], s[:8])
    v = vectors(state, 90)
    assert np.allclose(np.abs(v), np.abs(vt[:8].T)) and (v[np.abs(v).argmax(0), range(8)] > 0).all()
    got = {(r["sample_id"], r["feature"]): r["value"] for r in L.svd_apply(df, state).collect()}
    assert np.allclose([[got[i, f"svd_{j}"] for j in range(8)] for i in range(300)], x @ v)


def test_narrow_modules_equal_the_blocked_ones(spark):
    rng = np.random.default_rng(5)
    x = rng.random((60, 30)) * (rng.random((60, 30)) < 0.4)
    x[:, 0] = 1
    table = long_table(spark, x).unionByName(spark.createDataFrame([(None, "f0", 9.0), (3, None, 9.0)], "sample_id int, feature string, value double"))
    narrow, blocked = L.nmf_state(table, 3, iterations=4), L.nmf_state(table, 3, iterations=4, cells=1 << 20)
    assert np.allclose(vectors(narrow, 30), vectors(blocked, 30), rtol=1e-9)
    assert L.nmf_state(table.limit(0), 3, iterations=2).count() == 0


def test_products_do_not_move_standing_entries(spark):
    rng = np.random.default_rng(6)
    x = rng.random((50, 20)) * (rng.random((50, 20)) < 0.5)
    x[:, 0] = x[0] = 1
    blocked = B.Blocked.of(long_table(spark, x), 3, cells=30, per_block=50).standing()
    blocked.entries.count()
    v = blocked.random(1, lambda r, shape: r.random(shape))
    for product in (blocked.times(v), blocked.back(blocked.times(v))):
        plan = product._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange[^\n]*\n([^\n]*Project[^\n]*\n)?[^\n]*InMemoryTableScan", plan)
    blocked.release()
