"""Label-balanced group folds against dealing group by group with plain loops."""

from collections import Counter

import numpy as np
import pytest

from tokenfold.operators import folds as J


def plain(groups: dict, k: int) -> dict:
    """(type, fold) -> groups, dealing every group of a type on its own after the even rounds."""
    labels = sorted({x for g in groups.values() for x in g})
    hist = {g: tuple(Counter(v)[x] for x in labels) for g, v in groups.items()}
    total = np.array([sum(h[i] for h in hist.values()) for i in range(len(labels))], float)
    name = lambda h: "[" + ",".join(f'{{"label":"{x}","n":{n}}}' for x, n in zip(labels, h) if n) + "]"
    held, out = np.zeros((k, len(labels))), Counter()
    for h, n in sorted(Counter(hist.values()).items(), key=lambda x: (-round(float(np.std(x[0])), 9), name(x[0]))):
        for f in range(k):
            out[(h, f)] += n // k
            held[f] += np.array(h) * (n // k)
        for _ in range(n % k):
            tries = []
            for f in range(k):
                held[f] += h
                tries.append((round(float((held / total).std(axis=0).mean()), 9), f))
                held[f] -= h
            least = min(t[0] for t in tries)
            out_f = min((f for s, f in tries if s == least), key=lambda f: (held[f].sum(), f))
            held[out_f] += h
            out[(h, out_f)] += 1
    return {x: n for x, n in out.items() if n}


def made(spark, groups):
    rows = [(f"s{g}_{i}", x, g) for g, v in groups.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "sample_id string, label string, profile string")
    return df.select("sample_id", "label"), df.select("sample_id", "profile")


def groups_of(seed, hot=False):
    rng = np.random.default_rng(seed)
    out = {f"g{i}": rng.choice(["a", "b", "c"], size=rng.integers(1, 6), p=[0.6, 0.3, 0.1]).tolist() for i in range(60)}
    if hot:
        out["hot"] = ["a"] * (sum(map(len, out.values())) // 2)  # a third of all rows
    return out


@pytest.mark.parametrize("seed,hot", [(0, False), (1, True)])
def test_types_are_dealt_like_the_loop(spark, seed, hot):
    groups = groups_of(seed, hot)
    got = J.balanced_group_folds(*made(spark, groups), 4, 42).collect()
    fold = {}
    for r in got:
        assert fold.setdefault(r["profile"], r["fold"]) == r["fold"]
    assert len(got) == sum(map(len, groups.values())) and set(fold.values()) <= set(range(4))
    labels = sorted({x for g in groups.values() for x in g})
    mine = Counter((tuple(Counter(groups[g])[x] for x in labels), f) for g, f in fold.items())
    assert dict(mine) == plain(groups, 4)


def test_more_even_than_majority_dealing(spark):
    groups = groups_of(3)
    s, g = made(spark, groups)
    gap = lambda f: max(r["gap"] for r in J.class_gap(f, 4).collect())
    assert gap(J.balanced_group_folds(s, g, 4, 42)) < gap(J.group_folds(s, g, 4, 42))


def test_edges(spark, monkeypatch):
    s, g = made(spark, {"x": [None, "a"], "y": ["a"], "z": [None]})
    assert J.balanced_group_folds(s, g, 2, 1).filter("fold is null").count() == 0
    assert J.balanced_group_folds(s, g, 2, 1).count() == 4
    assert J.balanced_group_folds(s.limit(0), g, 2, 1).count() == 0
    monkeypatch.setattr(J, "TYPES_PER_BLOCK", 3)  # several blocks: still whole groups, all rows
    groups = groups_of(2)
    got = J.balanced_group_folds(*made(spark, groups), 3, 42)
    assert got.count() == sum(map(len, groups.values())) == got.filter("fold between 0 and 2").count()
    assert got.select("profile", "fold").distinct().count() == len(groups)
