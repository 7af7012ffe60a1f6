"""Invariants and brute-force twins of operators without an oracle query."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenfold.functions import probs as PR
from tokenfold.functions import stats as S
from tokenfold.operators import folds as J
from tokenfold.operators import genes as G
from tokenfold.operators import latent as L
from tokenfold.operators import metrics as M
from tokenfold.operators import proba as P
from tokenfold.operators import search as X
from tokenfold.operators import selection as V
from tokenfold.operators import signatures as Z
from tokenfold.operators.gram import gram


def macro(y, h, classes):
    out = []
    for c in range(classes):
        tp = sum(a == c and b == c for a, b in zip(y, h))
        den = sum(a == c for a in y) + sum(b == c for b in h)
        out.append(2 * tp / den if den else 0.0)
    return sum(out) / classes, out


@pytest.fixture(scope="module")
def table(spark):
    """A small probability table with folds and groups, as rows and as numpy."""
    rng = np.random.default_rng(3)
    n, c = 400, 4
    y = rng.integers(0, c, n)
    p = rng.dirichlet(np.ones(c), n)
    p[np.arange(n), y] += 0.35
    p /= p.sum(axis=1, keepdims=True)
    q = rng.dirichlet(np.ones(c), n)
    q[np.arange(n), y] += 0.4
    q /= q.sum(axis=1, keepdims=True)
    fold = np.arange(n) % 4
    group = rng.integers(0, 3, n)
    rows = [(i, int(fold[i]), int(y[i]), p[i].tolist(), q[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id int, fold int, y int, p array<double>, q array<double>")
    groups = spark.createDataFrame([(i, "burden", int(group[i])) for i in range(n)], "sample_id int, dimension string, grp int")
    return dict(df=df, groups=groups, y=y, p=p, q=q, fold=fold, group=group, c=c, n=n)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.normal(size=500)] + [("b", float(x)) for x in rng.integers(-3, 9, 333)] + [("c", 2.5)]
    df = spark.createDataFrame(rows, "k string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r["k"]: [r[f"q{i}"] for i in range(len(probs))] for r in S.quantiles(df, ["k"], "x", probs).collect()}
    for k in "abc":
        assert np.allclose(got[k], np.quantile([x for g, x in rows if g == k], probs), atol=1e-12)


def test_hash_rank_is_a_row_number(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("k"), F.md5(F.col("id").cast("string")).alias("h"))
    got = S.hash_rank(df, ["k"], "h").collect()
    for k in range(3):
        rows = sorted((r["h"], r["rank"]) for r in got if r["k"] == k)
        assert [r for _, r in rows] == list(range(1, len(rows) + 1))


def test_gram_blocks_agree(spark):
    rng = random.Random(1)
    rows = [(s, i, float(rng.randint(1, 3))) for s in range(60) for i in range(10) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "sample_id int, idx int, value double")
    x = np.zeros((60, 10))
    for s, i, v in rows:
        x[s, i] = v
    want = {(i, j): (x.T @ x)[i, j] for i in range(10) for j in range(i, 10) if (x.T @ x)[i, j]}
    for block in (10, 4):
        for per_task in (7, 1000):
            assert {(r["i"], r["j"]): r["s"] for r in gram(df, block=block, samples_per_task=per_task).collect()} == want
    halves = gram(df.withColumn("fold", F.col("sample_id") % 2), ["fold"], 4).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    assert {(r["i"], r["j"]): r["s"] for r in halves} == want


def test_folds_strata(frame):
    burden = [1, 1, 7, 7, 20, 20]
    samples = frame("sample_id int, label string", *[(i, "AB"[i // 6]) for i in range(12)])
    b = frame("sample_id int, burden int", *[(i, burden[i % 6]) for i in range(12)])
    n = J.strata(samples, b, 2).groupBy("stratum").count().collect()
    assert len(n) == 6 and all(r["count"] >= 2 for r in n)
    few = J.strata(samples, b, 3).select("stratum").distinct().collect()
    assert {r[0] for r in few} == {"CLASS_ONLY=A", "CLASS_ONLY=B"}


def test_group_folds_do_not_overlap(frame):
    samples = frame("sample_id int, label string", *[(i, "AB"[i % 2]) for i in range(60)])
    groups = frame("sample_id int, profile string", *[(i, f"g{i // 4}" if i < 40 else "hot") for i in range(60)])
    audit = J.fold_audit(J.group_folds(samples, groups, 3, 42), groups).collect()
    assert audit and all(r["group_overlap"] == 0 for r in audit)


def test_total_minus_fold_equals_refit(frame):
    rng = random.Random(5)
    samples = frame("sample_id int, label string, fold int", *[(i, "ABC"[i % 3], i % 4) for i in range(90)])
    presence = frame("sample_id int, gene string", *[(i, f"g{g}") for i in range(90) for g in range(8) if rng.random() < 0.3 + 0.1 * (g == i % 3)])
    oof = Z.class_weights(presence, samples, parts=[(k, Z.FULL) for k in range(4)])
    for k in range(4):
        train = samples.filter(F.col("fold") != k)
        refit = Z.class_weights(presence.join(train, "sample_id", "left_semi"), train)
        a = {(r["label"], r["gene"]): round(r["w"], 9) for r in oof.filter(F.col("outer") == k).collect()}
        b = {(r["label"], r["gene"]): round(r["w"], 9) for r in refit.collect()}
        assert a == b


def test_family_signature_out_of_fold(frame):
    rng = random.Random(9)
    samples = frame("sample_id int, label string, fold int", *[(i, "ABCD"[i % 4], (i // 4) % 3) for i in range(96)])
    presence = frame("sample_id int, gene string", *[(i, f"g{g}") for i in range(96) for g in range(8) if rng.random() < 0.3 + 0.3 * (g == i % 4)])
    fam = {"x": ["A", "B"], "y": ["C", "D"]}
    for fn in (Z.family_signature, Z.sibling_signature):
        oof = {(r["sample_id"], r["label"]): round(r["weighted"], 9) for r in fn(presence, samples, fam, 3).collect()}
        train, held = samples.filter("fold <> 1"), samples.filter("fold = 1")
        labels = Z.map_labels(train, fam) if fn is Z.family_signature else train
        sib = None if fn is Z.family_signature else {m: v for v in fam.values() for m in v}
        w = Z.class_weights(presence.join(train, "sample_id", "left_semi"), labels, siblings=sib)
        want = Z.signature_score(presence.join(held, "sample_id", "left_semi"), w).collect()
        assert want and all(oof[(r["sample_id"], r["label"])] == round(r["weighted"], 9) for r in want)


def test_pair_mass_is_kept(frame):
    base = frame("sample_id int, p array<double>, right double", (0, [0.6, 0.3, 0.1], 0.7), (1, [0.1, 0.2, 0.7], 0.4))
    out = P.pair_redistribute(base, {(0, 1): (F.col("right"), 0.5), (1, 2): (F.col("right"), 0.3)}).orderBy("sample_id").collect()
    assert all(math.isclose(sum(r["p"]), 1) for r in out)
    assert math.isclose(out[0]["p"][0] + out[0]["p"][1], 0.9) and math.isclose(out[1]["p"][1] + out[1]["p"][2], 0.9)


def test_blend_and_ties(frame):
    a = frame("sample_id int, p array<double>", (0, [0.7, 0.3]), (1, [0.2, 0.8]))
    b = frame("sample_id int, p array<double>", (0, [0.4, 0.6]), (1, [0.5, 0.5]))
    out = {r["sample_id"]: r["p"] for r in P.blend(a, b, 0.4).collect()}
    assert np.allclose(out[0], [0.58, 0.42]) and np.allclose(out[1], [0.32, 0.68])
    t = frame("p array<double>", ([0.4, 0.4, 0.2],)).select(PR.top_two(F.col("p")).alias("t")).first()["t"]
    assert (t["top1"], t["top2"], t["gap"]) == (0, 1, 0.0)


def test_validate_proba_raises(frame):
    with pytest.raises(ValueError, match="bad_sum"):
        P.validate_proba(frame("sample_id int, p array<double>", (0, [0.7, 0.7])), 2)


def test_bootstrap_matches_simulation(spark):
    rng = np.random.default_rng(1)
    n, c = 600, 3
    y = rng.integers(0, c, n)
    base = np.where(rng.random(n) < 0.6, y, rng.integers(0, c, n))
    cand = np.where(rng.random(n) < 0.7, y, rng.integers(0, c, n))
    df = spark.createDataFrame([(i, int(y[i]), int(base[i]), int(cand[i])) for i in range(n)], "sample_id int, y int, base int, cand int")
    got = np.array([r["delta"] for r in M.bootstrap_deltas(df, 300, 7, c).collect()])
    sim = []
    for _ in range(300):
        idx = np.concatenate([rng.choice(np.flatnonzero(y == k), (y == k).sum()) for k in range(c)])
        sim.append(macro(y[idx], cand[idx], c)[0] - macro(y[idx], base[idx], c)[0])
    assert len(got) == 300
    assert abs(got.mean() - np.mean(sim)) < 0.01 and abs(got.std() / np.std(sim) - 1) < 0.25


def test_class_thresholds_match_loop(table):
    cand, k, c = [0.8, 1.0, 1.25], 4, table["c"]
    got = X.class_thresholds(table["df"].drop("q"), c, cand, k, rounds=2).collect()

    def search(rows):
        y, p = table["y"][rows], np.clip(table["p"][rows], 1e-12, 1)

        def score(f):
            return macro(y, (p / f).argmax(axis=1), c)[0] - 0.01 * float(np.mean(np.log(f) ** 2))

        f, best = np.ones(c), score(np.ones(c))
        for _ in range(2):
            moved = False
            for i in range(c):
                now = (round(best, 9), -abs(math.log(f[i])), None)
                for v in cand:
                    g = f.copy()
                    g[i] = v
                    key = (round(score(g), 9), -abs(math.log(v)))
                    if key > now[:2]:
                        now = (*key, v)
                if now[2] is not None and now[2] != f[i]:
                    f[i], moved = now[2], True
                    best = score(f)
            if not moved:
                break
        return f.tolist()

    for part in [*range(k), -1]:
        rows = np.flatnonzero(table["fold"] != part)
        assert [r["factor"] for r in sorted(got, key=lambda r: r["class_id"]) if r["part"] == part] == search(rows)


def _moved(table, pair, margin, alpha, pred):
    source, target = pair
    p = table["p"]
    order = np.argsort(-p, axis=1, kind="stable")[:, :2]
    gap = p[np.arange(len(p)), order[:, 0]] - p[np.arange(len(p)), order[:, 1]]
    on = (order[:, 0] == target) & (order[:, 1] == source) & (gap <= margin + 1e-12)
    s, t = p[:, source] + alpha * p[:, target], p[:, target] * (1 - alpha)
    out = pred.copy()
    out[on & ((s > t) | ((s == t) & (source < target)))] = source
    return out


def test_rule_evidence_matches_loop(table):
    got = {(r["source"], r["target"], r["margin"], r["alpha"]): r for r in X.rule_evidence(table["df"].drop("q"), table["c"], [0.05, 0.2]).collect()}
    y, base = table["y"], table["p"].argmax(axis=1)
    b0 = macro(y, base, table["c"])[0]
    assert got
    for (s, t, m, a), r in got.items():
        new = _moved(table, (s, t), m, a, base)
        assert r["rescue"] == ((base != y) & (new == y)).sum() and r["harm"] == ((base == y) & (new != y)).sum()
        assert math.isclose(r["gain"], macro(y, new, table["c"])[0] - b0, abs_tol=1e-9)


def test_bidirectional_rule_matches_loop(table):
    """Every qualified rule has the loop's scores, and the loop finds no other one."""
    pair, c, grid = (0, 1), table["c"], [0.1, 0.3]
    y, base, fold, group = table["y"], table["p"].argmax(axis=1), table["fold"], table["group"]
    got = {(r["pm"], r["pa"], r["rm"], r["ra"]): r for r in X.select_bidirectional_rule(
        table["df"].drop("q"), table["groups"], c, pair, 4, grid).collect()}
    masks = [fold == f for f in range(4)]
    b_all, b_cls = macro(y, base, c)
    b_fold = [macro(y[m], base[m], c) for m in masks]
    se = lambda v: float(np.std(v, ddof=1) / 2)
    b_se, b_cse = se([f for f, _ in b_fold]), [se([cl[i] for _, cl in b_fold]) for i in range(c)]
    want, seen = {}, set()
    for pm, pa, rm, ra in itertools.product(grid, repeat=4):
        h = _moved(table, pair[::-1], rm, ra, _moved(table, pair, pm, pa, base))
        if h.tobytes() in seen:
            continue
        seen.add(h.tobytes())
        rescue, harm = int(((base != y) & (h == y)).sum()), int(((base == y) & (h != y)).sum())
        score, cls = macro(y, h, c)
        per = [macro(y[m], h[m], c) for m in masks]
        d = [a - b for (a, _), (b, _) in zip(per, b_fold)]
        dc = [[a[i] - b[i] for (_, a), (_, b) in zip(per, b_fold)] for i in range(c)]
        gd, gm, gdec = [], [], 0
        for g in range(3):
            mg = group == g
            one = macro(y[mg], h[mg], c)[0] - macro(y[mg], base[mg], c)[0]
            fd = [macro(y[mg & m], h[mg & m], c)[0] - macro(y[mg & m], base[mg & m], c)[0] for m in masks if (mg & m).any()]
            s = float(np.std(fd, ddof=1) / math.sqrt(len(fd)))
            gd.append(one)
            gm.append(one + s)
            gdec = max(gdec, sum(v < -s - 1e-12 for v in fd))
        net = [int((((base != y) & (h == y))[m]).sum() - (((base == y) & (h != y))[m]).sum()) for m in masks]
        margin = min(cls[i] - b_cls[i] + b_cse[i] for i in pair)
        gain = [np.mean([cls[i] for i in pair]) - np.mean([b_cls[i] for i in pair]), (h[y == 0] == 0).mean() - (base[y == 0] == 0).mean()]
        ok = (rescue >= 3 and rescue > harm and sum(v > 0 for v in net) >= 2 and score >= b_all - b_se - 1e-12 and sum(v < -se(d) - 1e-12 for v in d) <= 1
              and margin >= -1e-12 and all(sum(v < -se(dc[i]) - 1e-12 for v in dc[i]) < 2 for i in pair) and max(gain) >= 0.05 - 1e-12 and gdec < 2 and min(gm) >= -1e-12)
        if ok:
            want[(pm, pa, rm, ra)] = (rescue, harm, score, margin, min(gm))
    assert set(got) == set(want)
    for k, (rescue, harm, score, margin, gmargin) in want.items():
        r = got[k]
        assert (r["rescue"], r["harm"]) == (rescue, harm)
        assert np.allclose([r["macro_f1"], r["class_margin"], r["group_margin"]], [score, margin, gmargin])


def test_mix_weight_with_groups(table):
    got = {r["weight"]: r for r in X.select_mix_weight(table["df"], table["c"], 4, [0.0, 0.1, 0.3], table["groups"]).collect()}
    y, c = table["y"], table["c"]
    for w, r in got.items():
        h = ((1 - w) * table["p"] + w * table["q"]).argmax(axis=1)
        per = [macro(y[table["fold"] == f], h[table["fold"] == f], c)[0] for f in range(4)]
        floor = min(macro(y[table["group"] == g], h[table["group"] == g], c)[0] for g in range(3))
        assert np.allclose([r["mean_f1"], r["min_f1"], r["floor"]], [np.mean(per), min(per), floor])
    assert got[0.0]["eligible"] == 0


def test_greedy_and_components_match_loops(spark):
    rng = random.Random(2)
    edges = [(i, j) for i in range(1, 40) for j in range(i + 1, 40) if rng.random() < 0.05]
    df = spark.createDataFrame(edges, "i int, j int")
    dropped = set()
    for i in range(1, 40):
        if i not in dropped:
            dropped |= {b for a, b in edges if a == i}
    assert {r["v"] for r in V.greedy_drop(df).collect()} == dropped
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["node"]: r["comp"] for r in V.components(df.selectExpr("i a", "j b")).collect()} == root


def test_gene_corr_drop_keeps_other_genes(frame):
    rows = [(s, f, 1.0) for s in range(20) for f, on in (("a1", s % 2), ("a2", s % 2), ("b1", s % 2), ("a3", s % 3 == 0)) if on]
    feat = frame("sample_id int, feature string, value double", *rows)
    order = frame("feature string, gene string, rank int", ("a1", "A", 1), ("a2", "A", 2), ("a3", "A", 3), ("b1", "B", 4))
    samples = frame("sample_id int", *[(s,) for s in range(20)])
    assert {r[0] for r in V.gene_corr_drop(feat, samples, order, 0.9).collect()} == {"a2"}


def test_vote_rules_need_a_gain(frame):
    rows = [(i, 1, 0, 1) for i in range(6)] + [(i, 0, 0, 0) for i in range(6, 12)]
    votes = frame("sample_id int, y int, v0 int, v1 int", *rows)
    rules = P.learn_vote_rules(votes, ["v0", "v1"], 2, 3, 0.1).collect()
    assert [(r["v0"], r["v1"], r["yhat"]) for r in rules] == [(0, 1, 1)]
    out = P.apply_vote_rules(votes, P.learn_vote_rules(votes, ["v0", "v1"], 2, 3, 0.1), ["v0", "v1"])
    assert all(r["yhat"] == r["y"] for r in out.collect())


def test_svd_recovers_singular_values(spark):
    from tokenfold.operators import latent as L

    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (40, 6)).astype(float)
    rows = [(i, f"f{j}", float(x[i, j])) for i in range(40) for j in range(6) if x[i, j]]
    df = spark.createDataFrame(rows, "sample_id int, feature string, value double")
    s = L.svd_state(df, 3).first()["s"]
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False)[:3])
    z = {(r["sample_id"], r["feature"]): r["value"] for r in L.svd_apply(df, L.svd_state(df, 3)).collect()}
    assert math.isclose(math.sqrt(sum(v * v for (_, f), v in z.items() if f == "svd_0")), s[0], rel_tol=1e-9)


def test_digest_tells_nulls_apart(frame):
    from tokenfold.sources import tables as A

    schema = "a int, b string, c int"
    one, two = frame(schema, (1, "x", None), (2, None, 3)), frame(schema, (1, None, 3), (2, "x", None))
    three = frame(schema, (2, None, 3), (1, "x", None))
    digest = [A.table_fingerprint(t, ["a", "b", "c"]).first()["fingerprint"] for t in (one, two, three)]
    assert digest[0] != digest[1] and digest[0] == digest[2]
    shifted = [A.table_fingerprint(frame("a string, b string", r), ["a", "b"]).first()["fingerprint"] for r in (("1", "23"), ("12", "3"), ("n", None), (None, "n"))]
    assert len(set(shifted)) == 4


def test_range_rank_is_a_row_number(spark):
    df = spark.createDataFrame([(f"k{i % 3}", f"https://same/{i * 7919 % 1000:04d}") for i in range(1000)], "k string, v string").repartition(4)
    got = S.range_rank(df, F.asc("v"), keys=["k"]).collect()
    for k in ("k0", "k1", "k2"):
        assert [r["rank"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["v"])] == list(range(1, sum(r["k"] == k for r in got) + 1))


def test_greedy_drop_settles_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1, 24)], "i int, j int")
    assert {r["v"] for r in V.greedy_drop(df).collect()} == set(range(2, 25, 2))


def test_modules_separate_disjoint_communities(spark):
    rows = [(s, f"g{g}", 1.0) for s in range(30) for g in range(12) if (s < 15) == (g < 6) and (s + g) % 3]
    df = spark.createDataFrame(rows, "sample_id long, feature string, value double")
    state = L.nmf_state(df, 2, iterations=8)
    seen: dict = {}
    for r in L.nmf_apply(df.unionByName(df.filter("sample_id = 0").withColumn("sample_id", F.lit(99).cast("long"))), state).collect():
        seen.setdefault(r["sample_id"], {})[r["module"]] = r["value"]
    side = {s: max(w, key=w.get) for s, w in seen.items()}
    assert len({side[s] for s in range(15)}) == 1 == len({side[s] for s in range(15, 30)}) and side[0] != side[20] and side[99] == side[0]
    assert all(min(w.values()) < 1e-6 * max(w.values()) for w in seen.values())


def test_sparse_vectors(spark):
    f = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "c", 3.0)], "sample_id long, feature string, value double")
    index = G.feature_index(f)
    at = {r["feature"]: r["idx"] for r in index.collect()}
    got = {r["sample_id"]: r["features"] for r in G.to_vectors(f, index, 3, spark.range(1, 4).withColumnRenamed("id", "sample_id")).collect()}
    assert got[1].toArray()[at["a"]] == 2.0 and got[2].numNonzeros() == 1 and got[3].numNonzeros() == 0


def test_transform_never_sees_labels_of_new_samples(spark):
    from tokenfold.plans import registry as R

    rng = random.Random(4)
    cells = spark.createDataFrame([(s, f"g{g}", rng.choice(["A12V", "R7*", "Q4fs", "A1A", "A12V R9C", None])) for s in range(80) for g in range(12) if rng.random() < 0.4],
                                  "sample_id long, gene string, cell string")
    samples = spark.createDataFrame([(s, "ABC"[s % 3], s // 3 % 4) for s in range(80)], "sample_id long, label string, fold int")
    train, new = samples.filter("fold < 3"), samples.filter("fold = 3")
    of = lambda part: cells.join(part.select("sample_id"), "sample_id", "left_semi")
    for name in ("em_E14", "em_F20", "jyp_f5", "jyp_f7"):
        x = R.Inputs(of(train), train, 3, (("A", "B"),), {"f": ["A", "B"], "g": ["C"]})
        fitted = R.fit(name, x)
        wrong = new.withColumn("label", F.lit("A"))
        one, two = (sorted(map(tuple, fitted.transform(R.Inputs.unseen(of(s), s, x)).collect())) for s in (new.select("sample_id"), wrong))
        assert one == two and one
        names = {r["feature"] for r in fitted.transform(x).select("feature").distinct().collect()}
        assert {f for _, f, _ in one} <= names | {f for _, f, _ in one if f.split("__")[0] in ("signature", "dual_signature", "pair_contrast", "f5", "f7", "pattern_uncertainty")}
        x.release()
