"""Feature selection and redundancy on long (sample_id, feature, value) tables.

Only non-zero values are stored; every statistic accounts for the implicit zeros.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenfold.functions import stats as S
from tokenfold.operators.gram import gram
from tokenfold.session import cut_lineage, keep, settle

NONE = -1
#: Edges that one task settles in order.
EDGES_PER_TASK = 1 << 20
#: Rounds over large components before they are looked up anew.
ROUNDS_BETWEEN = 8


def active_filter(feat: DataFrame, minimum: int, eps: float = 1e-12) -> DataFrame:
    n = feat.filter(F.abs("value") > eps).groupBy("feature").agg(F.count("*").alias("active"))
    return n.filter(F.col("active") >= minimum)


def _sizes(samples: DataFrame) -> Column:
    return S.keyed_map(samples.groupBy("label").agg(F.count("*").cast("double").alias("n")), F.col("label"), F.col("n"))


def _map_sum(m: str) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x)


def chi2_select(feat: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    """Top k by chi-square of class sums against class share times total, ties by name."""
    c = feat.join(samples.select("sample_id", "label"), "sample_id").groupBy("feature", "label").agg(
        F.sum(F.greatest("value", F.lit(0.0))).alias("o"))
    c = c.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("label", "o"))).alias("o"), F.sum("o").alias("t"))
    c = c.withColumn("s", _sizes(samples)).withColumn("n", _map_sum("s"))

    def term(acc, e):
        exp = e["value"] / F.col("n") * F.col("t")
        obs = F.coalesce(F.element_at("o", e["key"]), F.lit(0.0))
        return acc + F.coalesce(F.try_divide((obs - exp) * (obs - exp), exp), F.lit(0.0))

    c = c.withColumn("chi2", F.aggregate(F.map_entries("s"), F.lit(0.0), term))
    return S.top_rows(c.select("feature", "chi2"), k, F.desc(F.round("chi2", 9)), F.asc("feature"))


def mi_select(feat: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    """Top k by exact mutual information of the feature's values and the label."""
    cells = feat.filter("value <> 0").join(samples.select("sample_id", "label"), "sample_id").groupBy("feature", "value", "label").agg(
        F.count("*").cast("double").alias("n"))
    seen = cells.groupBy("feature", "label").agg(F.sum("n").alias("n")).groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"))
    zero = seen.withColumn("s", _sizes(samples)).select("feature", "m", F.explode("s").alias("label", "nc"))
    zero = zero.select("feature", F.lit(0.0).alias("value"), "label", (F.col("nc") - F.coalesce(F.element_at("m", F.col("label")), F.lit(0.0))).alias("n"))
    allc = cells.select("feature", F.col("value").cast("double").alias("value"), "label", "n").unionByName(zero.filter("n > 0"))
    v = allc.groupBy("feature", "value").agg(F.collect_list(F.struct("label", "n")).alias("ls"), F.sum("n").alias("nv"))
    v = v.withColumn("s", _sizes(samples)).withColumn("N", _map_sum("s"))
    part = F.aggregate("ls", F.lit(0.0), lambda a, x: a + x["n"] / F.col("N") * F.ln(x["n"] * F.col("N") / (F.col("nv") * F.element_at("s", x["label"]))))
    mi = v.withColumn("part", part).groupBy("feature").agg(F.sum("part").alias("mi"))
    return S.top_rows(mi, k, F.desc(F.round("mi", 9)), F.asc("feature"))


def digamma(n: Column) -> Column:
    """Digamma of a positive integer to about 1e-13: ten steps up, then the asymptotic series."""
    x = n.cast("double")
    z = x + 10.0
    z2 = z * z
    series = F.ln(z) - 0.5 / z - (1.0 / 12 - (1.0 / 120 - (1.0 / 252 - 1.0 / 240 / z2) / z2) / z2) / z2
    return series - reduce(lambda a, i: a + 1.0 / (x + float(i)), range(1, 10), 1.0 / x)


def neighbour_information(values: DataFrame, samples: DataFrame, k: int = 3) -> DataFrame:
    """(feature, n, mi): mutual information of continuous features and the label from nearest neighbours.

    A row's radius is the distance to its k-th nearest other row of its label (of
    all of them, if fewer); with m rows of any label strictly inside the radius, or
    equal to the row, mi = psi(n) + mean psi(k) - mean psi(rows of the label) - mean psi(m),
    at least zero. Rows alone in their label, without a label, or with a null or
    non-finite value take no part; a feature without other rows has no result.

    Neighbours by value are neighbours by rank: rows meet the 2k ranks beside
    them in equal joins, and the rows inside a radius are differences of ranks
    of its two ends. Ranks come from sampled ranges, so no feature or label is
    sorted by one task, and no pair of rows beyond 2k a row is made.
    """
    v = values.select("sample_id", "feature", F.col("value").cast("double").alias("value")).filter("abs(value) < double('infinity')")
    d = v.join(samples.select("sample_id", "label").filter("label is not null"), "sample_id")
    sizes = d.groupBy("feature", "label").agg(F.count("*").alias("nl")).filter("nl > 1")
    d = settle(d.join(sizes, ["feature", "label"]))
    own = settle(S.range_rank(d, F.asc("value"), F.asc("sample_id"), keys=["feature", "label"]))
    beside = F.explode(F.array(*[F.col("rank") + i for i in range(-k, k + 1) if i])).alias("rank")
    near = own.select("feature", "label", "sample_id", F.col("value").alias("here"), beside).join(
        own.select("feature", "label", "rank", "value"), ["feature", "label", "rank"])
    far = F.element_at(F.array_sort(F.collect_list(F.abs(F.col("value") - F.col("here")))), F.least(F.lit(k), F.size(F.collect_list("value"))))
    radius = near.groupBy("feature", "label", "sample_id", "here").agg(far.alias("r"), F.least(F.lit(k), F.count("*")).alias("kk"))
    # ends sort before rows of the same value (0), or after them (2); rows are 1
    flat = F.col("r") == 0
    ends = F.explode(F.array(
        F.struct((F.col("here") - F.col("r")).alias("value"), F.when(flat, 0).otherwise(2).alias("side"), F.lit(-1).alias("sign")),
        F.struct((F.col("here") + F.col("r")).alias("value"), F.when(flat, 2).otherwise(0).alias("side"), F.lit(1).alias("sign")))).alias("e")
    ends = settle(radius.select("feature", "sample_id", ends).select("feature", "sample_id", "e.*"))
    order = [F.asc("value"), F.asc("side"), F.asc("sample_id"), F.asc("sign")]
    both = ends.unionByName(d.select("feature", "sample_id", "value", F.lit(1).alias("side"), F.lit(0).alias("sign")))
    among = S.range_rank(both, *order, keys=["feature"]).filter("sign <> 0").select("feature", "sample_id", "sign", F.col("rank").alias("a"))
    alone = S.range_rank(ends, *order, keys=["feature"]).select("feature", "sample_id", "sign", F.col("rank").alias("b"))
    inside = among.join(alone, ["feature", "sample_id", "sign"]).groupBy("feature", "sample_id").agg(F.sum(F.col("sign") * (F.col("a") - F.col("b"))).alias("m"))
    ks = radius.select("feature", "sample_id", "kk")
    g = inside.join(ks, ["feature", "sample_id"]).groupBy("feature").agg(
        F.count("*").alias("n"), F.avg(digamma(F.col("kk"))).alias("pk"), F.avg(digamma(F.greatest("m", F.lit(1)))).alias("pm"))
    labels = sizes.groupBy("feature").agg((F.sum(F.col("nl") * digamma(F.col("nl"))) / F.sum("nl")).alias("pl"))
    mi = digamma(F.col("n")) + F.col("pk") - F.col("pl") - F.col("pm")
    return g.join(labels, "feature").select("feature", "n", F.greatest(mi, F.lit(0.0)).alias("mi"))


def anova_table(feat: DataFrame, samples: DataFrame, parts: Sequence[int] = (NONE,)) -> DataFrame:
    """(held, feature, f, support): ANOVA F without each held fold (-1: all rows).

    Sums per (feature, label, fold) are taken once; a training part is the total
    minus its held fold. Undefined and infinite scores are zero.
    """
    s = samples.select("sample_id", "label", (F.col("fold") if "fold" in samples.columns else F.lit(0)).alias("fold"))
    per = feat.join(s, "sample_id").groupBy("feature", "label", "fold").agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count("*").cast("double").alias("c"))
    held = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("s", "q", "c"))))
    per = per.groupBy("feature", "label").agg(*[F.sum(x).alias(f"t{x}") for x in "sqc"], held.alias("held"))
    per = settle(per.groupBy("feature").agg(F.collect_list(F.struct("label", "ts", "tq", "tc", "held")).alias("ls")))
    size = s.groupBy("label", "fold").agg(F.count("*").cast("double").alias("n")).groupBy("label").agg(
        F.sum("n").alias("t"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("held"))
    sizes = S.keyed_map(size, F.col("label"), F.struct("t", "held"))
    d = per.select("feature", "ls", F.explode(F.array(*[F.lit(p) for p in parts])).alias("k")).withColumn("sz", sizes)
    n_of = lambda e: e["t"] - F.coalesce(F.element_at(e["held"], F.col("k")), F.lit(0.0))
    d = d.withColumn("sz", F.transform_values("sz", lambda _, e: n_of(e)))
    rest = lambda e, x: e[f"t{x}"] - F.coalesce(F.element_at(e["held"], F.col("k"))[x], F.lit(0.0))
    d = d.withColumn("r", F.transform("ls", lambda e: F.struct(
        rest(e, "s").alias("s"), rest(e, "q").alias("q"), rest(e, "c").alias("c"), F.element_at("sz", e["label"]).alias("n"))))
    total = lambda fn: F.aggregate("r", F.lit(0.0), lambda a, e: a + fn(e))
    d = d.select("k", "feature", _map_sum("sz").alias("n_rows"), F.size("sz").alias("n_classes"), total(lambda e: e["s"]).alias("s"), total(lambda e: e["q"]).alias("q"),
                 total(lambda e: e["c"]).alias("c"), total(lambda e: F.coalesce(F.try_divide(e["s"] * e["s"], e["n"]), F.lit(0.0))).alias("b"))
    mean2 = F.col("s") * F.col("s") / F.col("n_rows")
    ssb, sst = F.col("b") - mean2, F.col("q") - mean2
    f = F.try_divide(ssb / (F.col("n_classes") - 1), (sst - ssb) / (F.col("n_rows") - F.col("n_classes")))
    f = F.when((sst - ssb) > 1e-9, f).otherwise(0.0)
    var = F.greatest(F.col("q") / F.col("n_rows") - (F.col("s") / F.col("n_rows")) ** 2, F.lit(0.0))
    return d.select(F.col("k").alias("held"), "feature", F.coalesce(f, F.lit(0.0)).alias("f"), F.col("c").cast("bigint").alias("support"),
                    var.alias("variance"), F.col("n_rows").cast("bigint").alias("n"))


def anova_f(feat: DataFrame, samples: DataFrame) -> DataFrame:
    return anova_table(feat, samples).select("feature", "f", "support")


def _fold_top(table: DataFrame, k: int, top: int) -> DataFrame:
    order = W.partitionBy("held").orderBy(F.desc(F.round("f", 9)), "feature")
    r = table.filter(F.col("held") != NONE).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top)
    return r.groupBy("feature").agg(F.count("*").alias("frequency"))


def anova_stability(feat: DataFrame, folds: DataFrame, k: int, fraction: float = 0.2) -> DataFrame:
    """Full F and the share of training parts that rank the feature in the top fraction."""
    t = settle(anova_table(feat, folds, [NONE, *range(k)]))
    full = t.filter(F.col("held") == NONE)
    hits = _fold_top(t, k, max(1, math.ceil(round(full.count() * fraction, 9))))
    return full.join(hits, "feature", "left").select(
        "feature", "f", "support", (F.coalesce("frequency", F.lit(0)) / k).alias("stability"))


def stable_anova(feat: DataFrame, folds: DataFrame, k: int, n: int, min_support: int = 5, max_prevalence: float = 0.95,
                 min_variance: float = 1e-4, multiplier: float = 1.5, min_frequency: int = 3) -> DataFrame:
    """n features by (stable, frequency, F, name) after support, prevalence and variance filters."""
    t = settle(anova_table(feat, folds, [NONE, *range(k)]))
    full = t.filter(F.col("held") == NONE).filter(
        (F.col("support") >= min_support) & (F.col("support") <= F.lit(max_prevalence) * F.col("n")) & (F.col("variance") >= min_variance))
    el = settle(full.select("feature", "f"))
    size = el.count()
    pool = min(size, max(min(n, size), math.ceil(min(n, size) * multiplier)))
    hits = _fold_top(t.join(el.select("feature"), "feature", "left_semi"), k, pool)
    d = el.join(hits, "feature", "left").fillna(0, ["frequency"]).withColumn("stable", (F.col("frequency") >= min(min_frequency, k)).cast("int"))
    return S.top_rows(d, n, F.desc("stable"), F.desc("frequency"), F.desc(F.round("f", 9)), F.asc("feature"))


def interpretability(name: Column, genes: Sequence[str] = ()) -> Column:
    """Rule score: raw gene 5, hotspot, consequence or gene count 4, summary 3, signature 2, else 1."""
    up = F.upper(name)
    return (
        F.when(up.isin([g.upper() for g in genes]), 5.0)
        .when(up.rlike("HOTSPOT|CONSEQUENCE"), 4.0)
        .when(up.rlike("MUTATION_COUNT|MULTI_HIT|GENE_MUTATED"), 4.0)
        .when(up.rlike("BURDEN|COUNT|RATIO|ENTROPY"), 3.0)
        .when(up.rlike("SIGNATURE|PATTERN"), 2.0)
        .otherwise(1.0)
    )


def priority(scores: DataFrame, genes: Sequence[str] = (), missing: DataFrame | None = None) -> DataFrame:
    """Rank features by (F, stability, support, interpretability, -missing, -name length), then name.

    ``scores`` is the output of :func:`anova_stability`; ``missing`` is (feature, missing_rate).
    """
    d = scores.withColumn("interpret", interpretability(F.col("feature"), genes))
    d = d.withColumn("missing_rate", F.lit(0.0)) if missing is None else d.join(missing, "feature", "left").fillna(0.0, ["missing_rate"])
    d = d.withColumn("len", F.length("feature"))
    order = [F.desc(F.round("f", 9)), F.desc("stability"), F.desc("support"), F.desc("interpret"), F.asc("missing_rate"), F.asc("len"), F.asc("feature")]
    return S.range_rank(d, *order)


def dedupe_features(feat: DataFrame, ranks: DataFrame) -> DataFrame:
    """(feature, keep) of features whose non-zero cells are equal; the best rank is kept."""
    key = feat.filter("value <> 0").groupBy("feature").agg(*S.set_digest(F.col("sample_id"), F.col("value"))).select(
        "feature", S.digest_key().alias("key"))
    j = key.join(ranks.select("feature", "rank"), "feature")
    best = j.groupBy("key").agg(F.min_by("feature", "rank").alias("keep"), F.count("*").alias("n"))
    return j.join(best.filter("n > 1"), "key").select("feature", "keep")


def correlated(feat: DataFrame, samples: DataFrame, ranks: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ranked features with |Pearson r| >= threshold as (i, j, r), i < j ranks.

    Co-sums come from blocked matrix products, zeros included through N. Two
    features that never meet have |r| = sqrt(ha hb) with h = squared sum / N over
    the variance, so only features whose h reaches threshold^2 with the largest
    h can form such a pair: few, unless features are dense.
    """
    cand = ranks.select("feature", (F.col("rank") - 1).cast("int").alias("idx"))
    x = keep(feat.join(cand, "feature").select("sample_id", "idx", F.col("value").cast("double").alias("value")))
    n = S.total(samples, F.count("*"))
    m = x.groupBy("idx").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).withColumn("n", n)
    m = m.withColumn("v", F.col("q") - F.col("s") * F.col("s") / F.col("n")).filter("v > 1e-9")
    m = settle(m.withColumn("h", F.col("s") * F.col("s") / F.col("n") / F.col("v")))
    met = settle(gram(x).filter("i < j"))
    x.unpersist()
    dense = m.withColumn("_m", S.total(m, F.max("h"))).filter(F.col("h") * F.col("_m") >= threshold * threshold - 1e-6).select("idx")
    dense = settle(S.range_rank(dense, F.asc("idx"), rank="at"))
    last = dense.count()
    later = dense.filter(F.col("at") < last).select(F.col("idx").alias("i"), F.explode(F.sequence(F.col("at") + 1, F.lit(last))).alias("at"))
    apart = later.join(dense, "at").select("i", F.col("idx").alias("j")).join(met, ["i", "j"], "left_anti").withColumn("s", F.lit(0.0))
    side = lambda c, p: m.select(F.col("idx").alias(c), F.col("s").alias(f"{p}s"), F.col("v").alias(f"{p}v"), *([F.col("n")] if p == "a" else []))
    d = met.select("i", "j", "s").unionByName(apart).join(side("i", "a"), "i").join(side("j", "b"), "j")
    d = d.withColumn("r", (F.col("s") - F.col("as") * F.col("bs") / F.col("n")) / F.sqrt(F.col("av") * F.col("bv")))
    return d.filter(F.abs(F.round("r", 9)) >= threshold).select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "r")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over the undirected edges (a, b).

    Label propagation with pointer jumping, so long chains need few rounds.
    """
    e = settle(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    lab = settle(e.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("comp")))
    while True:
        near = e.join(lab, e.y == lab.node).groupBy("x").agg(F.min("comp").alias("near"))
        step = lab.join(near, lab.node == near.x).select("node", F.least("comp", "near").alias("new"), F.col("comp").alias("old"))
        up = step.select(F.col("node").alias("p"), F.col("new").alias("jump"))
        nxt = cut_lineage(step.join(up, step.new == up.p).select("node", F.least("new", "jump").alias("comp"), "old"))
        moved = nxt.filter("comp <> old").limit(1).count()
        lab = nxt.select("node", "comp")
        if not moved:
            return lab


def corr_groups(feat: DataFrame, samples: DataFrame, ranks: DataFrame, threshold: float) -> DataFrame:
    """(feature, keep) of groups linked by |r| >= threshold; the best rank of a group is kept."""
    e = correlated(feat, samples, ranks, threshold)
    comp = components(e.select(F.col("i").alias("a"), F.col("j").alias("b")))
    name = lambda a, b: ranks.select(F.col("rank").alias(a), F.col("feature").alias(b))
    return comp.join(name("node", "feature"), "node").join(name("comp", "keep"), "comp").select("feature", "keep")


def _settled_in_order(_, t):
    """Nodes dropped in a group of edges: by increasing first node, a node that still stands drops its later neighbour."""
    import pyarrow as pa

    gone: set[int] = set()
    for i, j in sorted(zip(t.column("i").to_pylist(), t.column("j").to_pylist())):
        if i not in gone:
            gone.add(j)
    return pa.table({"v": pa.array(sorted(gone), pa.int64())})


def greedy_drop(edges: DataFrame, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """Nodes dropped when nodes are taken in increasing order and drop their later neighbours.

    Components don't touch each other, so those of at most ``per_task`` edges are
    settled each in one pass over their edges, packed into tasks of about that
    size; a table that is no larger needs no components at all. In a larger
    component a node without an earlier open neighbour is kept and its later
    neighbours drop, in rounds; what is left falls into components again. Rounds
    are as many as the longest increasing path that is still open needs.
    """
    e = settle(edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct())
    parts, turn = [], 0
    while n := e.count():
        bins = -(-n // per_task)
        small, large = None, e
        if bins == 1:
            small, large = e.withColumn("bin", F.lit(0).cast("long")), None
        elif turn % ROUNDS_BETWEEN == 0:
            comp = components(e.select(F.col("i").alias("a"), F.col("j").alias("b")))
            own = e.join(comp, e.i == comp.node).select("i", "j", "comp")
            sizes = own.groupBy("comp").agg(F.count("*").alias("size"))
            own = settle(own.join(sizes, "comp"))
            small = own.filter(F.col("size") <= per_task).select("i", "j", F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("bin"))
            large = own.filter(F.col("size") > per_task).select("i", "j")
        turn += 1
        if small is not None:
            parts.append(settle(small.groupBy("bin").applyInArrow(_settled_in_order, "v long")))
        if large is None:
            break
        kept = large.select("i").distinct().join(large.select(F.col("j").alias("i")).distinct(), "i", "left_anti")
        out = settle(large.join(kept, "i", "left_semi").select(F.col("j").alias("v")).distinct())
        parts.append(out)
        e = settle(large.join(out, F.col("i") == F.col("v"), "left_anti").join(out, F.col("j") == F.col("v"), "left_anti"))
    return reduce(DataFrame.unionByName, parts) if parts else e.select(F.col("i").alias("v"))


def corr_greedy(feat: DataFrame, samples: DataFrame, ranks: DataFrame, threshold: float) -> DataFrame:
    """Features dropped by the greedy pass in priority order."""
    e = correlated(feat, samples, ranks, threshold)
    return greedy_drop(e).join(ranks.select(F.col("rank").alias("v"), "feature"), "v").select("feature")


def gene_corr_drop(feat: DataFrame, samples: DataFrame, order: DataFrame, threshold: float) -> DataFrame:
    """Features dropped inside their gene: |r| >= threshold with an earlier kept feature.

    ``order`` is (feature, gene, rank) with a rank over all features. Products
    are taken within a (sample, gene) only, over the few features of one cell.
    """
    x = feat.join(order, "feature").select("sample_id", "gene", F.col("rank").alias("r"), F.col("value").cast("double").alias("v"))
    cell = x.groupBy("sample_id", "gene").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b["r"] >= a["r"]), lambda b: F.struct(
        a["r"].alias("i"), b["r"].alias("j"), (a["v"] * b["v"]).alias("p"), a["v"].alias("v")))))
    n = S.total(samples, F.count("*"))
    g = settle(cell.select(F.explode(pairs).alias("x")).groupBy("x.i", "x.j").agg(F.sum("x.p").alias("s"), F.sum("x.v").alias("t")))
    one = lambda c, p: g.filter("i = j").select(F.col("i").alias(c), F.col("s").alias(f"{p}q"), F.col("t").alias(f"{p}s"))
    d = g.filter("i < j").select("i", "j", "s").join(one("i", "a"), "i").join(one("j", "b"), "j").withColumn("n", n)
    var = lambda p: F.col(f"{p}q") - F.col(f"{p}s") * F.col(f"{p}s") / F.col("n")
    r = F.when((var("a") > 1e-9) & (var("b") > 1e-9), (F.col("s") - F.col("as") * F.col("bs") / F.col("n")) / F.sqrt(var("a") * var("b"))).otherwise(0.0)
    e = d.filter(F.abs(F.round(r, 9)) >= threshold)
    return greedy_drop(e).join(order.select(F.col("rank").alias("v"), "feature"), "v").select("feature")


# --- binary presence -----------------------------------------------------------------
def _pair_stats(both: Column, a: Column, b: Column, n: Column) -> tuple[Column, Column]:
    phi = F.try_divide(n * both - a * b, F.sqrt(a * b * (n - a) * (n - b)))
    return F.coalesce(phi, F.lit(0.0)), F.coalesce(F.try_divide(both, a + b - both), F.lit(0.0))


def phi_jaccard(presence: DataFrame, samples: DataFrame, phi: float, jaccard: float, minimum: int = 1, folds: DataFrame | None = None,
                k: int = 0) -> DataFrame:
    """Gene pairs (a, b, both, phi, jaccard) over both thresholds, a < b by name.

    With ``folds`` also ``n_folds``: training parts in which the pair passes. Joint
    counts are taken per fold; a part is the total minus the fold.
    """
    n = S.total(samples, F.count("*"))
    sup = presence.groupBy("gene").agg(F.count("*").alias("support")).withColumn("n", n)
    sup = sup.filter((F.col("support") >= minimum) & (F.col("support") < F.col("n")))
    named = sup.select("gene", "support").withColumn("h", F.md5("gene"))
    sup = settle(S.hash_rank(named, [], "h").select("gene", "support", (F.col("rank") - 1).cast("int").alias("idx")))
    p = presence.join(sup.select("gene", "idx"), "gene")
    f = samples.select("sample_id", F.lit(0).alias("fold")) if folds is None else folds.select("sample_id", "fold")
    both = settle(gram(p.join(f, "sample_id").select("sample_id", "idx", "fold", F.lit(1.0).alias("value")), ["fold"]))
    held = F.map_from_entries(F.collect_list(F.struct("fold", "s")))
    j = both.groupBy("i", "j").agg(F.sum("s").alias("t"), held.alias("h"))
    diag = j.filter("i = j").select(F.col("i").alias("d"), F.col("t").alias("dt"), F.col("h").alias("dh"))
    e = j.filter("i < j").join(diag.select(F.col("d").alias("i"), F.col("dt").alias("ta"), F.col("dh").alias("ha")), "i").join(
        diag.select(F.col("d").alias("j"), F.col("dt").alias("tb"), F.col("dh").alias("hb")), "j").withColumn("n", n)
    ph, ja = _pair_stats(F.col("t"), F.col("ta"), F.col("tb"), F.col("n").cast("double"))
    ok = lambda x, y: (F.round(x, 9) >= phi) & (F.round(y, 9) >= jaccard)
    e = e.withColumn("phi", ph).withColumn("jaccard", ja).filter(ok(F.col("phi"), F.col("jaccard")))
    out = [F.col("t").cast("bigint").alias("both"), "phi", "jaccard"]
    if folds is not None:
        nf = S.keyed_map(f.groupBy("fold").agg(F.count("*").alias("n")), F.col("fold"), F.col("n"))
        e = e.withColumn("nf", nf)
        z = lambda m, i: F.coalesce(F.element_at(m, F.lit(i)), F.lit(0.0))
        passed = F.lit(0)
        for i in range(k):
            x, y = _pair_stats(F.col("t") - z("h", i), F.col("ta") - z("ha", i), F.col("tb") - z("hb", i),
                               (F.col("n") - F.element_at("nf", F.lit(i))).cast("double"))
            passed = passed + ok(x, y).cast("int")
        out.append(passed.alias("n_folds"))
    nm = lambda c, g: sup.select(F.col("idx").alias(c), F.col("gene").alias(g))
    named = e.join(nm("i", "_a"), "i").join(nm("j", "_b"), "j")
    return named.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), *out)


def stable_edges(presence: DataFrame, folds: DataFrame, k: int, phi: float, jaccard: float, min_folds: int, minimum: int = 1) -> DataFrame:
    e = phi_jaccard(presence, folds, phi, jaccard, minimum, folds, k)
    return e.filter(F.col("n_folds") >= min(min_folds, k))


def representatives(edges: DataFrame, presence: DataFrame, samples: DataFrame) -> DataFrame:
    """(gene, keep): component members and their representative.

    The representative has the largest summed edge stability, then support,
    then support * (n - support), then the first name.
    """
    edges = settle(edges)
    comp = components(edges.select("a", "b"))
    ends = edges.select(F.col("a").alias("node"), "n_folds").unionByName(edges.select(F.col("b").alias("node"), "n_folds"))
    st = ends.groupBy("node").agg(F.sum("n_folds").alias("stability"))
    sup = presence.groupBy(F.col("gene").alias("node")).agg(F.count("*").alias("support"))
    n = S.total(samples, F.count("*"))
    d = comp.join(st, "node").join(sup, "node").withColumn("n", n)
    order = F.struct(-F.col("stability"), -F.col("support"), -(F.col("support") * (F.col("n") - F.col("support"))), F.col("node"))
    best = d.groupBy("comp").agg(F.min_by("node", order).alias("keep"))
    return d.join(best, "comp").select(F.col("node").alias("gene"), "keep")
