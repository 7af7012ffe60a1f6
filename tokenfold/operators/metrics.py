"""Confusion-based metrics, evidence tables and selection rules.

Predictions are rows (keys..., y, yhat) of class ids. They are reduced to
confusion counts first; everything else works on those small tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenfold.functions import probs as P
from tokenfold.functions import stats as S
from tokenfold.session import keep, settle

TOL = 1e-12


def confusion(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*keys, "y", "yhat").agg(F.count("*").alias("n"))


def class_counts(conf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, c, tp, n_true, n_pred) of every class seen as truth or prediction."""
    hit = F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)
    both = F.explode(F.array(
        F.struct(F.col("y").alias("c"), hit.alias("tp"), F.col("n").alias("n_true"), F.lit(0).cast("bigint").alias("n_pred")),
        F.struct(F.col("yhat").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("n_true"), F.col("n").alias("n_pred"))))
    d = conf.select(*keys, both.alias("s")).select(*keys, "s.*")
    return d.groupBy(*keys, "c").agg(F.sum("tp").alias("tp"), F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"))


def f1(tp: Column, n_true: Column, n_pred: Column) -> Column:
    """2tp / (2tp + fp + fn), zero for an empty class."""
    return F.coalesce(F.try_divide(2.0 * tp, (n_true + n_pred).cast("double")), F.lit(0.0))


def class_f1(pred: DataFrame, keys: Sequence[str] = (), counted: bool = False) -> DataFrame:
    conf = pred if counted else confusion(pred, keys)
    c = class_counts(conf, keys)
    return c.withColumn("f1", f1(F.col("tp"), F.col("n_true"), F.col("n_pred")))


def macro_f1(pred: DataFrame, keys: Sequence[str] = (), n_classes: int | None = None, counted: bool = False) -> DataFrame:
    """Mean class F1 per key, over ``n_classes`` classes or over the observed ones."""
    c = class_f1(pred, keys, counted)
    size = F.count("*") if n_classes is None else F.lit(n_classes)
    return c.groupBy(*keys).agg((F.sum("f1") / size).alias("macro_f1"))


def class_report(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    c = class_f1(pred, keys)
    div = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return c.select(*keys, "c", div("tp", "n_pred").alias("precision"), div("tp", "n_true").alias("recall"), "f1",
                    F.col("n_true").alias("support"))


def calibration(proba: DataFrame, keys: Sequence[str] = (), bins: Sequence[float] = (0, 0.4, 0.6, 0.8, 1)) -> DataFrame:
    """Log-loss, Brier score, expected calibration error and error at confidence >= 0.8."""
    d = proba.select(*keys, "y", "p", F.array_max("p").alias("conf"), P.argmax(F.col("p")).alias("yhat"))
    own = F.least(F.greatest(P.at(F.col("p"), F.col("y")), F.lit(1e-15)), F.lit(1.0))
    sq = F.aggregate(F.transform("p", lambda x, i: F.pow(x - F.when(i == F.col("y"), 1.0).otherwise(0.0), 2.0)), F.lit(0.0), lambda a, x: a + x)
    edges = [b for b in bins[1:-1]]
    bucket = sum(((F.col("conf") >= e).cast("int") for e in edges), F.lit(0))
    ok = (F.col("yhat") == F.col("y")).cast("int")
    d = d.select(*keys, bucket.alias("b"), ok.alias("ok"), "conf", (-F.ln(own)).alias("ll"), sq.alias("sq"), (F.col("conf") >= 0.8).alias("hi"))
    g = d.groupBy(*keys, "b").agg(
        F.count("*").alias("n"), F.sum("ok").alias("ok"), F.sum("conf").alias("conf"), F.sum("ll").alias("ll"), F.sum("sq").alias("sq"),
        F.count_if("hi").alias("hi"), F.count_if(F.col("hi") & (F.col("ok") == 0)).alias("hi_bad"))
    return g.groupBy(*keys).agg(
        (F.sum("ll") / F.sum("n")).alias("logloss"), (F.sum("sq") / F.sum("n")).alias("brier"),
        (F.sum(F.abs(F.col("ok") - F.col("conf"))) / F.sum("n")).alias("ece"),
        F.coalesce(F.try_divide(F.sum("hi_bad"), F.sum("hi")), F.lit(0.0)).alias("high_confidence_error"))


def pair_f1(pred: DataFrame, pair: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """Macro-F1 of two classes over rows whose truth is one of them."""
    c = class_f1(pred.filter(F.col("y").isin(*pair)), keys).filter(F.col("c").isin(*pair))
    return c.groupBy(*keys).agg((F.sum("f1") / 2).alias("pair_f1"))


def directed_confusion(pred: DataFrame, minimum: int = 3) -> DataFrame:
    """(source, target) errors with enough support, ranked."""
    c = confusion(pred)
    size = c.groupBy(F.col("y").alias("source")).agg(F.sum("n").alias("source_support"))
    e = c.filter((F.col("y") != F.col("yhat")) & (F.col("n") >= minimum)).select(
        F.col("y").alias("source"), F.col("yhat").alias("target"), F.col("n").alias("confusion_support"))
    d = e.join(size, "source").withColumn("confusion_rate", F.col("confusion_support") / F.col("source_support"))
    order = W.orderBy(F.desc("confusion_support"), "source", "target")
    return d.withColumn("rank", F.row_number().over(order))


def fold_summary(scores: DataFrame, by: Sequence[str] = (), col: str = "macro_f1", ddof: int = 0) -> DataFrame:
    std = F.stddev_pop(col) if ddof == 0 else F.stddev_samp(col)
    return scores.groupBy(*by).agg(F.avg(col).alias("mean"), std.alias("std"), F.min(col).alias("min"))


def overfit_summary(scores: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Train minus validation score: range, mean and folds over the threshold."""
    gap = F.col("train") - F.col("valid")
    return scores.groupBy(*by).agg(
        F.min(gap).alias("gap_min"), F.max(gap).alias("gap_max"), F.avg(gap).alias("gap_mean"),
        F.count_if(gap > threshold).alias("n_over"), F.count("*").alias("n"))


def slice_f1(pred: DataFrame, by: str, n_classes: int | None = None) -> DataFrame:
    n = pred.groupBy(by).agg(F.count("*").alias("support"))
    return macro_f1(pred, [by], n_classes).join(n, by)


def fold_groups(burden: DataFrame, novelty: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """(sample, dimension, grp): 0 low, 1 middle, 2 high by training quartiles of its fold.

    ``burden`` has ``burden``; ``novelty`` has ``valid`` and ``train_<i>`` shares.
    """
    b = keep(folds.select("sample_id", "fold").join(burden.select("sample_id", "burden"), "sample_id").join(
        novelty.drop("fold"), "sample_id"))
    parts = F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.when(F.col("fold") != i, F.col("burden").cast("double")).alias("burden"),
                 F.col(f"train_{i}").alias("novelty")) for i in range(k)]))
    t = b.select(parts.alias("x")).select("x.*").unpivot(["part"], ["burden", "novelty"], "dimension", "x")
    q = settle(S.quantiles(t, ["part", "dimension"], "x", [0.25, 0.75]))
    own = b.select("sample_id", "fold", F.col("burden").cast("double").alias("burden"), F.col("valid").alias("novelty"))
    own = own.unpivot(["sample_id", "fold"], ["burden", "novelty"], "dimension", "x")
    j = own.join(q.withColumnRenamed("part", "fold"), ["fold", "dimension"])
    return j.select("sample_id", "dimension", F.when(F.col("x") <= F.col("q0"), 0).when(F.col("x") >= F.col("q1"), 2).otherwise(1).alias("grp"))


def _grouped(pred: DataFrame, groups: DataFrame) -> DataFrame:
    return pred.join(groups.select("sample_id", "dimension", "grp"), "sample_id")


def group_scores(pred: DataFrame, groups: DataFrame, n_classes: int, keys: Sequence[str] = ()) -> DataFrame:
    return macro_f1(_grouped(pred, groups), [*keys, "dimension", "grp"], n_classes)


def worst_group(pred: DataFrame, groups: DataFrame, n_classes: int, keys: Sequence[str] = ()) -> DataFrame:
    g = group_scores(pred, groups, n_classes, keys)
    return g.groupBy(*keys).agg(F.min("macro_f1").alias("floor"))


def two_models(pred: DataFrame, base: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Rows with the candidate's and the base prediction side by side."""
    b = base.select(*keys, F.col("yhat").alias("base"))
    return pred.select(*keys, "y", F.col("yhat").alias("cand"), *[c for c in pred.columns if c not in (*keys, "y", "yhat")]).join(b, list(keys))


def stack_models(both: DataFrame) -> DataFrame:
    """One row per (row, which) with which in base, cand."""
    other = [c for c in both.columns if c not in ("base", "cand")]
    return both.unpivot([F.col(c) for c in other], ["base", "cand"], "which", "yhat")


def robustness(both: DataFrame, groups: DataFrame, n_classes: int, tolerance: float = 0.0) -> DataFrame:
    """Worst-group floor of the candidate and folds whose floor falls below the base.

    ``both`` has sample_id, fold, y, base, cand.
    """
    key = ["dimension", "grp"]
    conf = settle(confusion(_grouped(stack_models(both), groups), ["which", "fold", *key]))
    fl = macro_f1(conf, ["which", "fold", *key], n_classes, counted=True).groupBy("fold", "which").agg(F.min("macro_f1").alias("floor"))
    per = fl.groupBy("fold").agg((F.max(F.when(F.col("which") == "cand", F.col("floor"))) - F.max(F.when(F.col("which") == "base", F.col("floor")))).alias("d"))
    over = conf.filter("which = 'cand'").groupBy(*key, "y", "yhat").agg(F.sum("n").alias("n"))
    floor = macro_f1(over, key, n_classes, counted=True)
    worst = S.total(floor, F.min("macro_f1"))
    return per.agg(F.min("d").alias("worst_fold_delta"), F.count_if(F.col("d") < -tolerance).alias("collapse_folds")).withColumn("worst_group_floor", worst)


def safety(both: DataFrame) -> DataFrame:
    """Per class: overall F1 delta and number of declining folds."""
    st = stack_models(both)
    c = class_f1(st.select("which", "fold", "y", "yhat"), ["which", "fold"])
    grid = c.groupBy("fold", "c").agg(*[F.coalesce(F.max(F.when(F.col("which") == w, F.col("f1"))), F.lit(0.0)).alias(w) for w in ("base", "cand")])
    dec = grid.groupBy("c").agg(F.count_if(F.col("cand") < F.col("base") - TOL).alias("declining_folds"))
    o = c.groupBy("which", "c").agg(F.sum("tp").alias("tp"), F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"))
    o = o.withColumn("f1", f1(F.col("tp"), F.col("n_true"), F.col("n_pred")))
    o = o.groupBy("c").agg(*[F.coalesce(F.max(F.when(F.col("which") == w, F.col("f1"))), F.lit(0.0)).alias(w) for w in ("base", "cand")])
    return o.join(dec, "c").select("c", "base", "cand", (F.col("cand") - F.col("base")).alias("delta"), "declining_folds")


def group_safety(both: DataFrame, groups: DataFrame, n_classes: int, min_support: int = 4, min_folds: int = 2) -> DataFrame:
    """Per group: support, observed folds, delta, fold-delta SE, non-inferiority margin, declining folds."""
    g = _grouped(both, groups)
    key = ["dimension", "grp"]
    conf = settle(confusion(stack_models(g.select("fold", *key, "y", "base", "cand")), ["which", "fold", *key]))
    total = conf.groupBy("which", *key, "y", "yhat").agg(F.sum("n").alias("n"))
    side = lambda col: [F.max(F.when(F.col("which") == w, F.col(col))).alias(w) for w in ("base", "cand")]
    f = macro_f1(conf, ["which", "fold", *key], n_classes, counted=True).groupBy("fold", *key).agg(*side("macro_f1"))
    f = f.withColumn("d", F.col("cand") - F.col("base"))
    se = f.groupBy(*key).agg(F.count("*").alias("observed_folds"), (F.stddev_samp("d") / F.sqrt(F.count("*").cast("double"))).alias("se"))
    o = macro_f1(total, ["which", *key], n_classes, counted=True).groupBy(*key).agg(*side("macro_f1"))
    sup = conf.filter("which = 'base'").groupBy(*key).agg(F.sum("n").alias("support"))
    j = f.join(se, key)
    dec = j.groupBy(*key).agg(F.count_if(F.col("d") < -F.col("se") - TOL).alias("declining_folds"))
    r = o.join(sup, key).join(se, key).join(dec, key)
    ok = (F.col("support") >= min_support) & (F.col("observed_folds") >= min_folds)
    return r.select(*key, "support", "observed_folds", ok.cast("int").alias("sufficient"), "base", "cand",
                    F.when(ok, F.col("se")).alias("se"), F.when(ok, F.col("cand") - F.col("base") + F.col("se")).alias("margin"),
                    F.when(ok, F.col("declining_folds")).otherwise(0).alias("declining_folds"))


# --- bootstrap ---------------------------------------------------------------
STATES_PER_CHUNK = 4096


def bootstrap_deltas(both: DataFrame, repeats: int, seed: int, n_classes: int, pooled: bool = False, metric_classes: Sequence[int] | None = None,
                     states_per_chunk: int = STATES_PER_CHUNK) -> DataFrame:
    """Class-stratified paired bootstrap: (rep, delta) of macro-F1, candidate minus base.

    Rows of one sample in several seeds (column ``seed``, optional) are drawn
    together. Samples are first reduced to states (y, predictions) with counts;
    a replicate is a multinomial draw over states. The draw is made in two exact
    steps, chunk totals per class and then states inside a chunk of bounded
    size, so no task holds a class. ``pooled`` scores the pooled seeds instead
    of averaging seeds.
    """
    seeded = "seed" in both.columns
    d = both if seeded else both.withColumn("seed", F.lit(0))
    pairs = F.array_sort(F.collect_list(F.struct("seed", "base", "cand")))
    st = settle(d.groupBy("sample_id", "y").agg(pairs.alias("s")).groupBy("y", "s").agg(F.count("*").alias("n")))
    chunks = max(1, -(-st.count() // states_per_chunk))
    st = st.withColumn("chunk", F.pmod(F.xxhash64("s"), F.lit(chunks)).cast("int"))
    tot = st.groupBy("y", "chunk").agg(F.sum("n").alias("n"))

    def class_draw(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("chunk")
        n = pdf["n"].to_numpy()
        rng = np.random.default_rng([seed, int(key[0])])
        draws = rng.multinomial(int(n.sum()), n / n.sum(), size=repeats)
        return pd.DataFrame({"y": int(key[0]), "chunk": pdf["chunk"], "draws": [c.tolist() for c in draws.T]})

    chunked = tot.groupBy("y").applyInPandas(class_draw, "y int, chunk int, draws array<bigint>")
    # a state's predictions, one row each: the draw of a prediction is a product with its states
    cell = F.explode(F.flatten(F.transform("s", lambda r: F.array(
        F.struct(r["seed"].alias("seed"), F.lit("base").alias("which"), r["base"].alias("yhat")),
        F.struct(r["seed"].alias("seed"), F.lit("cand").alias("which"), r["cand"].alias("yhat"))))))
    long = st.select("y", "chunk", F.to_json("s").alias("state"), "n", cell.alias("c")).select("y", "chunk", "state", "n", "c.seed", "c.which", "c.yhat")

    def state_draw(key, left, right):
        import numpy as np
        import pandas as pd

        y, chunk = int(key[0]), int(key[1])
        states, first, row = np.unique(left["state"].to_numpy(), return_index=True, return_inverse=True)
        n = left["n"].to_numpy()[first]
        cells = left[["seed", "which", "yhat"]].drop_duplicates().reset_index(drop=True)
        col = left.merge(cells.assign(col=np.arange(len(cells))), on=["seed", "which", "yhat"], how="left")["col"].to_numpy()
        rng = np.random.default_rng([seed, y, chunk, 7])
        drawn = rng.multinomial(np.asarray(right["draws"].iloc[0]), n / n.sum())
        of = np.zeros((len(states), len(cells)), np.int64)
        np.add.at(of, (row, col), 1)
        counts = drawn @ of
        rep, c = np.nonzero(counts)
        return pd.DataFrame({"rep": rep, "seed": cells["seed"].to_numpy()[c], "which": cells["which"].to_numpy()[c], "y": y,
                             "yhat": cells["yhat"].to_numpy()[c], "n": counts[rep, c]})

    conf = long.groupBy("y", "chunk").cogroup(chunked.groupBy("y", "chunk")).applyInPandas(
        state_draw, "rep int, seed int, which string, y int, yhat int, n bigint")
    keys = ["rep", "which"] if pooled else ["rep", "seed", "which"]
    conf = conf.groupBy(*keys, "y", "yhat").agg(F.sum("n").alias("n"))
    c = class_f1(conf, keys, counted=True)
    if metric_classes is not None:
        c = c.filter(F.col("c").isin(*metric_classes))
        n_classes = len(metric_classes)
    c = c.withColumn("v", F.when(F.col("which") == "cand", F.col("f1")).otherwise(-F.col("f1")) / n_classes)
    per = c.groupBy(*[k for k in keys if k != "which"]).agg(F.sum("v").alias("delta"))
    return per if pooled else per.groupBy("rep").agg(F.avg("delta").alias("delta"))


def paired_bootstrap(both: DataFrame, repeats: int, seed: int, n_classes: int) -> DataFrame:
    """Mean delta, 95% interval, whether its lower end is non-negative and P(delta > 0)."""
    d = bootstrap_deltas(both, repeats, seed, n_classes)
    return d.agg(F.avg("delta").alias("mean_delta"), F.percentile("delta", 0.025).alias("ci_lower"),
                 F.percentile("delta", 0.975).alias("ci_upper"), F.avg((F.col("delta") > 0).cast("double")).alias("probability_positive")
                 ).withColumn("ci_lower_ge_0", (F.col("ci_lower") >= 0).cast("int"))


def bootstrap_se(both: DataFrame, repeats: int, seed: int, n_classes: int, mask: Column | None = None) -> DataFrame:
    """Standard error and 95% interval with all seeds of a sample sharing one draw."""
    d = bootstrap_deltas(both if mask is None else both.filter(mask), repeats, seed, n_classes, pooled=True)
    return d.agg(F.stddev_samp("delta").alias("se_boot"), F.percentile("delta", 0.025).alias("ci_lower"), F.percentile("delta", 0.975).alias("ci_upper"))


def seed_deltas(both: DataFrame, n_classes: int) -> DataFrame:
    """(seed, delta) of macro-F1, candidate minus base."""
    m = macro_f1(stack_models(both), ["seed", "which"], n_classes)
    v = F.when(F.col("which") == "cand", F.col("macro_f1")).otherwise(-F.col("macro_f1"))
    return m.groupBy("seed").agg(F.sum(v).alias("delta"))


def noninferiority(deltas: DataFrame, se_boot: Column | float) -> DataFrame:
    """Mean seed delta against epsilon = max(seed SE, bootstrap SE)."""
    boot = se_boot if isinstance(se_boot, Column) else F.lit(float(se_boot))
    d = deltas.agg(F.avg("delta").alias("delta"), F.coalesce(F.stddev_samp("delta") / F.sqrt(F.count("*").cast("double")), F.lit(0.0)).alias("se_seed"))
    d = d.withColumn("se_boot", boot).withColumn("epsilon", F.greatest("se_seed", "se_boot"))
    return d.withColumn("pass", (F.col("delta") >= -F.col("epsilon")).cast("int"))


# --- comparisons between models ------------------------------------------------
def rescue_harm(both: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per directed pair (source truth, target base error): rescues, harms and net.

    A rescue is a base error source->target the candidate gets right; a harm is a
    row of the source the base got right and the candidate sends to the target.
    """
    y, b, c = F.col("y"), F.col("base"), F.col("cand")
    kind = F.when((b != y) & (c == y), F.struct(b.alias("target"), F.lit(1).alias("r"), F.lit(0).alias("h"))).when(
        (b == y) & (c != y), F.struct(c.alias("target"), F.lit(0).alias("r"), F.lit(1).alias("h")))
    d = both.select(*keys, y.alias("source"), kind.alias("k")).filter("k is not null")
    g = d.groupBy(*keys, "source", F.col("k.target").alias("target")).agg(F.sum("k.r").alias("rescue"), F.sum("k.h").alias("harm"))
    return g.withColumn("net_rescue", F.col("rescue") - F.col("harm"))


def diversity(pred: DataFrame, proba: DataFrame, n_classes: int, models: Sequence[int]) -> DataFrame:
    """Pairwise model diversity in one pass over rows packed by sample.

    ``proba`` is (sample_id, model, y, p); ``pred`` is ignored when null.
    """
    packed = proba.groupBy("sample_id", "y").agg(F.map_from_entries(F.collect_list(F.struct("model", "p"))).alias("m"))
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    opts = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.element_at("m", F.lit(a)).alias("pa"), F.element_at("m", F.lit(b)).alias("pb"))
        for a, b in pairs]))
    d = packed.select("sample_id", "y", opts.alias("o")).select("sample_id", "y", "o.*")
    d = d.withColumn("ya", P.argmax(F.col("pa"))).withColumn("yb", P.argmax(F.col("pb"))).withColumn(
        "yo", F.when(F.col("ya") == F.col("y"), F.col("ya")).otherwise(F.col("yb"))).withColumn("ye", P.argmax(P.mix(F.col("pa"), F.col("pb"), 0.5)))
    oka, okb = F.col("ya") == F.col("y"), F.col("yb") == F.col("y")
    dot = lambda x, z: F.aggregate(F.zip_with(x, z, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    m = d.groupBy("a", "b").agg(
        F.avg((F.col("ya") != F.col("yb")).cast("double")).alias("disagreement"), F.avg((~oka & ~okb).cast("double")).alias("double_fault"),
        F.count_if(oka & ~okb).alias("rescue_a"), F.count_if(okb & ~oka).alias("rescue_b"),
        F.sum(dot(F.col("pa"), F.col("pb"))).alias("sab"), F.sum(dot(F.col("pa"), F.col("pa"))).alias("saa"),
        F.sum(dot(F.col("pb"), F.col("pb"))).alias("sbb"), F.sum(P.total(F.col("pa"))).alias("sa"), F.sum(P.total(F.col("pb"))).alias("sb"),
        F.sum(F.size("pa")).alias("n"))
    n = F.col("n")
    corr = (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(
        (n * F.col("saa") - F.col("sa") ** 2) * (n * F.col("sbb") - F.col("sb") ** 2))
    long = d.unpivot(["a", "b", "y"], ["ya", "yb", "yo", "ye"], "kind", "yhat")
    sc = macro_f1(long, ["a", "b", "kind"], n_classes).groupBy("a", "b").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("macro_f1"))).alias(k) for k in ("ya", "yb", "yo", "ye")])
    return m.join(sc, ["a", "b"]).select(
        "a", "b", "disagreement", "double_fault", "rescue_a", "rescue_b", corr.alias("proba_corr"), F.col("yo").alias("oracle_macro_f1"),
        F.col("ye").alias("blend_macro_f1"), (F.col("ye") - F.greatest("ya", "yb")).alias("blend_gain"))


def leaderboard(pred: DataFrame, n_classes: int, within: float = 0.025, specialist: float = 0.05, rescues: int = 3) -> DataFrame:
    """Models ranked by macro-F1 with fold spread and role flags.

    ``pred`` is (model, sample_id, fold, y, yhat). global: close to the leader;
    class specialist: some class F1 well above the leader's; rescuer: enough rows
    right that the leader gets wrong.
    """
    conf = settle(confusion(pred, ["model", "fold"]))
    c = class_f1(conf.groupBy("model", "y", "yhat").agg(F.sum("n").alias("n")), ["model"], counted=True)
    s = c.groupBy("model").agg((F.sum("f1") / n_classes).alias("macro_f1"))
    f = macro_f1(conf, ["model", "fold"], n_classes, counted=True).groupBy("model").agg(F.avg("macro_f1").alias("fold_mean"), F.stddev_pop("macro_f1").alias("fold_std"))
    s = s.join(f, "model").withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("macro_f1", 9)), "model")))
    lead = S.total(s, F.min_by("model", "rank"))
    top = S.total(s, F.max("macro_f1"))
    lf = c.withColumn("_l", lead).filter(F.col("model") == F.col("_l")).select("c", F.col("f1").alias("lf"))
    delta = c.join(lf, "c", "left").groupBy("model").agg(F.max(F.col("f1") - F.coalesce("lf", F.lit(0.0))).alias("class_delta"))
    leader = pred.withColumn("_l", lead).filter(F.col("model") == F.col("_l")).select("sample_id", F.col("yhat").alias("base"))
    resc = pred.join(leader, "sample_id").groupBy("model").agg(
        F.count_if((F.col("yhat") == F.col("y")) & (F.col("base") != F.col("y"))).alias("unique_rescue"))
    j = s.join(delta, "model").join(resc, "model").withColumn("_t", top)
    return j.select("model", "macro_f1", "fold_mean", "fold_std", "rank", "class_delta", "unique_rescue",
                    (F.col("macro_f1") >= F.col("_t") - within).cast("int").alias("is_global"),
                    (F.col("class_delta") >= specialist).cast("int").alias("is_class_specialist"),
                    (F.col("unique_rescue") >= rescues).cast("int").alias("is_rescuer"))


def one_se(stats: DataFrame) -> DataFrame:
    """Candidates within one SE of the best mean, ranked by gap, complexity, mean, name.

    ``stats`` is (name, mean, se, gap, complexity); rank 1 is the selection.
    """
    best = S.total(stats, F.max_by(F.struct("mean", "se"), F.struct("mean", F.col("name"))))
    d = stats.withColumn("_b", best).filter(F.col("mean") >= F.col("_b.mean") - F.col("_b.se")).drop("_b")
    order = W.orderBy("gap", "complexity", F.desc("mean"), "name")
    return d.withColumn("rank", F.row_number().over(order))


def select_roles(stats: DataFrame) -> DataFrame:
    """(role, name, qualified): primary by one-SE, then robust and specialist challengers.

    ``stats`` adds worst_floor, noninferior, collision, net_rescue. A role without a
    qualified candidate falls back to the best unqualified one.
    """
    stats = settle(stats)  # a row per candidate, read six times
    first = S.total(one_se(stats), F.min_by("name", "rank"))
    d = stats.withColumn("_p", first)
    floor = S.total(d.filter(F.col("name") == F.col("_p")), F.max("worst_floor"))
    rest = d.filter(F.col("name") != F.col("_p")).withColumn("_f", floor)
    rest = rest.withColumn("q", (F.col("noninferior") == 1) & (F.col("worst_floor") > F.col("_f")))
    ro = W.orderBy(F.desc("q"), F.desc("worst_floor"), F.desc("mean"), "complexity", "name")
    robust = rest.withColumn("r", F.row_number().over(ro)).filter("r = 1").select(F.lit("robustness").alias("role"), "name", F.col("q").cast("int").alias("qualified"))
    rname = S.total(robust, F.max("name"))
    left = rest.withColumn("_r", rname).filter(F.col("name") != F.col("_r")).withColumn("q", (F.col("noninferior") == 1) & (F.col("collision") == 1))
    so = W.orderBy(F.desc("q"), F.desc("net_rescue"), F.desc("mean"), "complexity", "name")
    special = left.withColumn("r", F.row_number().over(so)).filter("r = 1").select(F.lit("specialization").alias("role"), "name", F.col("q").cast("int").alias("qualified"))
    primary = d.filter(F.col("name") == F.col("_p")).select(F.lit("primary").alias("role"), "name", F.lit(1).alias("qualified"))
    return primary.unionByName(robust).unionByName(special)


def reference_delta(scores: DataFrame, reference: DataFrame, key: Sequence[str], col: str = "macro_f1") -> DataFrame:
    r = reference.select(*key, F.col(col).alias("reference"))
    return scores.select(*key, F.col(col).alias("candidate")).join(r, list(key)).withColumn("delta", F.col("candidate") - F.col("reference"))


def adopt(deltas: DataFrame, ci_lower: Column | float, need_all: bool = True) -> DataFrame:
    """Adopt when the mean improves, the interval's lower end is non-negative and all seeds improve."""
    ci = ci_lower if isinstance(ci_lower, Column) else F.lit(float(ci_lower))
    d = deltas.agg(F.avg("delta").alias("mean_delta"), F.min("delta").alias("worst")).withColumn("ci_lower", ci)
    ok = (F.col("mean_delta") > 0) & (F.col("ci_lower") >= 0)
    if need_all:
        ok = ok & (F.col("worst") > 0)
    return d.select("mean_delta", "ci_lower", (F.col("worst") > 0).cast("int").alias("all_improved"), ok.cast("int").alias("adopted"))


def changed(both: DataFrame) -> DataFrame:
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("cand") != F.col("base")).alias("changed"))


def collision_evidence(both: DataFrame, directions: Sequence[tuple[int, int]], n_classes: int, epsilon: Column | float = 0.0,
                       min_gain: float = 0.05, min_rescue: int = 3) -> DataFrame:
    """Per ordered pair: seeds with positive net, seeds with pair gain, rescues, outside delta, verdict.

    ``both`` is (sample_id, seed, y, base, cand).
    """
    opts = F.explode(F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in directions]))
    d = both.select("seed", "y", "base", "cand", opts.alias("o")).select("seed", "y", "base", "cand", "o.*")
    y, b, c = F.col("y"), F.col("base"), F.col("cand")
    d = d.withColumn("inside", (y == F.col("source")) | (y == F.col("target")))
    key = ["source", "target", "seed"]
    net = d.groupBy(*key).agg(
        F.count_if((y == F.col("source")) & (b == F.col("target")) & (c == y)).alias("rescue"), F.count_if((b == y) & (c != y)).alias("harm"))
    f = class_f1(stack_models(d.select(*key, "inside", "y", "base", "cand")), [*key, "inside", "which"])
    member = (F.col("c") == F.col("source")) | (F.col("c") == F.col("target"))
    sign = F.when(F.col("which") == "cand", F.col("f1")).otherwise(-F.col("f1"))
    g = f.groupBy(*key).agg((F.sum(F.when(F.col("inside") & member, sign)) / 2).alias("pair_delta"),
                            (F.sum(F.when(~F.col("inside"), sign)) / n_classes).alias("outside_delta"))
    j = net.join(g, key).withColumn("net", F.col("rescue") - F.col("harm"))
    r = j.groupBy("source", "target").agg(
        F.count_if(F.col("net") > 0).alias("seeds_net"), F.count_if(F.round("pair_delta", 9) >= min_gain).alias("seeds_gain"),
        F.sum("rescue").alias("rescue"), F.sum("net").alias("net_rescue"), F.avg("outside_delta").alias("outside_delta"))
    eps = epsilon if isinstance(epsilon, Column) else F.lit(float(epsilon))
    ok = (F.col("seeds_net") >= 2) & (F.col("seeds_gain") >= 2) & (F.col("rescue") >= min_rescue) & (F.round("outside_delta", 9) >= -F.col("_e"))
    return r.withColumn("_e", eps).withColumn("qualifies", ok.cast("int")).drop("_e")
