"""Probability tables: calibrate, blend, redistribute, vote.

Packed form: one row per (keys, sample_id) with ``p array<double>`` indexed by
class id, so row-wise math needs no shuffle. Long form: one row per class.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenfold.functions import probs as P
from tokenfold.functions import stats as S


def pack(long: DataFrame, n_classes: int, keys: Sequence[str] = ("sample_id",), fill: float = 0.0) -> DataFrame:
    """Long (keys, class_id, p) to arrays; absent classes get ``fill``."""
    g = long.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("class_id", "p"))).alias("m"))
    ids = F.sequence(F.lit(0), F.lit(n_classes - 1))
    return g.select(*keys, F.transform(ids, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(fill))).alias("p"))


def unpack(packed: DataFrame) -> DataFrame:
    rest = [c for c in packed.columns if c != "p"]
    return packed.select(*rest, F.posexplode("p").alias("class_id", "p"))


def apply(packed: DataFrame, expr: Column) -> DataFrame:
    return packed.withColumn("p", expr)


def softmax(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    return apply(scores, P.softmax(F.col("p"), temperature))


def calibrate(proba: DataFrame, temperature: float) -> DataFrame:
    return apply(proba, P.calibrate(F.col("p"), temperature))


def normalize_proba(proba: DataFrame, low: float = 1e-7) -> DataFrame:
    return apply(proba, P.normalize(F.transform("p", lambda x: F.greatest(x, F.lit(low)))))


def _pair(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys, F.col("p").alias("q")), list(keys))


def blend(a: DataFrame, b: DataFrame, w: float, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    return apply(_pair(a, b, keys), P.blend(F.col("p"), F.col("q"), w)).drop("q")


def logit_combine(scores: DataFrame, proba: DataFrame, t_score: float, t_proba: float, w: float, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """softmax((1-w) score/T1 + w ln(p)/T2)."""
    j = _pair(scores, proba, keys)
    s = F.zip_with("p", P.log_clip(F.col("q")), lambda x, y: (1 - w) * x / t_score + w * y / t_proba)
    return apply(j, P.softmax(s)).drop("q")


def by_model(proba: DataFrame, keys: Sequence[str] = ("sample_id", "y")) -> DataFrame:
    """One row per sample with a map model -> p; the shuffle all model combinations share."""
    return proba.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("model", "p"))).alias("m"))


def _models(weights: Mapping) -> list[Column]:
    return [F.element_at("m", F.lit(k)) for k in weights]


def soft_vote(models: DataFrame, weights: Mapping) -> DataFrame:
    """Normalised weighted sum over models of :func:`by_model` rows."""
    return models.withColumn("p", P.normalize(P.weighted_sum(_models(weights), list(weights.values())))).drop("m")


def log_blend(models: DataFrame, weights: Mapping) -> DataFrame:
    """softmax of the weighted sum of log probabilities."""
    return models.withColumn("p", P.softmax(P.weighted_sum([P.log_clip(x) for x in _models(weights)], list(weights.values())))).drop("m")


def class_multiply(proba: DataFrame, multipliers: Sequence[float]) -> DataFrame:
    return apply(proba, P.normalize(F.zip_with("p", P.lit_array(multipliers), lambda x, y: x * y)))


def class_prior(samples: DataFrame, n_classes: int, y: str = "y") -> Column:
    """Class shares as a scalar array."""
    n = samples.groupBy(F.col(y).cast("int").alias("c")).agg(F.count("*").alias("n"))
    m = n.agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("m"), F.sum("n").alias("t"))
    ids = F.sequence(F.lit(0), F.lit(n_classes - 1))
    return m.select(F.transform(ids, lambda i: F.coalesce(F.element_at("m", i), F.lit(0)) / F.col("t")).alias("p")).scalar()


def prior_adjust(proba: DataFrame, prior: Column, gamma: float, temperature: float) -> DataFrame:
    return proba.withColumn("_q", prior).withColumn("p", P.adjust_prior(F.col("p"), F.col("_q"), gamma, temperature)).drop("_q")


def pair_right(proba: DataFrame, left: int, right: int, temperature: float, offset: float) -> DataFrame:
    return proba.select("sample_id", P.pair_right(F.col("p"), left, right, temperature, offset).alias("right"))


def pair_redistribute(base: DataFrame, shares: Mapping[tuple[int, int], tuple[Column, float]], strict: bool = False) -> DataFrame:
    """Mix an expert's right share into each pair where the first choice is in the pair.

    ``shares`` maps (left, right) to the expert's right share (a column of
    ``base``) and its weight. Pair mass is kept. Adds ``yhat``: the arg-max, or in
    strict mode the pair member with at least half of the mixed share.
    """
    d = base.withColumn("_o", F.col("p")).withColumn("_top", P.argmax(F.col("p")))
    strict_hat = F.col("_top")
    for (left, right), (expert, w) in shares.items():
        if w <= 0:
            continue
        active = F.col("_top").isin(left, right)
        mixed = (1 - w) * P.base_right(F.col("_o"), left, right) + w * expert
        mass = P.at(F.col("_o"), left) + P.at(F.col("_o"), right)
        d = d.withColumn("p", F.when(active, P.put(F.col("p"), {left: mass * (1 - mixed), right: mass * mixed})).otherwise(F.col("p")))
        strict_hat = F.when(active, F.when(mixed >= 0.5, right).otherwise(left)).otherwise(strict_hat)
    d = d.withColumn("p", P.normalize(F.col("p")))
    return d.withColumn("yhat", strict_hat if strict else P.argmax(F.col("p"))).drop("_o", "_top")


def pair_mixture(base: DataFrame, pairs: Mapping[tuple[int, int], tuple[float, Sequence[tuple[Column, float]]]]) -> DataFrame:
    """Fixed mixture of several experts per pair: base weight and (share, weight) parts."""
    d = base.withColumn("_top", P.argmax(F.col("p"))).withColumn("_o", F.col("p"))
    for (left, right), (w0, parts) in pairs.items():
        share = w0 * P.base_right(F.col("_o"), left, right)
        for expert, w in parts:
            share = share + w * expert
        mass = P.at(F.col("_o"), left) + P.at(F.col("_o"), right)
        active = F.col("_top").isin(left, right)
        d = d.withColumn("p", F.when(active, P.put(F.col("p"), {left: mass * (1 - share), right: mass * share})).otherwise(F.col("p")))
    return d.withColumn("yhat", P.argmax(F.col("p"))).drop("_top", "_o")


def collision_expert(base: DataFrame, left: int, right: int, expert_right: Column) -> DataFrame:
    """Replace the split of a pair by the expert's where the first choice is in the pair."""
    active = P.argmax(F.col("p")).isin(left, right)
    return apply(base, P.split_pair(F.col("p"), left, right, expert_right, active))


def pair_margin(scores: DataFrame, left: int, right: int, expert_margin: Column, w: float, temperature: float, min_mass: float) -> DataFrame:
    """Mix an expert margin into the scores of a pair holding the two best classes."""
    d = scores.withColumn("_t", P.top_two(F.col("p"))).withColumn("_q", P.softmax(F.col("p"), temperature))
    both = (F.least("_t.top1", "_t.top2") == min(left, right)) & (F.greatest("_t.top1", "_t.top2") == max(left, right))
    active = both & ((P.at(F.col("_q"), left) + P.at(F.col("_q"), right)) >= min_mass)
    a, b = P.at(F.col("p"), left), P.at(F.col("p"), right)
    margin = (1 - w) * (b - a) + w * expert_margin
    center = (a + b) / 2
    out = F.when(active, P.put(F.col("p"), {left: center - margin / 2, right: center + margin / 2})).otherwise(F.col("p"))
    return d.withColumn("p", out).drop("_t", "_q")


def pair_sigmoid(base: DataFrame, left: int, right: int, expert_margin: Column, temperature: float, w: float, min_mass: float) -> DataFrame:
    """Mix sigmoid(margin/T) into the pair's split where the pair holds the two best classes."""
    d = base.withColumn("_t", P.top_two(F.col("p")))
    both = (F.least("_t.top1", "_t.top2") == min(left, right)) & (F.greatest("_t.top1", "_t.top2") == max(left, right))
    active = both & ((P.at(F.col("p"), left) + P.at(F.col("p"), right)) >= min_mass)
    share = (1 - w) * P.base_right(F.col("p"), left, right) + w / (1 + F.exp(-expert_margin / temperature))
    return d.withColumn("p", P.normalize(P.split_pair(F.col("p"), left, right, share, active))).drop("_t")


def pair_bias(proba: DataFrame, pair: tuple[int, int], margin: float, alpha: float) -> DataFrame:
    """Move alpha of the target's mass to the source where target leads source by at most margin."""
    source, target = pair
    t = P.top_two(F.col("p"))
    d = proba.withColumn("_t", t)
    active = (F.col("_t.top1") == target) & (F.col("_t.top2") == source) & (F.col("_t.gap") <= margin + 1e-12)
    moved = alpha * P.at(F.col("p"), target)
    out = P.put(F.col("p"), {target: P.at(F.col("p"), target) - moved, source: P.at(F.col("p"), source) + moved})
    return d.withColumn("p", P.normalize(F.when(active, out).otherwise(F.col("p")))).drop("_t")


def gate(base: DataFrame, expert: DataFrame, pair: tuple[int, int], margin: float, confidence: float, w: float) -> DataFrame:
    """Blend a confident expert in where the base narrowly prefers target over source."""
    if not 0.1 <= w <= 0.3:
        raise ValueError("the expert weight must be 0.1 to 0.3")
    source, target = pair
    d = _pair(base, expert, ["sample_id"]).withColumn("_t", P.top_two(F.col("p")))
    on = (F.col("_t.top1") == target) & (F.col("_t.top2") == source) & (F.col("_t.gap") <= margin) & (F.array_max("q") >= confidence)
    out = F.when(on, P.mix(F.col("p"), F.col("q"), w)).otherwise(F.col("p"))
    return d.withColumn("p", P.normalize(out)).drop("_t", "q")


# --- votes ---------------------------------------------------------------------
def learn_vote_rules(votes: DataFrame, cols: Sequence[str], n_classes: int, minimum: int, shrinkage: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, votes..., yhat) for vote tuples whose best label beats the first voter's.

    Each training row of class c weighs n / (C * n_c). The best label is the voted
    label with the largest utility (ties: lowest id); it must differ from the first
    vote and win by more than ``shrinkage``.
    """
    size = votes.groupBy(*keys, "y").agg(F.count("*").alias("nc"))
    tot = size.groupBy(*keys).agg(F.sum("nc").alias("nt"))
    cw = size.join(tot, list(keys)) if keys else size.withColumn("nt", S.total(size, F.sum("nc")))
    cw = cw.select(*keys, "y", (F.col("nt") / (n_classes * F.col("nc"))).alias("w"))
    g = votes.groupBy(*keys, *cols, "y").agg(F.count("*").alias("n"))
    g = g.join(cw, [*keys, "y"]).withColumn("u", F.col("n") * F.col("w"))
    return _best_vote(g, keys, cols, minimum, shrinkage)


def learn_vote_rules_oof(votes: DataFrame, cols: Sequence[str], n_classes: int, minimum: int, shrinkage: float, k: int) -> DataFrame:
    """Rules per held fold, learnt on the other folds from counts taken once.

    Vote states (votes, y, fold) are counted; what fold f may see is the total
    minus its part.
    """
    g = votes.groupBy(*cols, "y", "fold").agg(F.count("*").alias("n"))
    part = F.explode(F.array(*[F.lit(i) for i in range(k)]))
    d = g.select("*", part.alias("held")).filter("held <> fold").groupBy("held", *cols, "y").agg(F.sum("n").alias("n"))
    size = d.groupBy("held", "y").agg(F.sum("n").alias("nc"))
    tot = size.groupBy("held").agg(F.sum("nc").alias("nt"))
    cw = size.join(tot, "held").select("held", "y", (F.col("nt") / (n_classes * F.col("nc"))).alias("w"))
    g = d.join(cw, ["held", "y"]).withColumn("u", F.col("n") * F.col("w"))
    return _best_vote(g, ["held"], cols, minimum, shrinkage)


def _best_vote(g: DataFrame, keys: Sequence[str], cols: Sequence[str], minimum: int, shrinkage: float) -> DataFrame:
    voted = F.array_contains(F.array(*[F.col(c) for c in cols]), F.col("y"))
    r = g.groupBy(*keys, *cols).agg(
        F.sum("n").alias("count"),
        F.max_by(F.col("y"), F.when(voted, F.struct(F.round("u", 9).alias("u"), (-F.col("y")).alias("i")))).alias("yhat"),
        F.max(F.when(voted, F.col("u"))).alias("gain"),
        F.coalesce(F.max(F.when(F.col("y") == F.col(cols[0]), F.col("u"))), F.lit(0.0)).alias("base"))
    keep = (F.col("count") >= minimum) & (F.col("yhat") != F.col(cols[0])) & (F.col("gain") > F.col("base") + shrinkage)
    return r.filter(keep).select(*keys, *cols, "count", "yhat")


def apply_vote_rules(votes: DataFrame, rules: DataFrame, cols: Sequence[str], by_fold: bool = False) -> DataFrame:
    """The rule's label where the vote tuple has one, else the first vote."""
    r = rules.withColumnRenamed("held", "fold") if by_fold else rules
    on = [*cols, "fold"] if by_fold else list(cols)
    j = votes.join(r.select(*on, F.col("yhat").alias("_r")), on, "left")
    return j.withColumn("yhat", F.coalesce("_r", F.col(cols[0]))).drop("_r")


# --- contracts and summaries -------------------------------------------------------
def align_classes(long: DataFrame, n_classes: int, fill: float = 0.0, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Every class for every row; absent ones get ``fill``, then rows are renormalised."""
    return apply(pack(long, n_classes, keys, fill), P.normalize(F.col("p")))


def proba_violations(packed: DataFrame, n_classes: int, tolerance: float = 1e-6) -> DataFrame:
    """Counts of rows that are incomplete, not finite, negative or do not sum to one."""
    p = F.col("p")
    bad = lambda f: F.exists(p, f)
    return packed.agg(
        F.count("*").alias("n_rows"), F.count_if(F.size(p) != n_classes).alias("incomplete"),
        F.count_if(bad(lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("not_finite"),
        F.count_if(bad(lambda x: x < 0)).alias("negative"), F.count_if(F.abs(P.total(p) - 1) > tolerance).alias("bad_sum"))


def validate_proba(packed: DataFrame, n_classes: int, tolerance: float = 1e-6) -> DataFrame:
    v = proba_violations(packed, n_classes, tolerance).first()
    broken = {k: v[k] for k in ("incomplete", "not_finite", "negative", "bad_sum") if v[k]}
    if broken:
        raise ValueError(f"invalid probabilities: {broken}")
    return packed


def meta_features(proba: DataFrame) -> DataFrame:
    """ln p, entropy and top-two margin of every (sample, model)."""
    q = F.transform("p", lambda x: F.least(F.greatest(x, F.lit(1e-7)), F.lit(1.0)))
    d = proba.withColumn("_q", q)
    return d.withColumn("log_p", F.transform("_q", F.ln)).withColumn("entropy", P.entropy(F.col("_q"))).withColumn(
        "margin", P.top_two(F.col("_q"))["gap"]).drop("_q", "p")


def mean_argmax(proba: DataFrame, n_classes: int) -> DataFrame:
    """Mean probabilities over seeds, folds or models of each sample and their arg-max."""
    g = proba.groupBy("sample_id").agg(*[F.avg(P.at(F.col("p"), i)).alias(f"p{i}") for i in range(n_classes)])
    return g.select("sample_id", F.array(*[F.col(f"p{i}") for i in range(n_classes)]).alias("p")).withColumn("yhat", P.argmax(F.col("p")))


def class_weights(samples: DataFrame, kind: str = "balanced", power: float = 0.5, beta: float = 0.999, low: float = 0.0, high: float = 1e9) -> DataFrame:
    """Weights per class: balanced, balanced to a power, or effective number of samples; clipped."""
    n = samples.groupBy("y").agg(F.count("*").alias("n"))
    t = S.total(n, F.struct(F.sum("n").alias("t"), F.count("*").alias("c")))
    d = n.withColumn("_t", t)
    balanced = F.col("_t.t") / (F.col("_t.c") * F.col("n"))
    if kind == "balanced":
        w = balanced
    elif kind == "power":
        w = F.pow(balanced, F.lit(power))
    else:
        raw = lambda c: (1 - beta) / (1 - F.pow(F.lit(beta), c.cast("double")))
        mean = S.total(n, F.sum(raw(F.col("n")) * F.col("n")) / F.sum("n"))
        d = d.withColumn("_m", mean)
        w = raw(F.col("n")) / F.col("_m")
    return d.select("y", "n", F.least(F.greatest(w, F.lit(float(low))), F.lit(float(high))).alias("weight"))
