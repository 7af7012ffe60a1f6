"""Class signatures and other label statistics, learnt fold-safe.

Label statistics need counts per class and gene outside some folds. They are
taken once per (gene, label, fold); what a training part sees is the total minus
the held folds, so events are never replicated per fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenfold.functions import stats as S
from tokenfold.operators.gram import gram
from tokenfold.session import keep, settle

FULL = -1  # held fold of a statistic over all rows


def _held_entry() -> Column:
    return F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "x"))))


def leave_out(parts: Sequence[tuple[int, int]]) -> Column:
    """Literal (outer, inner) pairs of folds to hold out."""
    return F.array(*[F.struct(F.lit(o).alias("outer"), F.lit(i).alias("inner")) for o, i in parts])


def _rest(entry: Column, field: str) -> Column:
    """Total of an entry minus its two held folds."""
    def held(f):
        return F.coalesce(F.element_at(entry["held"], f)[field], F.lit(0.0))

    return F.coalesce(entry[f"t{field}"] - held(F.col("outer")) - held(F.col("inner")), F.lit(0.0))


def class_gene_counts(
    presence: DataFrame,
    samples: DataFrame,
    parts: Sequence[tuple[int, int]] = ((FULL, FULL),),
    missing: DataFrame | None = None,
    siblings: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Counts (outer, inner, gene, label, a, t, n, m, xa, xt) for every class and training part.

    a and t: mutated samples in the class and in total, n and m: samples in the
    class and in total, xa and xt: missing ones. ``samples`` may carry a ``fold``
    and a row weight ``w``. With ``siblings`` (label to its set) totals cover the
    label's set only.
    """
    s = samples.withColumn("fold", F.col("fold") if "fold" in samples.columns else F.lit(0))
    s = s.withColumn("w", F.col("w").cast("double") if "w" in samples.columns else F.lit(1.0)).select("sample_id", "label", "fold", "w")
    rows = presence.select("sample_id", "gene", F.lit(0.0).alias("x"))
    if missing is not None:
        rows = rows.unionByName(missing.select("sample_id", "gene", F.lit(1.0).alias("x")))
    per = rows.join(s, "sample_id").groupBy("gene", "label", "fold").agg(
        F.sum(F.col("w") * (1 - F.col("x"))).alias("n"), F.sum(F.col("w") * F.col("x")).alias("x"))
    per = per.groupBy("gene", "label").agg(F.sum("n").alias("tn"), F.sum("x").alias("tx"), _held_entry().alias("held"))
    entry = F.struct("tn", "tx", "held")
    # one row per gene: every later use reads this small table, not the events
    genes = settle(per.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("label", entry))).alias("g")))
    size = s.groupBy("label", "fold").agg(F.sum("w").alias("n"), F.lit(0.0).alias("x"))
    size = size.groupBy("label").agg(F.sum("n").alias("tn"), F.sum("x").alias("tx"), _held_entry().alias("held"))
    sizes = S.keyed_map(size, F.col("label"), entry)
    d = genes.select("gene", "g", F.explode(leave_out(parts)).alias("part")).select("gene", "g", "part.*")
    d = d.withColumn("s", sizes).select("*", F.explode("s").alias("label", "own"))

    def over(m: str, field: str) -> Column:
        zero = F.lit(0.0)
        if siblings is None:
            return F.aggregate(F.map_values(m), zero, lambda acc, e: acc + _rest(e, field))
        lists = F.create_map(*[v for k, vs in siblings.items() for v in (F.lit(k), F.array(*[F.lit(x) for x in vs]))])
        return F.aggregate(F.element_at(lists, F.col("label")), zero, lambda acc, v: acc + _rest(F.element_at(m, v), field))

    if siblings is not None:
        d = d.filter(F.col("label").isin(*siblings))
    mine = F.element_at("g", F.col("label"))
    return d.select(
        "outer", "inner", "gene", "label", _rest(mine, "n").alias("a"), over("g", "n").alias("t"),
        _rest(F.col("own"), "n").alias("n"), over("s", "n").alias("m"), _rest(mine, "x").alias("xa"),
        over("g", "x").alias("xt")).filter("n > 0 and m > n")


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def _odds_score(s: float, max_log2: float, shrinkage: float) -> Column:
    a, t, n = F.col("a"), F.col("t"), F.col("n")
    b, o = t - a, F.col("m") - n
    odds = ((a + s) / (n - a + s)) / ((b + s) / (o - b + s))
    return _clip(F.log2(odds), 0.0, max_log2) * F.sqrt(t / (t + shrinkage))


def _rate_score(s: float, max_log2: float, shrinkage: float) -> Column:
    a, n = F.col("a"), F.col("n")
    ri = (a + s) / (n + 2 * s)
    ro = (F.col("t") - a + s) / (F.col("m") - n + 2 * s)
    odds = F.log2((ri / (1 - ri)) / (ro / (1 - ro)))
    return _clip(odds, -max_log2, max_log2) * (a / (a + shrinkage))


def top_per_class(counts: DataFrame, score: Column, top: int, positive: bool, by: Sequence[str] = ("outer", "inner", "label")) -> DataFrame:
    """The ``top`` genes per class by score (9 decimals), ties by gene name."""
    d = counts.withColumn("w", score)
    if positive:
        d = d.filter("w > 0")
    order = W.partitionBy(*by).orderBy(F.desc(F.round("w", 9)), "gene")
    return d.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def class_weights(
    presence: DataFrame, samples: DataFrame, top: int = 20, smoothing: float = 0.5, max_log2: float = 8.0,
    shrinkage: float = 10.0, variant: str = "odds", parts: Sequence[tuple[int, int]] = ((FULL, FULL),),
    siblings: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One-vs-rest weights (outer, label, gene, w, rank).

    ``odds``: clipped log2 odds ratio times sqrt(t/(t+shrinkage)), positive only.
    ``rate``: signed log2 rate odds times a/(a+shrinkage), no sign filter.
    """
    c = class_gene_counts(presence, samples, parts, siblings=siblings)
    score = (_odds_score if variant == "odds" else _rate_score)(smoothing, max_log2, shrinkage)
    return top_per_class(c, score, top, variant == "odds").select("outer", "label", "gene", "w", "rank")


def _oof_parts(k: int) -> list[tuple[int, int]]:
    return [(i, FULL) for i in range(k)]


def signature_score(presence: DataFrame, weights: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """Weighted sum and match count per (sample, label); absent rows are zero.

    With ``folds`` each sample is scored by the weights that held its own fold out.
    """
    if folds is None:
        j = presence.join(weights.select("label", "gene", "w"), "gene")
    else:
        p = presence.join(folds.select("sample_id", F.col("fold").alias("outer")), "sample_id")
        j = p.join(weights.select("outer", "label", "gene", "w"), ["outer", "gene"])
    return j.groupBy("sample_id", "label").agg(F.sum("w").alias("weighted"), F.count("*").alias("matches"))


def signature_rate(scores: DataFrame, presence: DataFrame) -> DataFrame:
    b = presence.groupBy("sample_id").agg(F.count("*").alias("burden"))
    return scores.join(b, "sample_id").withColumn("match_rate", S.ratio(F.col("matches"), F.col("burden"))).drop("burden")


def oof_signature(presence: DataFrame, folds: DataFrame, k: int, **params) -> DataFrame:
    """Signature scores of every sample by weights learnt without its fold."""
    w = class_weights(presence, folds, parts=_oof_parts(k), **params)
    return signature_score(presence, w, folds)


def dual_signature(all_presence: DataFrame, functional: DataFrame, folds: DataFrame, k: int, **params) -> DataFrame:
    """Out-of-fold signatures of the all and the functional channel."""
    one = oof_signature(all_presence, folds, k, **params).withColumn("channel", F.lit("all"))
    return one.unionByName(oof_signature(functional, folds, k, **params).withColumn("channel", F.lit("functional")))


def group_weighted(samples: DataFrame, groups: DataFrame, power: float, group: str = "profile") -> DataFrame:
    """Row weight = (size of the sample's group) ** -power."""
    n = groups.groupBy(group).agg(F.count("*").alias("_n"))
    g = groups.select("sample_id", group).join(n, group)
    return samples.join(g.select("sample_id", F.pow(F.col("_n").cast("double"), F.lit(-power)).alias("w")), "sample_id")


def map_labels(samples: DataFrame, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace labels by the family they belong to."""
    pairs = [v for fam, members in mapping.items() for m in members for v in (F.lit(m), F.lit(fam))]
    return samples.withColumn("label", F.element_at(F.create_map(*pairs), F.col("label")))


def _scope(samples: DataFrame, k: int | None) -> tuple[list, DataFrame | None]:
    """Training parts and scoring folds: all rows, or out of fold when k is given."""
    return ([(FULL, FULL)], None) if k is None else (_oof_parts(k), samples)


def family_signature(presence: DataFrame, samples: DataFrame, families: Mapping[str, Sequence[str]], k: int | None = None, **params) -> DataFrame:
    """Weighted score and match rate of families with at least two labels; out of fold with ``k``."""
    many = [f for f, members in families.items() if len(members) >= 2]
    parts, folds = _scope(samples, k)
    w = class_weights(presence, map_labels(samples, families), parts=parts, **params).filter(F.col("label").isin(*many))
    return signature_rate(signature_score(presence, w, folds), presence)


def sibling_signature(presence: DataFrame, samples: DataFrame, families: Mapping[str, Sequence[str]], k: int | None = None, **params) -> DataFrame:
    """Signatures whose negatives are only the other labels of the same family; out of fold with ``k``."""
    siblings = {m: members for members in families.values() if len(members) >= 2 for m in members}
    parts, folds = _scope(samples, k)
    w = class_weights(presence, samples, parts=parts, siblings=siblings, **params)
    return signature_rate(signature_score(presence, w, folds), presence)


def pair_contrast(scores: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Signature of the left label minus that of the right one, per pair."""
    options = F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs]))
    d = scores.select("*", options.alias("pair")).select("*", "pair.*")
    sign = F.when(F.col("label") == F.col("left"), 1).when(F.col("label") == F.col("right"), -1)
    return d.withColumn("sign", sign).filter("sign is not null").groupBy("sample_id", "left", "right").agg(
        F.sum(F.col("sign") * F.col("weighted")).alias("weighted_diff"), F.sum(F.col("sign") * F.col("matches")).alias("count_diff"))


def similarity_state(
    presence: DataFrame, samples: DataFrame, top: int = 20, smoothing: float = 0.5, max_log2: float = 8.0,
    shrinkage: float = 10.0, parts: Sequence[tuple[int, int]] = ((FULL, FULL),),
) -> DataFrame:
    """Class profiles (outer, gene, label, rate, w): smoothed rates, and weights of the top genes."""
    c = class_gene_counts(presence, samples, parts)
    rate = (F.col("a") + smoothing) / (F.col("n") + 2 * smoothing)
    w = top_per_class(c, _rate_score(smoothing, max_log2, shrinkage), top, False).filter("w > 0")
    return c.select("outer", "gene", "label", rate.alias("rate")).join(w.select("outer", "gene", "label", "w"), ["outer", "gene", "label"], "left")


def similarity_score(presence: DataFrame, samples: DataFrame, state: DataFrame, temperature: float = 0.2) -> DataFrame:
    """Per (sample, label): weighted score and cosine to the class profile; per sample:
    margin of the two best cosines and normalised entropy of their softmax.

    ``samples`` is (sample_id, outer): the part whose profiles score a sample.
    """
    norm = S.keyed_map(state.groupBy("outer", "label").agg(F.sqrt(F.sum(F.col("rate") ** 2)).alias("v")), F.struct("outer", "label"), F.col("v"))
    j = presence.join(samples.select("sample_id", "outer"), "sample_id").join(state, ["outer", "gene"])
    g = j.groupBy("sample_id", "outer", "label").agg(F.sum("w").alias("weighted"), F.sum("rate").alias("dot"), F.count("*").alias("burden"))
    cos = F.col("dot") / F.greatest(F.sqrt(F.col("burden").cast("double")) * F.element_at(F.col("_n"), F.struct("outer", "label")), F.lit(1e-12))
    g = g.withColumn("_n", norm).select("sample_id", "label", F.coalesce("weighted", F.lit(0.0)).alias("weighted"), cos.alias("similarity"))
    packed = g.groupBy("sample_id").agg(F.collect_list(F.struct("label", "weighted", "similarity")).alias("rows"))
    sims = F.reverse(F.array_sort(F.transform("rows", lambda r: r["similarity"])))
    packed = packed.withColumn("sims", sims).withColumn("z", F.transform("sims", lambda x: F.exp((x - F.col("sims")[0]) / temperature)))
    packed = packed.withColumn("t", F.aggregate("z", F.lit(0.0), lambda a, x: a + x))
    h = F.aggregate("z", F.lit(0.0), lambda a, x: a - (x / F.col("t")) * F.ln(x / F.col("t") + 1e-12))
    return packed.select(
        "sample_id", F.explode("rows").alias("r"),
        F.when(F.size("sims") >= 2, F.col("sims")[0] - F.get("sims", F.lit(1))).otherwise(F.col("sims")[0]).alias("margin"),
        (h / F.ln(F.greatest(F.size("sims"), F.lit(2)).cast("double"))).alias("entropy")).select(
        "sample_id", "r.label", "r.weighted", "r.similarity", "margin", "entropy")


def signature_similarity(presence: DataFrame, samples: DataFrame, temperature: float = 0.2, k: int | None = None, **params) -> DataFrame:
    """Scores against the class profiles of the same rows; out of fold with ``k``."""
    parts = [(FULL, FULL)] if k is None else _oof_parts(k)
    outer = samples.select("sample_id", (F.lit(FULL) if k is None else F.col("fold")).alias("outer"))
    return similarity_score(presence, outer, similarity_state(presence, samples, parts=parts, **params), temperature)


# --- log-odds statistics with missing cells ----------------------------------
def _logit_effects(c: DataFrame, alpha: float) -> DataFrame:
    oc = F.col("n") - F.col("xa")
    orest = F.col("m") - F.col("xt") - oc
    p1 = (F.col("a") + alpha) / (oc + 2 * alpha)
    p0 = (F.col("t") - F.col("a") + alpha) / (orest + 2 * alpha)
    return c.withColumn("p1", p1).withColumn("p0", p0).withColumn(
        "effect", F.ln("p1") - F.log1p(-F.col("p1")) - F.ln("p0") + F.log1p(-F.col("p0")))


def f5_stats(presence: DataFrame, missing: DataFrame, samples: DataFrame, alpha: float = 1.0,
             parts: Sequence[tuple[int, int]] = ((FULL, FULL),)) -> DataFrame:
    """Natural-log odds per class and gene; missing cells leave the denominators."""
    return _logit_effects(class_gene_counts(presence, samples, parts, missing=missing), alpha)


def _f5_rank(d: DataFrame, by: Sequence[str], top: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc(F.round(F.abs("effect"), 9)), "gene")
    return d.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _inner_parts(k: int, outer: Sequence[int]) -> list[tuple[int, int]]:
    """For each outer part the full fit and one fit per remaining fold."""
    return [(o, i) for o in outer for i in [FULL, *[f for f in range(k) if f != o]]]


def f5_stable(presence: DataFrame, missing: DataFrame, folds: DataFrame, k: int, top: int = 25, minimum: int = 5,
              alpha: float = 1.0, min_direction: int = 4, min_frequency: int = 3, outer: Sequence[int] = (FULL,)) -> DataFrame:
    """Selected genes per class: same sign and often enough in the top over stability folds.

    The stability folds of an outer training part are its remaining folds, so
    the fits are differences of the same counts.
    """
    e = settle(f5_stats(presence, missing, folds, alpha, _inner_parts(k, outer)))
    inner, full = e.filter(F.col("inner") != FULL), e.filter((F.col("inner") == FULL) & (F.col("t") >= minimum))
    key = ["outer", "label", "gene"]
    hits = _f5_rank(inner.filter(F.col("t") >= minimum), ["outer", "inner", "label"], top)
    hits = hits.groupBy(*key).agg(F.count("*").alias("frequency"))
    agree = (F.signum("e1") == F.signum("effect")) & (F.signum("effect") != 0)
    same = (inner.select(*key, F.col("effect").alias("e1")).join(full.select(*key, "effect"), key)
            .filter(agree).groupBy(*key).agg(F.count("*").alias("direction")))
    n = F.when(F.col("outer") == FULL, F.lit(k)).otherwise(F.lit(k - 1))
    sel = full.join(hits, key).join(same, key).filter(
        (F.col("direction") >= F.least(F.lit(min_direction), n)) & (F.col("frequency") >= F.least(F.lit(min_frequency), n)))
    sel = _f5_rank(sel, ["outer", "label"], top)
    return settle(sel.select(*key, "rank", "effect", F.ln("p1").alias("log_mut"), F.log1p(-F.col("p1")).alias("log_wt"),
                           "direction", "frequency"))


def f5_score(presence: DataFrame, missing: DataFrame, samples: DataFrame, state: DataFrame, oof: bool = False) -> DataFrame:
    """Log-odds sum, mean and max over mutated genes and Bernoulli log-likelihood.

    The likelihood is the class's sum of log_wt, plus (log_mut - log_wt) for
    mutated and minus log_wt for missing genes, so only those cells are joined.
    """
    base = S.keyed_map(state.groupBy("outer", "label").agg(F.sum("log_wt").alias("v")), F.struct("outer", "label"), F.col("v"))
    s = samples.select("sample_id", (F.col("fold") if oof else F.lit(FULL)).alias("outer"))
    cells = presence.select("sample_id", "gene", F.lit(1).alias("mut")).unionByName(missing.select("sample_id", "gene", F.lit(0).alias("mut")))
    j = cells.join(s, "sample_id").join(state.select("outer", "label", "gene", "effect", "log_mut", "log_wt"), ["outer", "gene"])
    mut = F.col("mut") == 1
    g = j.groupBy("sample_id", "label").agg(
        F.sum(F.when(mut, F.col("effect"))).alias("s"), F.count(F.when(mut, 1)).alias("c"), F.max(F.when(mut, F.col("effect"))).alias("mx"),
        F.sum(F.when(mut, F.col("log_mut") - F.col("log_wt")).otherwise(-F.col("log_wt"))).alias("d"))
    grid = s.withColumn("b", base).select("sample_id", "outer", F.explode("b").alias("k", "base"))
    grid = grid.filter(F.col("k.outer") == F.col("outer")).select("sample_id", F.col("k.label").alias("label"), "base")
    z = grid.join(g, ["sample_id", "label"], "left").fillna(0)
    return z.select("sample_id", "label", F.col("s").alias("score_sum"), S.ratio(F.col("s"), F.col("c")).alias("score_mean"),
                    F.col("mx").alias("score_max"), (F.col("base") + F.col("d")).alias("bernoulli"))


def f5_oof(presence: DataFrame, missing: DataFrame, folds: DataFrame, k: int, **params) -> DataFrame:
    state = f5_stable(presence, missing, folds, k, outer=range(k), **params)
    return f5_score(presence, missing, folds, state, oof=True)


def rare_classes(samples: DataFrame, n: int) -> DataFrame:
    return samples.groupBy("label").agg(F.count("*").alias("n")).orderBy("n", "label").limit(n)


# --- burden-stratified pair contrasts ------------------------------------------
def pair_effect(presence: DataFrame, missing: DataFrame, samples: DataFrame, pair: tuple[str, str], alpha: float = 1.0, q: int = 5,
                parts: Sequence[tuple[int, int]] = ((FULL, FULL),)) -> DataFrame:
    """Burden-adjusted log odds of the pair's first against its second label, per gene.

    Burden strata are quantiles inside each training part. Cells are reduced to
    counts per (gene, burden, side, fold) before parts are formed, so a part
    only re-labels small counts.
    """
    s = samples.withColumn("fold", F.col("fold") if "fold" in samples.columns else F.lit(0))
    side = F.when(F.col("label") == pair[0], 0).when(F.col("label") == pair[1], 1)
    s = s.select("sample_id", "fold", side.alias("side")).filter("side is not null")
    b = presence.groupBy("sample_id").agg(F.count("*").alias("burden"))
    s = keep(s.join(b, "sample_id", "left").fillna(0, ["burden"]))
    cells = presence.select("sample_id", "gene", F.lit(0).alias("x")).unionByName(missing.select("sample_id", "gene", F.lit(1).alias("x")))
    c = settle(cells.join(s, "sample_id").groupBy("gene", "burden", "side", "fold").agg(
        F.count_if(F.col("x") == 0).alias("n"), F.count_if(F.col("x") == 1).alias("x")))
    hist = settle(s.groupBy("burden", "side", "fold").agg(F.count("*").alias("n")))

    def part(d):
        p = d.select("*", F.explode(leave_out(parts)).alias("part")).select("*", "part.outer", "part.inner").drop("part")
        return p.filter((F.col("fold") != F.col("outer")) & (F.col("fold") != F.col("inner")))

    h = part(hist)
    edges = S.quantiles(h, ["outer", "inner"], "burden", [i / q for i in range(1, q)], weight="n")
    edges = S.keyed_map(edges, F.struct("outer", "inner"), F.array(*[F.col(f"q{i}") for i in range(q - 1)]))

    def stratify(d):
        e = F.element_at(F.col("_e"), F.struct("outer", "inner"))
        return d.withColumn("_e", edges).withColumn("stratum", F.size(F.filter(e, lambda x: x < F.col("burden")))).drop("_e")

    sums = lambda v: [F.sum(F.when(F.col("side") == i, F.col(v)).otherwise(0)).alias(f"{v}{i}") for i in (0, 1)]
    size = settle(stratify(h).groupBy("outer", "inner", "stratum").agg(*sums("n")))
    sizes = S.keyed_map(size, F.struct("outer", "inner", "stratum"), F.struct("n0", "n1"))
    g = stratify(part(c)).groupBy("outer", "inner", "gene", "stratum").agg(*sums("n"), *sums("x"))
    g = g.groupBy("outer", "inner", "gene").agg(
        F.map_from_entries(F.collect_list(F.struct("stratum", F.struct("n0", "n1", "x0", "x1")))).alias("m"),
        *[F.sum(v).alias(f"{v}_all") for v in ("n0", "n1", "x0", "x1")])
    g = g.withColumn("sz", sizes)

    def logit(p):
        return F.ln(p) - F.log1p(-p)

    def rates(hit, total):
        v = lambda f: F.coalesce(hit[f], F.lit(0)).cast("double")
        obs = [total[f"n{i}"] - v(f"x{i}") for i in (0, 1)]
        return obs, [(v(f"n{i}") + alpha) / (obs[i] + 2 * alpha) for i in (0, 1)]

    def step(acc, st):
        total = F.element_at("sz", F.struct(F.col("outer"), F.col("inner"), st.alias("stratum")))
        obs, p = rates(F.element_at("m", st), total)
        ok = F.coalesce((total["n0"] > 0) & (total["n1"] > 0) & (obs[0] > 0) & (obs[1] > 0), F.lit(False))
        w = F.when(ok, F.try_divide(obs[0] * obs[1], obs[0] + obs[1])).otherwise(0.0)
        e = F.when(ok, logit(p[0]) - logit(p[1])).otherwise(0.0)
        return F.struct((acc["e"] + e * w).alias("e"), (acc["w"] + w).alias("w"))

    zero = F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("w"))
    g = g.withColumn("acc", F.aggregate(F.sequence(F.lit(0), F.lit(q - 1)), zero, step))
    allsz = S.keyed_map(size.groupBy("outer", "inner").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), F.struct("outer", "inner"), F.struct("n0", "n1"))
    tot = F.element_at(F.col("_t"), F.struct("outer", "inner"))
    p = [(F.col(f"n{i}_all") + alpha) / (tot[f"n{i}"] - F.col(f"x{i}_all") + 2 * alpha) for i in (0, 1)]
    effect = F.when(F.col("acc.w") > 0, F.col("acc.e") / F.col("acc.w")).otherwise(0.0)
    return g.withColumn("_t", allsz).select(
        "outer", "inner", "gene", effect.alias("effect"), (F.col("n0_all") + F.col("n1_all")).alias("support"),
        (logit(p[0]) - logit(p[1])).alias("log_odds"), (F.ln(p[0]) - F.ln(p[1])).alias("log_mut_ratio"),
        (F.log1p(-p[0]) - F.log1p(-p[1])).alias("log_wt_ratio"))


def _pair_rank(d: DataFrame, by: Sequence[str], top: int) -> DataFrame:
    d = d.filter("effect <> 0").withColumn("dir", F.signum("effect").cast("int"))
    order = W.partitionBy(*by, "dir").orderBy(F.desc(F.round(F.abs("effect"), 9)), "gene")
    return d.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def pair_select(presence: DataFrame, missing: DataFrame, folds: DataFrame, pair: tuple[str, str], k: int, top: int = 20,
                minimum: int = 5, alpha: float = 1.0, q: int = 5, min_direction: int = 4, min_frequency: int = 3,
                outer: Sequence[int] = (FULL,)) -> DataFrame:
    """Stable genes of a pair: the top of each direction with consistent sign over folds."""
    e = settle(pair_effect(presence, missing, folds, pair, alpha, q, _inner_parts(k, outer)))
    inner, full = e.filter(F.col("inner") != FULL), e.filter(F.col("inner") == FULL)
    key = ["outer", "gene"]
    hits = _pair_rank(inner.filter(F.col("support") >= minimum), ["outer", "inner"], top).groupBy(*key).agg(F.count("*").alias("frequency"))
    same = inner.select(*key, F.col("effect").alias("e1")).join(full.select(*key, "effect"), key)
    same = same.filter((F.signum("e1") == F.signum("effect")) & (F.signum("effect") != 0)).groupBy(*key).agg(F.count("*").alias("direction"))
    sel = full.filter(F.col("support") >= minimum).join(hits, key).join(same, key)
    n = F.when(F.col("outer") == FULL, F.lit(k)).otherwise(F.lit(k - 1))
    sel = sel.filter((F.col("direction") >= F.least(F.lit(min_direction), n)) & (F.col("frequency") >= F.least(F.lit(min_frequency), n)))
    return settle(_pair_rank(sel, ["outer"], top).drop("inner"))


def pair_score(presence: DataFrame, missing: DataFrame, samples: DataFrame, state: DataFrame, oof: bool = False) -> DataFrame:
    """Mean log odds over mutated selected genes and likelihood ratio per observed gene."""
    base = S.keyed_map(state.groupBy("outer").agg(F.sum("log_wt_ratio").alias("b"), F.count("*").alias("n")), F.col("outer"), F.struct("b", "n"))
    s = samples.select("sample_id", (F.col("fold") if oof else F.lit(FULL)).alias("outer"))
    cells = presence.select("sample_id", "gene", F.lit(1).alias("mut")).unionByName(missing.select("sample_id", "gene", F.lit(0).alias("mut")))
    j = cells.join(s, "sample_id").join(state.select("outer", "gene", "log_odds", "log_mut_ratio", "log_wt_ratio"), ["outer", "gene"])
    mut = F.col("mut") == 1
    g = j.groupBy("sample_id").agg(
        F.sum(F.when(mut, F.col("log_odds"))).alias("lo"), F.count(F.when(mut, 1)).alias("c"), F.count(F.when(~mut, 1)).alias("x"),
        F.sum(F.when(mut, F.col("log_mut_ratio") - F.col("log_wt_ratio")).otherwise(-F.col("log_wt_ratio"))).alias("d"))
    z = s.join(g, "sample_id", "left").fillna(0).withColumn("b", F.element_at(base, F.col("outer")))
    return z.select("sample_id", S.ratio(F.col("lo"), F.col("c")).alias("mutated_log_odds_mean"),
                    F.coalesce(S.ratio(F.col("b.b") + F.col("d"), F.col("b.n") - F.col("x")), F.lit(0.0)).alias("likelihood_ratio_mean"))


def pair_oof(presence: DataFrame, missing: DataFrame, folds: DataFrame, pair: tuple[str, str], k: int, **params) -> DataFrame:
    state = pair_select(presence, missing, folds, pair, k, outer=range(k), **params)
    return pair_score(presence, missing, folds, state, oof=True)


def discover_pairs(pred: DataFrame, top: int, exclude: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Most confused unordered label pairs: (c_ij + c_ji) / (n_i + n_j)."""
    sizes = S.keyed_map(pred.groupBy("y").agg(F.count("*").alias("n")), F.col("y"), F.col("n"))
    lo, hi = F.least("y", "yhat"), F.greatest("y", "yhat")
    c = pred.filter("y <> yhat").groupBy(lo.alias("left"), hi.alias("right")).agg(F.count("*").alias("errors"))
    for a, b in exclude:
        c = c.filter(~((F.col("left") == min(a, b)) & (F.col("right") == max(a, b))))
    n = F.coalesce(F.element_at("_n", F.col("left")), F.lit(0)) + F.coalesce(F.element_at("_n", F.col("right")), F.lit(0))
    c = c.withColumn("_n", sizes).withColumn("rate", F.col("errors") / n).drop("_n")
    return S.top_rows(c, top, F.desc(F.round("rate", 9)), F.desc("errors"), F.asc("left"), F.asc("right"))


# --- co-mutation and gene selection ------------------------------------------------
def comutation(presence: DataFrame, samples: DataFrame, minimum: int = 5, min_lift: float = 1.5, top: int = 96) -> DataFrame:
    """Gene pairs mutated together more often than independence predicts.

    A pair seen ``minimum`` times needs two genes seen as often, which bounds the
    candidates exactly; joint counts are a product of the sample-by-gene matrix
    summed per task, so no pairs are emitted per row.
    """
    sup = presence.groupBy("gene").agg(F.count("*").alias("n")).filter(F.col("n") >= minimum).withColumn("h", F.md5("gene"))
    idx = settle(S.hash_rank(sup, [], "h").select("gene", (F.col("rank") - 1).cast("int").alias("idx"), "n"))
    joint = gram(presence.join(idx, "gene").select("sample_id", "idx", F.lit(1.0).alias("value"))).filter("i < j")
    left = idx.select(F.col("idx").alias("i"), F.col("gene").alias("ga"), F.col("n").alias("na"))
    right = idx.select(F.col("idx").alias("j"), F.col("gene").alias("gb"), F.col("n").alias("nb"))
    n = S.total(samples, F.count("*"))
    lift = F.col("joint") / F.greatest(F.col("na").cast("double") * F.col("nb") / F.col("_n"), F.lit(1e-9))
    d = joint.withColumnRenamed("s", "joint").join(left, "i").join(right, "j").withColumn("_n", n).withColumn("lift", lift)
    d = d.filter((F.col("joint") >= minimum) & (F.round("lift", 9) >= min_lift))
    d = d.select(F.least("ga", "gb").alias("gene_a"), F.greatest("ga", "gb").alias("gene_b"), F.col("joint").cast("bigint"), "lift")
    return S.top_rows(d, top, F.desc(F.round("lift", 9)), F.desc("joint"), F.asc("gene_a"), F.asc("gene_b"))


def comutation_flags(presence: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sample, rank) of pairs with both genes mutated."""
    ends = pairs.select("rank", F.explode(F.array("gene_a", "gene_b")).alias("gene"))
    return (presence.join(ends, "gene").groupBy("sample_id", "rank").agg(F.count("*").alias("n"))
            .filter("n = 2").select("sample_id", "rank"))


def stable_genes(presence: DataFrame, folds: DataFrame, k: int, min_folds: int, **params) -> DataFrame:
    """Genes in some class's top list in at least ``min_folds`` training parts."""
    w = class_weights(presence, folds, parts=_oof_parts(k), **params)
    g = w.select("outer", "gene").distinct().groupBy("gene").agg(F.count("*").alias("n_folds"))
    return g.filter(F.col("n_folds") >= min_folds)


def gene_cap(presence: DataFrame, samples: DataFrame, n: int, top: int = 20) -> DataFrame:
    """At most n genes: class by class the top genes, then the most frequent ones."""
    w = class_weights(presence, samples, top=max(10, 3 * top), variant="rate")
    first = w.groupBy("gene").agg(F.min(F.struct("label", "rank")).alias("first"))
    sup = presence.groupBy("gene").agg(F.count("*").alias("support"))
    order = [F.col("first").isNull(), F.col("first.label"), F.col("first.rank"), F.desc("support"), F.asc("gene")]
    return S.top_rows(sup.join(first, "gene", "left"), n, *order).select("gene", "support", "rank")


def class_gene_union(presence: DataFrame, samples: DataFrame, top: int, **params) -> DataFrame:
    return class_weights(presence, samples, top=top, **params).select("gene").distinct()


def tune_support(presence: DataFrame, folds: DataFrame, k: int, candidates: Sequence[int], **params) -> DataFrame:
    """Rank minimum-support candidates by out-of-fold macro-F1 of the signature arg-max.

    All candidates and folds are one plan. Order: mean, lower deviation, larger minimum.
    """
    from tokenfold.operators import metrics as M

    c = class_gene_counts(presence, folds, _oof_parts(k))
    cand = F.explode(F.array(*[F.lit(m) for m in candidates]))
    c = c.select("*", cand.alias("candidate")).filter(F.col("t") >= F.col("candidate"))
    score = _odds_score(params.get("smoothing", 0.5), params.get("max_log2", 8.0), params.get("shrinkage", 10.0))
    w = top_per_class(c, score, params.get("top", 20), True, ("candidate", "outer", "label"))
    p = presence.join(folds.select("sample_id", F.col("fold").alias("outer")), "sample_id")
    z = p.join(w.select("candidate", "outer", "gene", "label", "w"), ["outer", "gene"])
    z = z.groupBy("candidate", "sample_id", "label").agg(F.sum("w").alias("w"))
    best = z.groupBy("candidate", "sample_id").agg(F.min_by("label", F.struct(-F.round("w", 9), F.col("label"))).alias("yhat"))
    first = S.total(folds, F.min("label"))
    every = folds.select(F.col("sample_id"), F.col("label").alias("y"), "fold", cand.alias("candidate"))
    pred = every.join(best, ["candidate", "sample_id"], "left").withColumn("_f", first)
    pred = pred.select("candidate", "fold", "y", F.coalesce("yhat", F.col("_f")).alias("yhat"))
    f1 = M.macro_f1(pred, ["candidate", "fold"])
    s = f1.groupBy("candidate").agg(F.avg("macro_f1").alias("mean_f1"), F.stddev_pop("macro_f1").alias("std_f1"))
    return S.top_rows(s, len(candidates), F.desc(F.round("mean_f1", 9)), F.round("std_f1", 9), F.desc("candidate"))
