"""Grid, trial and rule searches over probability tables.

Grids are literal arrays exploded per row; every search counts confusion per
grid point with map-side combining and continues on the small counts. Learning
on all folds but one uses total minus fold.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenfold.functions import probs as P
from tokenfold.functions import stats as S
from tokenfold.operators import metrics as M
from tokenfold.operators.latent import NotConverged
from tokenfold.session import keep, settle

# Margin and alpha grid of pair rules, weight grid of mixes.
RULE_GRID = (0.025, 0.05, 0.075, 0.10, 0.15, 0.20, 0.30)
MIX_GRID = (0.0, *RULE_GRID)


def grid(**axes: Sequence) -> list[dict]:
    """All combinations of the axes in order, each with its index ``g``."""
    points = itertools.product(*axes.values())
    return [{"g": i, **dict(zip(axes, point))} for i, point in enumerate(points)]


def points(rows: Sequence[Mapping]) -> Column:
    """A literal grid as an exploded struct column."""
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows]))


def _scored(df: DataFrame, rows: Sequence[Mapping], yhat: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion (keys, g, y, yhat, n) of every grid point (struct ``x``)."""
    d = df.withColumn("x", points(rows)).select(*keys, F.col("x.g").alias("g"), "y", yhat.alias("yhat"))
    return d.groupBy(*keys, "g", "y", "yhat").agg(F.count("*").alias("n"))


def _grid_table(df: DataFrame, rows: Sequence[Mapping]) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))


def select_prior(proba: DataFrame, prior: Column, gammas: Sequence[float], temperatures: Sequence[float], min_gain: float = 0.0) -> DataFrame:
    """Rank (gamma, T) by macro-F1, ties to the smaller change; below the gain the identity is chosen."""
    rows = grid(gamma=[float(g) for g in gammas], temperature=[float(t) for t in temperatures])
    ident = {"g": -1, "gamma": 0.0, "temperature": 1.0}
    hat = P.argmax(P.adjust_prior(F.col("p"), F.col("_q"), F.col("x.gamma"), F.col("x.temperature")))
    conf = _scored(proba.withColumn("_q", prior), [ident, *rows], hat)
    f = M.macro_f1(conf, ["g"], counted=True).join(_grid_table(proba, [ident, *rows]), "g")
    base = S.total(f.filter("g = -1"), F.max("macro_f1"))
    order = W.orderBy(F.desc(F.round("macro_f1", 9)), F.abs("gamma"), F.abs(F.col("temperature") - 1))
    d = f.filter("g >= 0").withColumn("rank", F.row_number().over(order)).withColumn("base", base)
    return d.select("gamma", "temperature", "macro_f1", "rank",
                    ((F.col("rank") == 1) & (F.col("macro_f1") >= F.col("base") + min_gain)).cast("int").alias("selected"))


def fit_temperature(proba: DataFrame, temperatures: Sequence[float]) -> DataFrame:
    """Mean log-loss per temperature; rank 1 is the fit (ties: earlier candidate)."""
    rows = grid(temperature=[float(t) for t in temperatures])
    p = P.calibrate(F.col("p"), F.col("x.temperature"))
    d = proba.withColumn("x", points(rows)).withColumn("q", p)
    loss = d.groupBy("x").agg(F.avg(-F.ln(F.greatest(P.at(F.col("q"), F.col("y")), F.lit(1e-12)))).alias("logloss"))
    r = loss.select("x.*", "logloss").withColumn("rank", F.row_number().over(W.orderBy(F.round("logloss", 9), "g")))
    return r.select("temperature", "logloss", "rank")


def simplex_grid(names: Sequence, steps: int, bounds: Mapping) -> list[tuple[float, ...]]:
    """Weight vectors on a grid of 1/steps that sum to one inside the bounds."""
    out = []
    for combo in itertools.product(range(steps + 1), repeat=len(names) - 1):
        last = steps - sum(combo)
        w = [c / steps for c in (*combo, last)]
        if last >= 0 and all(bounds[n][0] - 1e-12 <= x <= bounds[n][1] + 1e-12 for n, x in zip(names, w)):
            out.append(tuple(w))
    return out


def fit_blend(models: DataFrame, bounds: Mapping, initial: Mapping, l2: float = 0.01, steps: int = 20) -> DataFrame:
    """Bounded log-blend weights by log-loss plus l2 * |w - initial|^2, scanned on a simplex grid."""
    names = list(bounds)
    rows = [{"g": i, **{f"w{j}": w for j, w in enumerate(ws)}} for i, ws in enumerate(simplex_grid(names, steps, bounds))]
    logs = [P.log_clip(F.element_at("m", F.lit(n))) for n in names]
    d = models.select("y", *[c.alias(f"l{j}") for j, c in enumerate(logs)], points(rows).alias("x"))
    score = P.weighted_sum([F.col(f"l{j}") for j in range(len(names))], [F.col(f"x.w{j}") for j in range(len(names))])
    d = d.withColumn("q", P.softmax(score))
    loss = d.groupBy("x").agg(F.avg(-F.ln(F.greatest(P.at(F.col("q"), F.col("y")), F.lit(1e-12)))).alias("logloss"))
    r = loss.select("x.*", "logloss")
    pen = sum(((F.col(f"w{j}") - float(initial[n])) ** 2 for j, n in enumerate(names)), F.lit(0.0))
    r = r.withColumn("objective", F.col("logloss") + l2 * pen)
    return r.withColumn("rank", F.row_number().over(W.orderBy(F.round("objective", 9), "g")))


def _bounded_step(gradient, hessian, low, high):
    """The move d that minimises g.d + d.H.d / 2 with sum(d) = 0 and low <= d <= high (zero is feasible).

    Primal active sets: move freely until a bound stops the move, hold that
    component, and release the one whose multiplier asks for it most.
    """
    import numpy as np

    m = len(gradient)
    d, held = np.zeros(m), high - low <= 0
    for _ in range(50 * m):
        slope = gradient + hessian @ d
        free = np.flatnonzero(~held)
        if not len(free):
            return d
        system = np.ones((len(free) + 1, len(free) + 1))
        system[:-1, :-1], system[-1, -1] = hessian[np.ix_(free, free)], 0.0
        *move, level = np.linalg.solve(system, [*-slope[free], 0.0])
        step = np.zeros(m)
        step[free] = move
        if np.abs(step).max() <= 1e-14:
            pull = slope + level
            gain = np.where(held & (high > low), np.where(d <= low, -pull, pull), 0.0)
            if gain.max() <= 1e-12:
                return d
            held[gain.argmax()] = False
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(step > 0, (high - d) / step, np.where(step < 0, (low - d) / step, np.inf))
        stop = int(room.argmin())
        if room[stop] >= 1:
            d = d + step
        else:
            d = d + max(room[stop], 0.0) * step
            d[stop] = high[stop] if step[stop] > 0 else low[stop]
            held[stop] = True
    return d


def newton_blend(models: DataFrame, bounds: Mapping, initial: Mapping, l2: float = 0.01, most_steps: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """Bounded log-blend weights that minimise log-loss plus l2 * |w - initial|^2, by projected Newton steps.

    ``models`` is (y, m) with m from model to probabilities. Weights sum to one
    inside their bounds. A step is one aggregate of loss, gradient and Hessian
    (1 + m + m (m + 1) / 2 sums, whatever the rows); a step that raises the
    objective is halved. Returns (model, weight, logloss, objective, steps).
    Rows without a model's probabilities take no part; an empty table keeps the
    starting weights with null loss. Raises ``NotConverged`` after ``most_steps``.
    """
    import numpy as np

    names = list(bounds)
    size = range(len(names))
    low, high = (np.array([float(bounds[n][i]) for n in names]) for i in (0, 1))
    if low.sum() > 1 + 1e-12 or high.sum() < 1 - 1e-12 or (low > high).any():
        raise ValueError("no weights sum to one inside the bounds")
    target = np.array([float(initial[n]) for n in names])
    w = np.clip(target, low, high)
    for _ in names:  # the rest goes to the components with room
        rest = 1 - w.sum()
        room = (high - w) if rest > 0 else (w - low)
        if abs(rest) <= 1e-15 or room.sum() <= 0:
            break
        w = w + rest * room / room.sum()
    logs = models.select("y", *[P.log_clip(F.element_at("m", F.lit(n))).alias(f"l{j}") for j, n in enumerate(names)])
    rows = keep(logs.dropna())

    def dot(q, x):
        return F.aggregate(F.zip_with(q, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def look(at):
        d = rows.withColumn("q", P.softmax(P.weighted_sum([F.col(f"l{j}") for j in size], [F.lit(float(at[j])) for j in size])))
        d = d.select("y", "q", *[F.col(f"l{j}") for j in size], *[dot(F.col("q"), F.col(f"l{j}")).alias(f"e{j}") for j in size])
        loss = F.avg(-F.ln(F.greatest(P.at(F.col("q"), F.col("y")), F.lit(1e-12)))).alias("loss")
        slopes = [F.avg(F.col(f"e{j}") - P.at(F.col(f"l{j}"), F.col("y"))).alias(f"g{j}") for j in size]
        pairs = [(i, j) for i in size for j in size if i <= j]
        spread = [F.avg(dot(F.col("q"), F.zip_with(f"l{i}", f"l{j}", lambda a, b: a * b)) - F.col(f"e{i}") * F.col(f"e{j}")).alias(f"h{i}_{j}") for i, j in pairs]
        r = d.agg(loss, *slopes, *spread).first()
        if r["loss"] is None:
            return None
        hessian = np.zeros((len(names), len(names)))
        for i, j in pairs:
            hessian[i, j] = hessian[j, i] = r[f"h{i}_{j}"]
        gradient = np.array([r[f"g{j}"] for j in size]) + 2 * l2 * (at - target)
        return r["loss"], r["loss"] + l2 * float(((at - target) ** 2).sum()), gradient, hessian + 2 * (l2 + 1e-12) * np.eye(len(names))

    here, steps = look(w), 0
    while here is not None:
        move = _bounded_step(here[2], here[3], low - w, high - w)
        if np.abs(move).max() <= tolerance:
            break
        while True:
            if steps == most_steps:
                rows.unpersist()
                raise NotConverged(f"{most_steps} steps leave a move of {np.abs(move).max():.1e}")
            steps += 1
            there = look(w + move)
            if there[1] <= here[1] + 1e-13:
                break
            move = move / 2
        w, here = np.clip(w + move, low, high), there
    rows.unpersist()
    loss, objective = (None, None) if here is None else (float(here[0]), float(here[1]))
    found = [(str(n), float(x), loss, objective, steps) for n, x in zip(names, w)]
    return models.sparkSession.createDataFrame(found, "model string, weight double, logloss double, objective double, steps int")


def crossfit_select(both: DataFrame, temperatures: Sequence[float], weights: Sequence[float], k: int, n_classes: int) -> DataFrame:
    """Per (seed, fold): the temperature and weight that do best on the other folds.

    ``both`` is (sample_id, seed, fold, y, p, q); q is calibrated and blended into p.
    Ties go to the smaller |ln T| + 0.01 w. Also reports the score on the held fold.
    """
    rows = grid(temperature=[float(t) for t in temperatures], weight=[float(w) for w in weights])
    # each temperature is applied once per row, then shared by all weights
    nw = len(weights)
    ts = F.posexplode(F.array(*[F.lit(float(t)) for t in temperatures])).alias("ti", "t")
    cal = both.select("seed", "fold", "y", "p", "q", ts).withColumn("q", P.calibrate(F.col("q"), F.col("t")))
    ws = F.posexplode(F.array(*[F.lit(float(w)) for w in weights])).alias("wi", "w")
    hits = cal.select("seed", "fold", "y", "p", "q", "ti", ws)
    hits = hits.select("seed", "fold", (F.col("ti") * nw + F.col("wi")).alias("g"), "y", P.argmax(P.mix(F.col("p"), F.col("q"), F.col("w"))).alias("yhat"))
    conf = settle(hits.groupBy("seed", "fold", "g", "y", "yhat").agg(F.count("*").alias("n")))
    held = F.explode(F.array(*[F.lit(i) for i in range(k)]))
    rest = conf.select("*", held.alias("held")).filter("held <> fold")
    rest = rest.groupBy("seed", "held", "g", "y", "yhat").agg(F.sum("n").alias("n"))
    tune = M.macro_f1(rest, ["seed", "held", "g"], n_classes, counted=True).withColumnRenamed("macro_f1", "tuning_macro_f1")
    ev = M.macro_f1(conf, ["seed", "fold", "g"], n_classes, counted=True).withColumnRenamed("macro_f1", "evaluation_macro_f1")
    d = tune.withColumnRenamed("held", "fold").join(_grid_table(both, rows), "g")
    pen = F.abs(F.ln("temperature")) + 0.01 * F.col("weight")
    order = W.partitionBy("seed", "fold").orderBy(F.desc(F.round("tuning_macro_f1", 9)), F.round(pen, 9), "g")
    best = d.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")
    return best.join(ev, ["seed", "fold", "g"]).select("seed", "fold", "temperature", "weight", "tuning_macro_f1", "evaluation_macro_f1")


def apply_selected(both: DataFrame, params: DataFrame) -> DataFrame:
    """Rebuild the blended probabilities from the stored parameters of each (seed, fold)."""
    j = both.join(params.select("seed", "fold", "temperature", "weight"), ["seed", "fold"])
    p = P.blend(F.col("p"), P.calibrate(F.col("q"), F.col("temperature")), F.col("weight"))
    return j.withColumn("p", p).drop("q", "temperature", "weight")


# --- trials and subsets --------------------------------------------------------------
def dirichlet_trials(names: Sequence, trials: int, seed: int) -> list[dict]:
    """Seeded random weight vectors, a parameter list of fixed size."""
    import numpy as np

    draws = np.random.default_rng(seed).dirichlet(np.ones(len(names)), size=trials)
    return [{"g": i, **{f"w{j}": float(x) for j, x in enumerate(w)}} for i, w in enumerate(draws)]


def trial_confusion(models: DataFrame, names: Sequence, trials: Sequence[Mapping], keys: Sequence[str] = ()) -> DataFrame:
    arrays = [F.element_at("m", F.lit(n)) for n in names]
    d = models.select(*keys, "y", *[a.alias(f"a{j}") for j, a in enumerate(arrays)])
    hat = P.argmax(P.weighted_sum([F.col(f"a{j}") for j in range(len(names))], [F.col(f"x.w{j}") for j in range(len(names))]))
    return _scored(d, trials, hat, keys)


def trial_search(models: DataFrame, names: Sequence, trials: Sequence[Mapping], n_classes: int) -> DataFrame:
    """Weight trials ranked by macro-F1 of the weighted vote, ties by trial id."""
    f = M.macro_f1(trial_confusion(models, names, trials), ["g"], n_classes, counted=True)
    j = f.join(_grid_table(models, trials), "g")
    return j.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("macro_f1", 9)), "g")))


def subset_trials(names: Sequence, subsets: Sequence[Sequence]) -> list[dict]:
    return [{"g": i, **{f"w{j}": (1.0 / len(s) if n in s else 0.0) for j, n in enumerate(names)}} for i, s in enumerate(subsets)]


def equal_blends(models: DataFrame, names: Sequence, sizes: Sequence[int], n_classes: int, subsets: Sequence[Sequence] | None = None) -> DataFrame:
    """Macro-F1 of equal-weight blends of all model subsets of the given sizes."""
    subsets = subsets or [s for n in sizes for s in itertools.combinations(names, n)]
    f = M.macro_f1(trial_confusion(models, names, subset_trials(names, subsets)), ["g"], n_classes, counted=True)
    label = [{"g": i, "models": "+".join(map(str, s)), "size": len(s)} for i, s in enumerate(subsets)]
    return f.join(_grid_table(models, label), "g").select("models", "size", "macro_f1")


def select_subset(scores: DataFrame, tolerance: float) -> DataFrame:
    """Rank subsets within the tolerance of the best by (size, score desc, name)."""
    best = S.total(scores, F.max("macro_f1"))
    d = scores.withColumn("_b", best).filter(F.round("macro_f1", 9) >= F.round(F.col("_b") - tolerance, 9)).drop("_b")
    return d.withColumn("rank", F.row_number().over(W.orderBy("size", F.desc(F.round("macro_f1", 9)), "models")))


def select_trial(scores: DataFrame, unit: str = "unit") -> DataFrame:
    """For each held unit the trial with the best mean score over all other units."""
    t = scores.groupBy("trial").agg(F.sum("macro_f1").alias("s"), F.count("*").alias("c"))
    d = scores.join(t, "trial").withColumn("selection", (F.col("s") - F.col("macro_f1")) / (F.col("c") - 1))
    order = W.partitionBy(unit).orderBy(F.desc(F.round("selection", 9)), "trial")
    return d.withColumn("r", F.row_number().over(order)).filter("r = 1").select(unit, "trial", "selection", "macro_f1")


HELD = -1  # inner fold of an outer part's held rows


def nested_cube(models: DataFrame, names: Sequence, trials: Sequence[Mapping], inner: DataFrame) -> DataFrame:
    """Confusion (outer, inner, g, y, yhat, n) of every trial in every inner fold of every outer part, counted once.

    ``models`` is (sample_id, fold, y, m), ``inner`` (sample_id, outer_fold,
    inner_fold) of the outer training parts. A row counts in the inner fold it
    has in each outer part and as held (``HELD``) in its own fold. Its choices
    are made once a trial and combined before the shuffle; every selection
    continues on these counts. Rows without inner folds count as held only.
    """
    place = F.struct(F.col("outer_fold").cast("int").alias("outer"), F.col("inner_fold").cast("int").alias("inner"))
    places = inner.groupBy("sample_id").agg(F.array_sort(F.collect_list(place)).alias("places"))
    own = F.array(F.struct(F.col("fold").cast("int").alias("outer"), F.lit(HELD).alias("inner")))
    d = models.join(places, "sample_id", "left").withColumn("places", F.concat(F.coalesce("places", F.filter(own, lambda x: F.lit(False))), own))
    arrays = [F.element_at("m", F.lit(n)) for n in names]
    d = d.select("places", "y", *[a.alias(f"a{j}") for j, a in enumerate(arrays)], points(trials).alias("x"))
    hat = P.argmax(P.weighted_sum([F.col(f"a{j}") for j in range(len(names))], [F.col(f"x.w{j}") for j in range(len(names))]))
    once = d.groupBy("places", F.col("x.g").alias("g"), "y", hat.alias("yhat")).agg(F.count("*").alias("n"))
    flat = once.select(F.explode("places").alias("s"), "g", "y", "yhat", "n").select("s.outer", "s.inner", "g", "y", "yhat", "n")
    return flat.groupBy("outer", "inner", "g", "y", "yhat").agg(F.sum("n").alias("n"))


def nested_select(cube: DataFrame, trials: Sequence[Mapping], n_classes: int) -> DataFrame:
    """(outer, rule, g, inner_mean, inner_se, held): the choices of every outer part and their held scores.

    Rule ``best`` takes the trial with the best mean over the part's inner folds;
    ``one_se`` the one with the fewest models whose mean is within the best
    one's standard error. Ties go to the better mean, then the smaller ``g``.
    Held rows only score. A part with one inner fold has standard error zero.
    """
    f = settle(M.macro_f1(cube, ["outer", "inner", "g"], n_classes, counted=True))
    held = f.filter(F.col("inner") == HELD).select("outer", "g", F.col("macro_f1").alias("held"))
    s = f.filter(F.col("inner") != HELD).groupBy("outer", "g").agg(
        F.avg("macro_f1").alias("inner_mean"), F.coalesce(F.stddev_samp("macro_f1") / F.sqrt(F.count("*").cast("double")), F.lit(0.0)).alias("inner_se"))
    sizes = [{"g": t["g"], "size": sum(1 for k, v in t.items() if k != "g" and v > 0)} for t in trials]
    s = s.join(_grid_table(cube, sizes), "g")
    part, mean = W.partitionBy("outer"), F.round("inner_mean", 9)
    s = s.withColumn("b", F.row_number().over(part.orderBy(F.desc(mean), "g")))
    floor = F.max(F.when(F.col("b") == 1, F.round(F.col("inner_mean") - F.col("inner_se"), 9))).over(part)
    s = s.withColumn("near", mean >= floor)
    s = s.withColumn("o", F.when(F.col("near"), F.row_number().over(part.orderBy(F.desc("near"), "size", F.desc(mean), "g"))))
    rules = F.filter(F.array(F.when(F.col("b") == 1, "best"), F.when(F.col("o") == 1, "one_se")), lambda r: r.isNotNull())
    return s.select("outer", "g", "inner_mean", "inner_se", F.explode(rules).alias("rule")).join(held, ["outer", "g"], "left").select(
        "outer", "rule", "g", "inner_mean", "inner_se", "held")


def role_subsets(roles: Mapping[str, str], size: int) -> list[tuple[str, ...]]:
    """Model subsets with at least one global, at most one anchor and at most two experts."""
    def ok(sub):
        kinds = [roles[m] for m in sub]
        return kinds.count("global") >= 1 and kinds.count("anchor") <= 1 and kinds.count("expert") <= 2

    return [s for s in itertools.combinations(sorted(roles), size) if ok(s)]


# --- class-wise thresholds ---------------------------------------------------------------
def _sides(rows: DataFrame, c: int, factors: Column, candidates: Sequence[float]) -> DataFrame:
    """(part, y, other, m, n): rows whose choice is ``c`` under exactly the m smallest candidate factors, else ``other``.

    A row leaves class ``c`` at one break point of its factor, where p_c / f meets
    the best of the other classes, so one count serves every candidate.
    """
    scores = F.zip_with("p", factors, lambda a, b: a / b)
    d = rows.select("part", "y", F.element_at("p", c + 1).alias("own"), F.transform(scores, lambda v, i: F.when(i == c, -1.0).otherwise(v)).alias("rest"))
    d = d.select("part", "y", "own", P.argmax(F.col("rest")).alias("other"), F.array_max("rest").alias("top"))
    wins = [F.when((v > F.col("top")) | ((v == F.col("top")) & (F.col("other") > c)), 1).otherwise(0)
            for v in (F.col("own") / float(f) for f in sorted(candidates))]
    return d.withColumn("m", sum(wins[1:], wins[0])).groupBy("part", "y", "other", "m").agg(F.count("*").alias("n"))


def _penalised_f1(conf, factors, shrinkage: float):
    """Macro-F1 over observed classes less the shrinkage of the factors, for a stack (candidates, y, yhat) of counts."""
    import numpy as np

    size = (conf.sum(axis=1) + conf.sum(axis=2)).astype(float)
    f = np.divide(2.0 * np.einsum("icc->ic", conf), size, out=np.zeros_like(size), where=size > 0)
    return f.sum(axis=1) / np.maximum((size > 0).sum(axis=1), 1) - shrinkage * (np.log(factors) ** 2).mean(axis=1)


def class_thresholds(proba: DataFrame, n_classes: int, candidates: Sequence[float], k: int, rounds: int = 2,
                     min_support: int = 1, shrinkage: float = 0.01, min_gain: float = 0.0) -> DataFrame:
    """Class factors by coordinate search, per training part and for all rows.

    ``proba`` is (sample_id, fold, y, p). A step over one class is one shuffle of
    break-point counts for all parts; the driver sees at most parts x classes^2 x
    (candidates + 1) numbers and reads the confusion of every candidate off their
    running sums. A candidate must beat the present factor's score at nine
    decimals, or equal it with a factor nearer to one; among equals the first
    given one wins. ``accepted`` tells whether the cross-fitted factors reach the
    unadjusted score plus ``min_gain``.
    """
    import numpy as np

    clipped = F.transform("p", lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0)))
    d = keep(proba.select(F.col("fold").cast("int").alias("fold"), "y", clipped.alias("p")))
    parts = [*range(k), -1]
    rows = d.select("fold", "y", "p", F.explode(F.array(*map(F.lit, parts))).alias("part")).filter("part <> fold")
    start = np.zeros((len(parts), 1, n_classes, n_classes), np.int64)
    for r in rows.groupBy("part", "y", P.argmax(F.col("p")).alias("yhat")).agg(F.count("*").alias("n")).collect():
        start[parts.index(r["part"]), 0, r["y"], r["yhat"]] = r["n"]
    factors = np.ones((len(parts), n_classes))
    best = [float(_penalised_f1(start[i], factors[i:i + 1], shrinkage)[0]) for i in range(len(parts))]
    ascending = sorted(candidates)
    for _ in range(rounds):
        before = factors.copy()
        for c in range(n_classes):
            table = F.create_map(*[v for i, p in enumerate(parts) for v in (F.lit(p), P.lit_array(factors[i].tolist()))])
            conf = np.zeros((len(parts), len(ascending), n_classes, n_classes), np.int64)
            for r in _sides(rows, c, F.element_at(table, F.col("part")), ascending).collect():
                part = conf[parts.index(r["part"])]
                part[:r["m"], r["y"], c] += r["n"]
                part[r["m"]:, r["y"], r["other"]] += r["n"]
            for i in range(len(parts)):
                if start[i, 0, c].sum() < min_support:
                    continue
                trial = np.repeat(factors[i:i + 1], len(ascending), axis=0)
                trial[:, c] = ascending
                score = dict(zip(ascending, _penalised_f1(conf[i], trial, shrinkage).tolist()))
                rank = lambda f, s: (round(s, 9), -abs(math.log(f)))
                top = max(candidates, key=lambda f: rank(f, score[f]))
                if rank(top, score[top]) > rank(factors[i, c], best[i]):
                    factors[i, c], best[i] = top, score[top]
        if (factors == before).all():
            break
    own = F.element_at(F.create_map(*[v for i in range(k) for v in (F.lit(i), P.lit_array(factors[i].tolist()))]), F.col("fold"))
    scored = d.select("y", P.argmax(F.col("p")).alias("base"), P.argmax(F.zip_with("p", own, lambda a, b: a / b)).alias("cand"))
    v = {r["which"]: r["macro_f1"] for r in M.macro_f1(M.stack_models(scored), ["which"]).collect()}
    d.unpersist()
    accepted = int(v["cand"] >= v["base"] + min_gain)
    found = [(p, c, float(factors[i, c]), v["base"], v["cand"], accepted) for i, p in enumerate(parts) for c in range(n_classes)]
    return proba.sparkSession.createDataFrame(found, "part int, class_id int, factor double, base_f1 double, crossfit_f1 double, accepted int")


# --- rules on the two best classes ----------------------------------------------------------
def _slices(groups: bool) -> Column:
    """Slices a row counts in: all rows, its fold, its groups and its groups within its fold."""
    own = [F.struct(F.lit("all").alias("kind"), F.lit("").alias("grp"), F.lit(-1).alias("fold")),
           F.struct(F.lit("fold").alias("kind"), F.lit("").alias("grp"), F.col("fold").cast("int").alias("fold"))]
    if not groups:
        return F.array(*own)
    inside = F.transform("groups", lambda g: F.struct(F.lit("group").alias("kind"), g.alias("grp"), F.lit(-1).alias("fold")))
    both = F.transform("groups", lambda g: F.struct(F.lit("group_fold").alias("kind"), g.alias("grp"), F.col("fold").cast("int").alias("fold")))
    return F.concat(F.array(*own), inside, both)


SLICE = ["kind", "grp", "fold"]


def _base_counts(rows: DataFrame, groups: bool) -> DataFrame:
    """Class counts (slice, c, tp, n_true, n_pred, f1) of the first choice."""
    c = rows.groupBy(*(["groups"] if groups else []), "fold", "y", F.col("top1").alias("yhat")).agg(F.count("*").alias("n"))
    c = c.select(F.explode(_slices(groups)).alias("s"), "y", "yhat", "n").select("s.*", "y", "yhat", "n")
    c = c.groupBy(*SLICE, "y", "yhat").agg(F.sum("n").alias("n"))
    return M.class_f1(c, SLICE, counted=True)


def top_rows(proba: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(sample_id, fold, y, top1, top2, gap, ps, pt[, groups]) of packed probabilities."""
    d = proba.withColumn("t", P.top_two(F.col("p")))
    d = d.select("sample_id", "fold", "y", "t.top1", "t.top2", "t.gap", P.at(F.col("p"), F.col("t.top2")).alias("ps"),
                 P.at(F.col("p"), F.col("t.top1")).alias("pt"))
    if groups is None:
        return d
    g = groups.groupBy("sample_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "dimension", F.col("grp").cast("string")))).alias("groups"))
    return d.join(g, "sample_id")


def _moves(rows: DataFrame, values: Sequence[float], groups: bool) -> DataFrame:
    """Rows a rule (source=top2, target=top1, margin, alpha) moves, per slice.

    m: moved rows, ms: moved rows of the source class, mt: of the target class,
    h: sum of the moved ids' hashes, equal for rules that move the same rows.
    """
    opts = points(grid(margin=[float(v) for v in values], alpha=[float(v) for v in values]))
    d = rows.select("*", opts.alias("x")).filter(F.col("gap") <= F.col("x.margin") + 1e-12)
    ps, pt = F.col("ps") + F.col("x.alpha") * F.col("pt"), F.col("pt") - F.col("x.alpha") * F.col("pt")
    d = d.filter((ps > pt) | ((F.col("top2") < F.col("top1")) & (ps == pt)))
    key = [F.col("top2").alias("source"), F.col("top1").alias("target"), F.col("x.margin").alias("margin"), F.col("x.alpha").alias("alpha")]
    g = d.groupBy(*(["groups"] if groups else []), "fold", *key).agg(
        F.count("*").alias("m"), F.count_if(F.col("y") == F.col("top2")).alias("ms"), F.count_if(F.col("y") == F.col("top1")).alias("mt"),
        F.sum(F.xxhash64("sample_id").cast("decimal(38,0)")).alias("h"))
    g = g.select(F.explode(_slices(groups)).alias("s"), "source", "target", "margin", "alpha", "m", "ms", "mt", "h")
    return g.groupBy("s", "source", "target", "margin", "alpha").agg(
        *[F.sum(v).alias(v) for v in ("m", "ms", "mt", "h")]).select("s.*", "source", "target", "margin", "alpha", "m", "ms", "mt", "h")


def _moved_f1(moves: DataFrame, base: DataFrame) -> DataFrame:
    """Adds base and new F1 of source and target (s0, s1, t0, t1) per move row.

    A moved row leaves the target's predictions and joins the source's.
    """
    c = lambda n: base.select(*SLICE, F.col("c").alias(n), *[F.col(v).alias(f"{n}_{v}") for v in ("tp", "n_true", "n_pred", "f1")])
    j = moves.join(c("source"), [*SLICE, "source"], "left").join(c("target"), [*SLICE, "target"], "left").fillna(0)
    s1 = M.f1(F.col("source_tp") + F.col("ms"), F.col("source_n_true"), F.col("source_n_pred") + F.col("m"))
    t1 = M.f1(F.col("target_tp") - F.col("mt"), F.col("target_n_true"), F.col("target_n_pred") - F.col("m"))
    return j.withColumn("s0", F.col("source_f1")).withColumn("t0", F.col("target_f1")).withColumn("s1", s1).withColumn("t1", t1)


def rule_evidence(proba: DataFrame, n_classes: int, values: Sequence[float] = RULE_GRID, min_errors: int = 3) -> DataFrame:
    """Evidence per (source, target, margin, alpha) rule over all rows and folds."""
    rows = keep(top_rows(proba))
    err = rows.filter("y <> top1").groupBy(F.col("y").alias("source"), F.col("top1").alias("target")).agg(F.count("*").alias("support"))
    err = err.filter(F.col("support") >= min_errors)
    base = settle(_base_counts(rows, False))
    mv = _moved_f1(settle(_moves(rows, values, False)).join(err, ["source", "target"]), base)
    mv = mv.withColumn("d", (F.col("s1") - F.col("s0") + F.col("t1") - F.col("t0")) / n_classes).withColumn("net", F.col("ms") - F.col("mt"))
    rule = ["source", "target", "margin", "alpha"]
    score0 = S.total(base.filter("kind = 'all'"), F.sum("f1") / n_classes)
    isall, isf = F.col("kind") == "all", F.col("kind") == "fold"
    one = lambda c: F.max(F.when(isall, F.col(c)))
    r = mv.groupBy(*rule, "support").agg(
        one("ms").alias("rescue"), one("mt").alias("harm"), one("net").alias("net_rescue"), one("d").alias("gain"),
        one("s1").alias("_s1"), one("s0").alias("_s0"), one("t1").alias("_t1"), one("t0").alias("_t0"),
        F.count_if(isf & (F.col("net") > 0)).alias("positive_folds"), F.count_if(isf & (F.col("d") < -M.TOL)).alias("declining_folds"))
    drop = F.least(F.col("_s1") - F.col("_s0"), F.col("_t1") - F.col("_t0"))
    return r.withColumn("macro_f1", F.col("gain") + score0).withColumn("worst_class_delta", drop).drop("_s1", "_s0", "_t1", "_t0")


def select_pair_rule(proba: DataFrame, n_classes: int, values: Sequence[float] = RULE_GRID, ranking: str = "primary",
                     exclude: tuple[int, int] | None = None) -> DataFrame:
    """Qualified pair-bias rules in rank order (none: keep the probabilities)."""
    r = rule_evidence(proba, n_classes, values)
    ok = (F.col("rescue") >= 3) & (F.col("net_rescue") > 0) & (F.col("positive_folds") >= 2) & (F.col("gain") >= -M.TOL) & (
        F.col("declining_folds") <= 1) & (F.col("worst_class_delta") >= -M.TOL)
    if exclude is not None:
        ok = ok & ~((F.col("source") == exclude[0]) & (F.col("target") == exclude[1]))
    lead = [F.desc(F.round("macro_f1", 9)), F.desc("net_rescue")]
    order = W.orderBy(*(lead if ranking == "primary" else lead[::-1]), F.desc("rescue"), "harm", "alpha", "margin", "source", "target")
    return r.filter(ok).withColumn("rank", F.row_number().over(order))


def select_bidirectional_rule(proba: DataFrame, groups: DataFrame, n_classes: int, pair: tuple[int, int], k: int,
                              values: Sequence[float] = RULE_GRID, min_group: int = 4, min_folds: int = 2) -> DataFrame:
    """Two-way pair rules with class, outside-pair and group safety, in rank order.

    The forward and the reverse rule touch disjoint rows, so their counts are
    taken separately and combined per grid point. Of grid points that move the
    same rows only the first is kept.
    """
    source, target = pair
    rows = top_rows(proba, groups)
    rows = keep(rows)
    base = settle(_base_counts(rows, True))
    inside = ((F.col("top1") == target) & (F.col("top2") == source)) | ((F.col("top1") == source) & (F.col("top2") == target))
    mv = settle(_moves(rows.filter(inside), values, True))
    pts = _grid_table(proba, grid(pm=[float(v) for v in values], pa=[float(v) for v in values], rm=[float(v) for v in values], ra=[float(v) for v in values]))
    cells = base.select(*SLICE).distinct()
    cell = F.struct(*SLICE)
    per = lambda fwd: S.keyed_map(
        mv.filter((F.col("source") == (source if fwd else target))), F.struct(cell.alias("s"), "margin", "alpha"), F.struct("m", "ms", "mt", "h"))
    allcells = S.total(cells, F.collect_list(cell))
    e = pts.withColumn("f", per(True)).withColumn("r", per(False)).select("g", "pm", "pa", "rm", "ra", "f", "r", F.explode(allcells).alias("s"))
    hit = lambda m, a, b: F.element_at(m, F.struct(F.col("s").alias("s"), F.col(a).alias("margin"), F.col(b).alias("alpha")))
    e = e.withColumn("fh", hit("f", "pm", "pa")).withColumn("rh", hit("r", "rm", "ra"))
    z = lambda h, v: F.coalesce(F.col(f"{h}.{v}"), F.lit(0))
    e = e.select("g", "pm", "pa", "rm", "ra", "s.*", z("fh", "m").alias("fm"), z("fh", "ms").alias("fs"), z("fh", "mt").alias("ft"),
                 z("rh", "m").alias("rm_"), z("rh", "ms").alias("rs"), z("rh", "mt").alias("rt"),
                 F.concat_ws(":", z("fh", "h").cast("string"), z("rh", "h").cast("string")).alias("h"))
    c = lambda n, v: base.filter(F.col("c") == v).select(*SLICE, *[F.col(x).alias(f"{n}_{x}") for x in ("tp", "n_true", "n_pred", "f1")])
    tot = base.groupBy(*SLICE).agg((F.sum("f1") / n_classes).alias("macro0"), F.sum("n_true").alias("support"))
    e = e.join(c("a", source), SLICE, "left").join(c("b", target), SLICE, "left").join(tot, SLICE).fillna(0)
    # forward moves predictions target -> source, reverse source -> target
    shift = F.col("fm") - F.col("rm_")
    a1 = M.f1(F.col("a_tp") + F.col("fs") - F.col("rt"), F.col("a_n_true"), F.col("a_n_pred") + shift)
    b1 = M.f1(F.col("b_tp") - F.col("ft") + F.col("rs"), F.col("b_n_true"), F.col("b_n_pred") - shift)
    e = e.withColumn("da", a1 - F.col("a_f1")).withColumn("db", b1 - F.col("b_f1")).withColumn("d", (F.col("da") + F.col("db")) / n_classes)
    e = settle(e.withColumn("rescue", F.col("fs") + F.col("rs")).withColumn("harm", F.col("ft") + F.col("rt")))
    isall, isf = F.col("kind") == "all", F.col("kind") == "fold"
    one = lambda col: F.max(F.when(isall, col if isinstance(col, Column) else F.col(col)))
    se = lambda col: F.stddev_samp(F.when(isf, F.col(col))) / math.sqrt(k)
    gk = ["g", "pm", "pa", "rm", "ra"]
    r = e.groupBy(*gk).agg(
        one("rescue").alias("rescue"), one("harm").alias("harm"), one("d").alias("gain"), one("macro0").alias("base_f1"),
        one("da").alias("da"), one("db").alias("db"), one(F.col("a_f1")).alias("a0"), one(F.col("b_f1")).alias("b0"),
        one(F.try_divide(F.col("a_tp") + F.col("fs") - F.col("rt"), F.col("a_n_true"))).alias("recall1"),
        one(F.try_divide(F.col("a_tp"), F.col("a_n_true"))).alias("recall0"),
        F.count_if(isf & (F.col("rescue") > F.col("harm"))).alias("positive_folds"), se("macro0").alias("base_se"), se("d").alias("delta_se"),
        se("a_f1").alias("a_se"), se("b_f1").alias("b_se"), se("da").alias("da_se"), se("db").alias("db_se"),
        F.collect_list(F.when(isf, F.struct("d", "da", "db"))).alias("fd"), one("h").alias("sig"))
    below = lambda f, lim: F.size(F.filter("fd", lambda x: x[f] < lim - M.TOL))
    r = r.withColumn("material", below("d", -F.col("delta_se"))).withColumn("a_dec", below("da", -F.col("da_se"))).withColumn("b_dec", below("db", -F.col("db_se")))
    gs = e.filter(F.col("kind").isin("group", "group_fold"))
    gf = gs.filter("kind = 'group_fold'").groupBy("g", "grp").agg(
        F.count("*").alias("folds"), (F.stddev_samp("d") / F.sqrt(F.count("*").cast("double"))).alias("gse"), F.collect_list("d").alias("ds"))
    go = gs.filter("kind = 'group'").select("g", "grp", F.col("d").alias("gd"), "support")
    ge = go.join(gf, ["g", "grp"]).filter((F.col("support") >= min_group) & (F.col("folds") >= min_folds))
    ge = ge.withColumn("dec", F.size(F.filter("ds", lambda x: x < -F.col("gse") - M.TOL)))
    dims = F.size(F.collect_set(F.substring_index("grp", ":", 1)))
    ge = ge.groupBy("g").agg(F.min(F.col("gd") + F.col("gse")).alias("group_margin"), F.max("dec").alias("group_dec"), dims.alias("dims"))
    n_dims = S.total(groups, F.countDistinct("dimension"))
    r = r.join(ge, "g", "left").withColumn("n_dims", n_dims)
    class_margin = F.least(F.col("da") + F.col("a_se"), F.col("db") + F.col("b_se"))
    r = r.withColumn("class_margin", class_margin).withColumn("net_rescue", F.col("rescue") - F.col("harm"))
    pair_gain, recall_gain = (F.col("da") + F.col("db")) / 2, F.coalesce(F.col("recall1") - F.col("recall0"), F.lit(0.0))
    ok = (F.col("rescue") >= 3) & (F.col("net_rescue") > 0) & (F.col("positive_folds") >= 2) & (F.col("gain") >= -F.col("base_se") - M.TOL) & (
        F.col("material") <= 1) & (F.col("class_margin") >= -M.TOL) & (F.col("a_dec") < 2) & (F.col("b_dec") < 2) & (
        (pair_gain >= 0.05 - M.TOL) | (recall_gain >= 0.05 - M.TOL)) & (F.col("group_dec") < 2) & (F.col("dims") == F.col("n_dims")) & (
        F.col("group_margin") >= -M.TOL)
    first = W.partitionBy("sig").orderBy("g")
    r = r.withColumn("seen", F.row_number().over(first)).filter((F.col("seen") == 1) & ok)
    r = r.withColumn("macro_f1", F.col("base_f1") + F.col("gain")).withColumn("pair_f1", (F.col("a0") + F.col("b0")) / 2 + pair_gain)
    order = W.orderBy(*[F.desc(F.round(x, 9)) for x in ("class_margin", "group_margin", "macro_f1", "pair_f1", "recall1")],
                      F.desc("net_rescue"), F.desc("rescue"), "harm", "pa", "ra", "pm", "rm")
    return r.withColumn("rank", F.row_number().over(order)).select(
        "pm", "pa", "rm", "ra", "macro_f1", "pair_f1", "rescue", "harm", "net_rescue", "positive_folds", "class_margin", "group_margin", "rank")


def select_mix_weight(both: DataFrame, n_classes: int, k: int, weights: Sequence[float] = MIX_GRID, groups: DataFrame | None = None,
                      min_group: int = 4, min_folds: int = 2) -> DataFrame:
    """Mix weights of a robust model with one-SE, class and group safety, eligible ones ranked.

    ``both`` is (sample_id, fold, y, p, q): (1-w) p + w q.
    """
    rows = grid(weight=[float(w) for w in weights])
    hat = P.argmax(P.mix(F.col("p"), F.col("q"), F.col("x.weight")))
    d = both
    if groups is not None:
        g = groups.groupBy("sample_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "dimension", F.col("grp").cast("string")))).alias("groups"))
        d = d.join(g, "sample_id")
    c = _scored(d, rows, hat, ["fold", *(["groups"] if groups is not None else [])])
    c = c.select(F.explode(_slices(groups is not None)).alias("s"), "g", "y", "yhat", "n").select("s.*", "g", "y", "yhat", "n")
    c = c.groupBy(*SLICE, "g", "y", "yhat").agg(F.sum("n").alias("n"))
    f = settle(M.class_f1(c, [*SLICE, "g"], counted=True))
    macro = f.groupBy(*SLICE, "g").agg((F.sum("f1") / n_classes).alias("m"), F.sum("n_true").alias("support"))
    base = macro.filter("g = 0").select(*SLICE, F.col("m").alias("m0"))
    macro = macro.join(base, SLICE)
    fold = macro.filter("kind = 'fold'").groupBy("g").agg(F.avg("m").alias("mean_f1"), F.stddev_samp("m").alias("std_f1"), F.min("m").alias("min_f1"))
    b0 = f.filter("g = 0 and kind = 'fold'").select("fold", "c", F.col("f1").alias("f0"))
    fc = f.filter("kind = 'fold'").select("g", "fold", "c", "f1").join(b0, ["fold", "c"], "full")
    dec = fc.filter("g is not null").groupBy("g", "c").agg(F.count_if(F.col("f1") < F.coalesce("f0", F.lit(0.0)) - M.TOL).alias("n"))
    dec = dec.groupBy("g").agg(F.max("n").alias("class_declines"))
    r = fold.join(dec, "g").join(_grid_table(both, rows), "g")
    best = S.total(r, F.max_by(F.struct("mean_f1", "std_f1"), F.struct(F.round("mean_f1", 9), -F.round("std_f1", 9), -F.col("weight"))))
    r = r.withColumn("_b", best).withColumn("one_se", (F.col("mean_f1") >= F.col("_b.mean_f1") - F.col("_b.std_f1") / math.sqrt(k) - M.TOL).cast("int")).drop("_b")
    ok = (F.col("weight") > 0) & (F.col("one_se") == 1) & (F.col("class_declines") < 2)
    if groups is not None:
        gf = macro.filter("kind = 'group_fold'").withColumn("d", F.col("m") - F.col("m0")).groupBy("g", "grp").agg(
            F.count("*").alias("folds"), (F.stddev_samp("d") / F.sqrt(F.count("*").cast("double"))).alias("gse"), F.collect_list("d").alias("ds"))
        ge = macro.filter("kind = 'group'").select("g", "grp", "m", "m0", "support").join(gf, ["g", "grp"])
        ge = ge.filter((F.col("support") >= min_group) & (F.col("folds") >= min_folds))
        ge = ge.withColumn("dec", F.size(F.filter("ds", lambda x: x < -F.col("gse") - M.TOL)))
        ge = ge.groupBy("g").agg(F.min("m").alias("floor"), (F.min("m") - F.min("m0")).alias("floor_delta"),
                                 F.min(F.col("m") - F.col("m0") + F.col("gse")).alias("group_margin"), F.max("dec").alias("group_declines"))
        r = r.join(ge, "g", "left")
        ok = ok & (F.col("group_declines") < 2) & (F.col("group_margin") >= -M.TOL) & (F.col("floor_delta") > M.TOL)
    else:
        r = r.withColumn("floor", F.lit(0.0))
    r = r.withColumn("eligible", F.coalesce(ok, F.lit(False)).cast("int"))
    order = W.orderBy(F.desc("eligible"), *[F.desc(F.round(x, 9)) for x in ("floor", "min_f1", "mean_f1")], F.round("std_f1", 9), "weight")
    return r.withColumn("rank", F.row_number().over(order)).select("weight", "mean_f1", "std_f1", "min_f1", "class_declines", "one_se", "floor", "eligible", "rank")


def select_gate(base: DataFrame, experts: DataFrame, n_classes: int, pairs: Sequence[tuple[int, int]], temperatures: Sequence[float],
                margins: Sequence[float], confidences: Sequence[float], weights: Sequence[float], expert_ids: Sequence,
                min_errors: int = 3, min_rescues: int = 3) -> DataFrame:
    """Gated expert blends with positive net rescue, ranked by macro-F1.

    ``base`` is (sample_id, y, p), ``experts`` (sample_id, model, p). Only rows
    whose two best classes form a searched pair can change, so only they meet the
    grid; a variant's score is the base confusion plus its changes.
    """
    full = grid(expert=list(expert_ids), temperature=[float(t) for t in temperatures], pair=list(pairs), margin=[float(m) for m in margins],
                confidence=[float(c) for c in confidences], weight=[float(w) for w in weights])
    rows = [{"g": r["g"], "expert": r["expert"], "temperature": r["temperature"], "source": r["pair"][0], "target": r["pair"][1],
             "margin": r["margin"], "confidence": r["confidence"], "weight": r["weight"]} for r in full]
    d = keep(base.withColumn("t", P.top_two(F.col("p"))).select("sample_id", "y", "p", "t.*"))
    conf = d.groupBy("y", F.col("top1").alias("yhat")).agg(F.count("*").alias("n"))
    table = _grid_table(base, rows)
    near = d.join(experts.select("sample_id", F.col("model").alias("expert"), F.col("p").alias("q")), "sample_id")
    hit = near.join(table.withColumnRenamed("source", "top2").withColumnRenamed("target", "top1"), ["expert", "top1", "top2"])
    hit = hit.filter(F.col("gap") <= F.col("margin")).withColumn("q", P.calibrate(F.col("q"), F.col("temperature")))
    hit = hit.filter(F.array_max("q") >= F.col("confidence")).withColumn("new", P.argmax(P.mix(F.col("p"), F.col("q"), F.col("weight"))))
    ch = hit.filter("new <> top1").groupBy("g", "y", "top1", "new").agg(F.count("*").alias("n"))
    ch = settle(ch)
    delta = ch.select("g", F.explode(F.array(
        F.struct(F.col("top1").alias("c"), F.when(F.col("y") == F.col("top1"), -F.col("n")).otherwise(0).alias("dtp"), (-F.col("n")).alias("dp")),
        F.struct(F.col("new").alias("c"), F.when(F.col("y") == F.col("new"), F.col("n")).otherwise(0).alias("dtp"), F.col("n").alias("dp")))).alias("x"))
    delta = delta.groupBy("g", "x.c").agg(F.sum("x.dtp").alias("dtp"), F.sum("x.dp").alias("dp"))
    bc = M.class_f1(conf, counted=True)
    j = delta.join(bc, "c", "left").fillna(0)
    new = M.f1(F.col("tp") + F.col("dtp"), F.col("n_true"), F.col("n_pred") + F.col("dp"))
    gain = j.groupBy("g").agg((F.sum(new - F.col("f1")) / n_classes).alias("gain"))
    score0 = S.total(bc, F.sum("f1") / n_classes)
    ev = ch.join(table.select("g", "source", "target"), "g").groupBy("g").agg(
        F.sum(F.when((F.col("y") == F.col("source")) & (F.col("top1") == F.col("target")) & (F.col("new") == F.col("y")), F.col("n")).otherwise(0)).alias("rescue"),
        F.sum(F.when(F.col("y") == F.col("top1"), F.col("n")).otherwise(0)).alias("harm"))
    err = conf.filter("y <> yhat").select(F.col("y").alias("source"), F.col("yhat").alias("target"), F.col("n").alias("errors"))
    r = ev.join(gain, "g").join(table, "g").join(err, ["source", "target"]).withColumn("_s", score0)
    r = r.withColumn("net_rescue", F.col("rescue") - F.col("harm")).withColumn("macro_f1", F.col("_s") + F.col("gain")).drop("_s", "gain")
    r = r.filter((F.col("errors") >= min_errors) & (F.col("rescue") >= min_rescues) & (F.col("net_rescue") > 0))
    return r.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("macro_f1", 9)), "g")))


def select_lanes(models: DataFrame, names: Sequence, trials: Sequence[Mapping], groups: DataFrame, n_classes: int, anchor,
                 tolerance: float = 0.0, max_collapse: int = 1) -> DataFrame:
    """Primary (best macro-F1) and robust (best worst-group floor with the anchor) trial.

    ``models`` rows are (sample_id, fold, y, m). The robust trial differs from the
    primary and may fall below the primary's worst group in few folds only.
    """
    g = groups.groupBy("sample_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "dimension", F.col("grp").cast("string")))).alias("groups"))
    c = trial_confusion(models.join(g, "sample_id"), names, trials, ["fold", "groups"])
    c = c.select(F.explode(_slices(True)).alias("s"), "g", "y", "yhat", "n").select("s.*", "g", "y", "yhat", "n")
    c = c.groupBy(*SLICE, "g", "y", "yhat").agg(F.sum("n").alias("n"))
    m = settle(M.macro_f1(c, [*SLICE, "g"], n_classes, counted=True))
    score = m.filter("kind = 'all'").select("g", "macro_f1")
    floor = m.filter("kind = 'group'").groupBy("g").agg(F.min("macro_f1").alias("floor"))
    ff = m.filter("kind = 'group_fold'").groupBy("g", "fold").agg(F.min("macro_f1").alias("ff"))
    prim = S.total(score, F.min_by("g", F.struct(-F.round("macro_f1", 9), F.col("g"))))
    pf = ff.withColumn("_p", prim).filter(F.col("g") == F.col("_p")).select("fold", F.col("ff").alias("pf"))
    col = ff.join(pf, "fold").groupBy("g").agg(F.count_if(F.col("ff") - F.col("pf") < -tolerance - M.TOL).alias("collapse_folds"))
    has = _grid_table(models, trials).select("g", (F.col(f"w{list(names).index(anchor)}") > 0).cast("int").alias("anchored"))
    r = score.join(floor, "g").join(col, "g").join(has, "g").withColumn("_p", prim)
    primary = r.filter(F.col("g") == F.col("_p")).withColumn("role", F.lit("primary"))
    pool = r.filter((F.col("g") != F.col("_p")) & (F.col("anchored") == 1) & (F.col("collapse_folds") <= max_collapse))
    order = W.orderBy(F.desc(F.round("floor", 9)), F.desc(F.round("macro_f1", 9)), "g")
    robust = pool.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r").withColumn("role", F.lit("robustness"))
    return primary.unionByName(robust).select("role", F.col("g").alias("trial"), "macro_f1", "floor", "collapse_folds")


def consensus_pair(rules: DataFrame) -> DataFrame:
    """The unordered pair with the largest total net rescue, oriented the same way.

    ``rules`` is (source, target, net_rescue), one row per selected gate.
    """
    lo, hi = F.least("source", "target"), F.greatest("source", "target")
    u = rules.groupBy(lo.alias("a"), hi.alias("b")).agg(F.sum("net_rescue").alias("net"), F.count("*").alias("cnt"))
    o = rules.groupBy("source", "target").agg(F.sum("net_rescue").alias("onet"), F.count("*").alias("ocnt"))
    j = o.join(u, (F.least("source", "target") == F.col("a")) & (F.greatest("source", "target") == F.col("b")))
    order = W.orderBy(F.desc("net"), F.desc("cnt"), "a", "b", F.desc("onet"), F.desc("ocnt"), "source", "target")
    return j.withColumn("r", F.row_number().over(order)).filter("r = 1").select("source", "target", F.col("net").alias("total_net_rescue"), F.col("cnt").alias("n"))
