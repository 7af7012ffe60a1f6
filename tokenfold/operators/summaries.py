"""Per-sample summaries of the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenfold.functions import cells as C
from tokenfold.functions import stats as S
from tokenfold.functions import vocabulary as V
from tokenfold.functions.stats import ratio
from tokenfold.session import keep


def _complete(samples: DataFrame, agg: DataFrame) -> DataFrame:
    """Left-join aggregates to all samples; a sample without events counts zero."""
    return samples.select("sample_id").join(agg, "sample_id", "left").fillna(0)


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _log1p(name: str) -> Column:
    return F.log1p(F.col(name).cast("double"))


def burden(events: DataFrame, samples: DataFrame, n_genes: int | Column | None = None) -> DataFrame:
    """Mutated genes per sample: total, log1p and rate over the gene universe."""
    genes = events.select("sample_id", "gene").distinct()
    if n_genes is None:
        n_genes = S.total(events, F.countDistinct("gene"))
    n = n_genes if isinstance(n_genes, Column) else F.lit(n_genes)
    out = _complete(samples, genes.groupBy("sample_id").agg(F.count("*").alias("burden")))
    return out.select("sample_id", "burden", _log1p("burden").alias("burden_log1p"),
                      (F.col("burden") / n).alias("burden_rate"))


def consequence_mix(severity: DataFrame, samples: DataFrame, levels=V.EM4_NAMES) -> DataFrame:
    """Counts and ratios of mutated genes per consequence level."""
    out = _complete(samples, severity.groupBy("sample_id").agg(
        F.count("*").alias("burden"), *[_n(F.col("severity") == i).alias(f"count_{x}") for i, x in enumerate(levels, 1)]))
    return out.select("*", *[ratio(F.col(f"count_{x}"), F.col("burden")).alias(f"ratio_{x}") for x in levels])


def severity_summary(severity: DataFrame, samples: DataFrame) -> DataFrame:
    names = ["synonymous", "missense", "indel", "truncating"]
    out = _complete(samples, severity.groupBy("sample_id").agg(
        F.count("*").alias("burden"), F.sum("severity").alias("severity_sum"), F.max("severity").alias("severity_max"),
        *[_n(F.col("severity") == i).alias(f"{x}_count") for i, x in enumerate(names, 1)]))
    return out.select("*", _log1p("burden").alias("burden_log1p"),
                      *[ratio(F.col(f"{x}_count"), F.col("burden")).alias(f"{x}_ratio") for x in names])


def _gene_rows(events: DataFrame) -> DataFrame:
    """(sample, gene) rows with event counts per 5-level consequence."""
    return events.groupBy("sample_id", "gene").agg(
        F.count("*").alias("n"), *[_n(F.col("conseq") == i).alias(f"c{i}") for i in range(1, 6)])


def token_summary(events: DataFrame, samples: DataFrame) -> DataFrame:
    """Log counts of genes and tokens, functional ratio, per-level log count and ratio."""
    g = _gene_rows(events)
    functional = F.col("n") - F.col("c1")
    t = _complete(samples, g.groupBy("sample_id").agg(
        F.count("*").alias("genes"), F.sum("n").alias("tokens"), F.sum(functional).alias("functional"),
        _n(functional > 0).alias("functional_genes"), _n(F.col("n") >= 2).alias("multi_genes"),
        *[F.sum(f"c{i}").alias(f"c{i}") for i in range(1, 6)]))
    logs = {"mutated_gene_count": "genes", "mutation_token_count": "tokens", "functional_mutation_count": "functional",
            "functional_gene_count": "functional_genes", "multi_variant_gene_count": "multi_genes"}
    return t.select(
        "sample_id", *[_log1p(c).alias(f"{k}_log1p") for k, c in logs.items()],
        ratio(F.col("functional"), F.col("tokens")).alias("functional_mutation_ratio"),
        *[_log1p(f"c{i}").alias(f"consequence_{x}_count_log1p") for i, x in enumerate(V.EM5_NAMES, 1)],
        *[ratio(F.col(f"c{i}"), F.col("tokens")).alias(f"consequence_{x}_ratio") for i, x in enumerate(V.EM5_NAMES, 1)])


def functional_ratio(events: DataFrame, samples: DataFrame) -> DataFrame:
    """Share of long cells or tokens that are functional by their text."""
    f = _complete(samples, events.groupBy("sample_id").agg(
        F.count("*").alias("n"), _n(C.functional_flag(F.col("token"))).alias("f")))
    return f.select("sample_id", "n", ratio(F.col("f"), F.col("n")).alias("functional_ratio"))


def _entropy(shares: list[Column]) -> Column:
    return -sum((F.when(s > 0, s * F.ln(s)).otherwise(0.0) for s in shares), F.lit(0.0))


def burden_clip(presence: DataFrame, samples: DataFrame, q: float = 0.99) -> Column:
    """max(1, exact quantile of mutated genes per sample) as a scalar."""
    b = _complete(samples, presence.groupBy("sample_id").agg(F.count("*").alias("n")))
    return F.greatest(F.lit(1.0), S.quantile_row(b, "n", [q])[0])


def f1_summary(events: DataFrame, missing: DataFrame, samples: DataFrame, clip: Column | float) -> DataFrame:
    """26 summary columns of the three-state dialect."""
    names = [x.lower() for x in V.JH_CLASSES]
    g = events.groupBy("sample_id", "gene").agg(
        F.count("*").alias("n"), *[_n(F.col("consequence") == x.upper()).alias(x) for x in names])
    e = g.groupBy("sample_id").agg(
        F.count("*").alias("genes"), F.sum("n").alias("events"), _n(F.col("n") >= 2).alias("multi"),
        *[F.sum(x).alias(x) for x in names])
    m = missing.groupBy("sample_id").agg(F.count("*").alias("missing"))
    t = samples.select("sample_id").join(e, "sample_id", "left").join(m, "sample_id", "left").fillna(0)
    c = {x: F.col(x).cast("double") for x in names}
    share = {x: ratio(F.col(x), F.col("events")) for x in names}
    non = c["missense"] + c["stop"] + c["frameshift"] + c["complex"]
    sf = c["stop"] + c["frameshift"]
    clip = clip if isinstance(clip, Column) else F.lit(float(clip))
    return t.select(
        "sample_id", F.col("genes").alias("mutated_gene_count"), _log1p("genes").alias("mutated_gene_count_log1p"),
        F.least(F.col("genes").cast("double"), clip).alias("mutated_gene_count_clipped"),
        F.col("events").alias("unique_event_count"), F.col("multi").alias("multi_hit_gene_count"),
        F.col("missing").alias("missing_gene_count"),
        ((F.col("genes") == 0) & (F.col("missing") == 0)).cast("int").alias("is_all_wt"),
        *[F.col(x).alias(f"{x}_event_count") for x in names], *[share[x].alias(f"{x}_event_ratio") for x in names],
        ((c["synonymous"] + 1) / (non + 1)).alias("synonymous_nonsynonymous_ratio"),
        sf.alias("stop_frameshift_event_count"), ratio(sf, F.col("events")).alias("stop_frameshift_event_ratio"),
        _entropy(list(share.values())).alias("consequence_entropy"),
        F.greatest(*share.values()).alias("dominant_consequence_fraction"))


def jh_f1(events: DataFrame, samples: DataFrame) -> DataFrame:
    """22 columns: log1p of counts and positions, class ratios, all-wild-type flag."""
    names = [x.lower() for x in V.JH_CLASSES]
    g = events.groupBy("sample_id", "gene").agg(
        F.count("*").alias("n"), F.sum("position").alias("ps"), F.count("position").alias("pn"),
        F.max("position").alias("pm"), *[_n(F.col("consequence") == x.upper()).alias(x) for x in names])
    e = g.groupBy("sample_id").agg(
        F.sum("n").alias("mutation_event_count"), F.count("*").alias("mutated_gene_count"),
        _n(F.col("n") > 1).alias("multi_hit_gene_count"), *[F.sum(x).alias(f"{x}_count") for x in names],
        F.try_divide(F.sum("ps"), F.sum("pn")).alias("position_mean"), F.max("pm").alias("position_max"))
    # the percentile buffer holds distinct positions, at most a protein's length
    median = events.groupBy("sample_id").agg(F.percentile("position", 0.5).alias("position_median"))
    t = samples.select("sample_id").join(e, "sample_id", "left").join(median, "sample_id", "left").fillna(0)
    t = t.withColumn("events_per_mutated_gene", ratio(F.col("mutation_event_count"), F.col("mutated_gene_count")))
    logs = ["mutation_event_count", "mutated_gene_count", "multi_hit_gene_count", *[f"{x}_count" for x in names],
            "position_mean", "position_median", "position_max", "events_per_mutated_gene"]
    return t.select(
        "sample_id", *[_log1p(x).alias(f"log1p_{x}") for x in logs],
        *[ratio(F.col(f"{x}_count"), F.col("mutation_event_count")).alias(f"{x}_ratio") for x in names],
        (F.col("mutation_event_count") == 0).cast("int").alias("is_all_wt"))


def compact_summary(events: DataFrame, samples: DataFrame) -> DataFrame:
    """Log burden, log functional and multi-variant genes, ratio per consequence."""
    g = _gene_rows(events)
    t = _complete(samples, g.groupBy("sample_id").agg(
        _n(F.col("n") > F.col("c1")).alias("functional_genes"), _n(F.col("n") >= 2).alias("multi_genes"),
        F.sum("n").alias("tokens"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(1, 6)]))
    return t.select(
        "sample_id", _log1p("tokens").alias("mutation_burden_log1p"),
        _log1p("functional_genes").alias("functional_gene_count_log1p"),
        _log1p("multi_genes").alias("multi_variant_gene_count_log1p"),
        *[ratio(F.col(f"c{i}"), F.col("tokens")).alias(f"consequence_{x}_ratio") for i, x in enumerate(V.EM5_NAMES, 1)])


def gene_diversity(events: DataFrame, samples: DataFrame, n_genes: int | Column) -> DataFrame:
    """Largest gene share, normalised gene entropy and share of the gene universe.

    Silent genes add ``0 * ln(eps)`` to the entropy, so only mutated genes are summed.
    """
    n = n_genes if isinstance(n_genes, Column) else F.lit(n_genes)
    g = events.groupBy("sample_id", "gene").agg(F.count("*").alias("n"))
    tot = g.groupBy("sample_id").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    a = g.join(tot, "sample_id").groupBy("sample_id").agg(
        F.max(p).alias("top"), F.sum(-p * F.ln(p + 1e-12)).alias("h"), F.count("*").alias("active"))
    t = _complete(samples, a)
    return t.select("sample_id", F.col("top").alias("concentration"),
                    (F.col("h") / F.ln(F.greatest("active", F.lit(2)).cast("double"))).alias("gene_entropy"),
                    (F.col("active") / F.greatest(n, F.lit(1))).alias("diversity_ratio"))


def f_counts(events: DataFrame, samples: DataFrame) -> DataFrame:
    """Mutated genes, events, log1p, events per kind, multi-hit genes, no-mutation flag."""
    g = events.groupBy("sample_id", "gene").agg(
        F.count("*").alias("n"), *[_n(F.col("kind") == k).alias(k) for k in V.F_KINDS])
    t = _complete(samples, g.groupBy("sample_id").agg(
        F.count("*").alias("mutated_gene_count"), F.sum("n").alias("mutation_event_count"),
        *[F.sum(k).alias(f"{k}_event_count") for k in V.F_KINDS], _n(F.col("n") > 1).alias("multi_hit_gene_count")))
    return t.select("*", _log1p("mutation_event_count").alias("mutation_burden_log1p"),
                    (F.col("mutation_event_count") == 0).cast("int").alias("no_mutation_sample"))


def token_complexity(events: DataFrame, samples: DataFrame) -> DataFrame:
    g = events.groupBy("sample_id", "gene").agg(F.count("*").alias("n"))
    t = _complete(samples, g.groupBy("sample_id").agg(
        F.sum("n").alias("token_event_count"), _n(F.col("n") > 1).alias("multi_hit_gene_count"),
        F.sum(F.col("n") - 1).alias("token_excess_count"), F.max("n").alias("max_gene_token_count"),
        F.count("*").alias("burden")))
    return t.withColumn("multi_hit_ratio", ratio(F.col("multi_hit_gene_count"), F.col("burden"))).drop("burden")


def _missing_count(missing: DataFrame) -> DataFrame:
    return missing.groupBy("sample_id").agg(F.count("*").alias("missing_gene_count"))


def jsj1_structural(events: DataFrame, missing: DataFrame, samples: DataFrame) -> DataFrame:
    g = events.groupBy("sample_id", "gene").agg(
        F.count("*").alias("n"), *[_n(F.col("event_type") == x).alias(x) for x in V.JSJ1_TYPES])
    a = g.groupBy("sample_id").agg(
        F.count("*").alias("mutated_gene_count"), F.sum("n").alias("event_count"),
        _n(F.col("n") > 1).alias("multi_event_gene_count"), *[F.sum(x).alias(f"type_{x}") for x in V.JSJ1_TYPES])
    return samples.select("sample_id").join(a, "sample_id", "left").join(
        _missing_count(missing), "sample_id", "left").fillna(0)


def jsj2_summary(events: DataFrame, missing: DataFrame, samples: DataFrame) -> DataFrame:
    """8 core columns, 8 event types and 5 position bins as count and ratio."""
    bins = V.POSITION_BINS["jsj"][1]
    g = events.groupBy("sample_id", "gene").agg(
        F.count("*").alias("n"), *[_n(F.col("event_type") == x).alias(f"type_{x}") for x in V.JSJ2_TYPES],
        *[_n(F.col("position_bin") == b).alias(f"position_{b}") for b in bins])
    parts = [f"type_{x}" for x in V.JSJ2_TYPES] + [f"position_{b}" for b in bins]
    a = g.groupBy("sample_id").agg(
        F.count("*").alias("mutated_gene_count"), F.sum("n").alias("total_event_count"),
        _n(F.col("n") > 1).alias("multi_event_gene_count"), *[F.sum(p).alias(p) for p in parts])
    t = samples.select("sample_id").join(a, "sample_id", "left").join(
        _missing_count(missing), "sample_id", "left").fillna(0)
    total = F.col("total_event_count")
    return t.select(
        "sample_id", "mutated_gene_count", "total_event_count", "multi_event_gene_count", "missing_gene_count",
        _log1p("mutated_gene_count").alias("log1p_mutated_gene_count"),
        _log1p("total_event_count").alias("log1p_total_event_count"),
        (F.col("mutated_gene_count") == 0).cast("int").alias("all_wt"),
        ratio(total, F.col("mutated_gene_count")).alias("events_per_mutated_gene"),
        *[F.col(p).alias(f"{p}_count") for p in parts], *[ratio(F.col(p), total).alias(f"{p}_ratio") for p in parts])


CODE_RANGES = [(1, 2), (2, 10), (10, 20), (20, 100), (100, 200), (200, 1000), (1000, 2000), (2000, 10000)]


def _digits(c: Column) -> list[Column]:
    return [F.floor(c / 1000), F.floor(c / 100) % 10, F.floor(c / 10) % 10, c % 10]


def jsj3_summary(codes: DataFrame, samples: DataFrame) -> DataFrame:
    c = F.col("code")
    bands = [("fs", 1000, 10000), ("stop", 100, 1000), ("missense", 10, 100), ("silent", 1, 10)]
    fs, stop, mis, sil = _digits(c)
    return _complete(samples, codes.groupBy("sample_id").agg(
        _n(c != 0).alias("mutated_gene_count"), F.sum(c).alias("mutation_code_sum"), F.max(c).alias("mutation_code_max"),
        *[_n((c >= lo) & (c < hi)).alias(f"{k}_gene_count") for k, lo, hi in bands],
        _n(fs + stop + mis + sil > 1).alias("multi_event_gene_count"),
        *[_n((c >= lo) & (c < hi)).alias(f"code_{lo}_{hi}") for lo, hi in CODE_RANGES]))


def aa_profile(events: DataFrame) -> DataFrame:
    """Counts of (kind, amino acid) and of the target of a missense event, long form."""
    runs = C.aa_runs_jsj(F.col("token"))
    aa = f"[{V.AMINO_ACIDS}]"
    first = F.substring(F.get(runs, F.lit(0)), 1, 1)
    last = F.substring(F.get(runs, F.size(runs) - 1), 1, 1)
    named = F.array_compact(F.array(
        F.when(first.rlike(aa), F.concat_ws("_", "kind", first)),
        F.when((F.col("kind") == "MISSENSE") & (F.size(runs) >= 2) & last.rlike(aa), F.concat(F.lit("TO_"), last))))
    return (events.select("sample_id", F.explode(named).alias("feature"))
            .groupBy("sample_id", "feature").agg(F.count("*").alias("n")))


def e1_summary(codes: DataFrame, samples: DataFrame, n_genes: int | Column) -> DataFrame:
    """Event totals, kind shares, kind entropy and multi-kind genes from cell codes."""
    n = n_genes if isinstance(n_genes, Column) else F.lit(n_genes)
    kinds = ["fs", "stop", "missense", "silent"]
    d = dict(zip(kinds, _digits(F.col("code"))))
    many = sum(((d[k] > 0).cast("int") for k in kinds), F.lit(0)) > 1
    t = _complete(samples, codes.filter("code > 0").groupBy("sample_id").agg(
        F.count("*").alias("genes"), *[F.sum(d[k]).cast("double").alias(k) for k in kinds], _n(many).alias("multi")))
    total = sum((F.col(k) for k in kinds), F.lit(0.0))
    t = t.withColumn("total", total)
    share = [ratio(F.col(k), F.col("total")) for k in kinds]
    return t.select(
        "sample_id", F.col("total").alias("total_event_count"), _log1p("total").alias("log1p_total_event_count"),
        _log1p("genes").alias("log1p_mutated_gene_count"), (F.col("genes") / n).alias("mutated_gene_ratio"),
        ratio(F.col("total"), F.col("genes")).alias("events_per_mutated_gene"),
        *[s.alias(f"{k}_event_ratio") for k, s in zip(kinds, share)],
        (-sum((s * F.ln(s + 1e-12) for s in share), F.lit(0.0))).alias("mutation_type_entropy"),
        F.greatest(*share).alias("dominant_type_ratio"),
        sum(((F.col(k) > 0).cast("int") for k in kinds), F.lit(0)).alias("active_mutation_type_count"),
        F.col("multi").alias("multi_type_gene_count"))


def substitutions(events: DataFrame) -> DataFrame:
    """(sample, transition, n) of true substitutions: no stop, no synonymous change."""
    t = F.col("transition")
    real = t.isNotNull() & ~t.endswith("*") & (F.substring(t, 1, 1) != F.substring(t, 3, 1))
    return events.filter(real).groupBy("sample_id", "transition").agg(F.count("*").alias("n"))


def aa_pairs_log(events: DataFrame) -> DataFrame:
    return substitutions(events).select("sample_id", "transition", _log1p("n").alias("value"))


def aa_pairs_state(events: DataFrame, minimum: int, top: int, normalize: bool = False) -> DataFrame:
    """Log pair counts of the ``top`` most supported pairs, optionally as row shares (of samples with an id)."""
    rows = keep(aa_pairs_log(events))
    state = rows.groupBy("transition").agg(F.count("*").alias("support")).filter(F.col("support") >= minimum)
    state = state.orderBy(F.desc("support"), "transition").limit(top)
    out = rows.join(state.select("transition"), "transition", "left_semi")
    if normalize:
        out = out.filter("sample_id is not null").withColumn("value", F.col("value") / F.sum("value").over(W.partitionBy("sample_id")))
    return out.select("sample_id", "transition", "value")


def aa_composition(events: DataFrame, samples: DataFrame) -> DataFrame:
    """20 from-shares, 20 to-shares, pair entropy over ln 380 and dominant pair share."""
    s = substitutions(events)
    left, right = F.substring("transition", 1, 1), F.substring("transition", 3, 1)
    cond = lambda side, a: F.sum(F.when(side == a, F.col("n")).otherwise(0))
    e = s.groupBy("sample_id").agg(
        F.sum("n").alias("t"), F.max("n").alias("top"), F.sum(F.col("n") * F.ln(F.col("n").cast("double"))).alias("nln"),
        *[cond(left, a).alias(f"f_{a}") for a in V.AMINO_ACIDS], *[cond(right, a).alias(f"t_{a}") for a in V.AMINO_ACIDS])
    t = _complete(samples, e)
    tot = F.col("t")
    # -sum(p ln p) with p = n/t equals ln t - sum(n ln n)/t
    h = F.when(tot > 0, F.ln(F.greatest(tot, F.lit(1)).cast("double")) - ratio(F.col("nln"), tot)).otherwise(0.0)
    return t.select(
        "sample_id", *[ratio(F.col(f"f_{a}"), tot).alias(f"from_{a}") for a in V.AMINO_ACIDS],
        *[ratio(F.col(f"t_{a}"), tot).alias(f"to_{a}") for a in V.AMINO_ACIDS],
        (h / F.ln(F.lit(380.0))).alias("pair_entropy"), ratio(F.col("top"), tot).alias("dominant_pair_share"))


def burden_bins(b: DataFrame, col: str = "burden") -> DataFrame:
    return b.withColumn("burden_bin", C.burden_bin(F.col(col)))


def burden_quantile(b: DataFrame, q: int = 5, col: str = "burden", edges: Column | None = None) -> DataFrame:
    """Stratum = number of inner quantile edges strictly below the value."""
    if edges is None:
        edges = S.quantile_row(b, col, [i / q for i in range(1, q)])
    below = F.size(F.filter(F.col("_edges"), lambda x: x < F.col(col)))
    return b.withColumn("_edges", edges).withColumn("stratum", below).drop("_edges")


def standardize_state(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row of train means and population deviations."""
    return df.agg(*[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}_std") for c in cols])


def standardize(df: DataFrame, state: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / std; a constant column keeps scale 1."""
    packed = state.select(F.struct(*[F.col(c) for c in state.columns]).alias("s")).scalar()
    d = df.withColumn("_s", packed)
    out = []
    for c in cols:
        std = F.col(f"_s.{c}_std")
        out.append(((F.col(c) - F.col(f"_s.{c}_mean")) / F.when(std == 0, 1.0).otherwise(std)).alias(c))
    return d.select("sample_id", *out)
