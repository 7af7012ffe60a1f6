"""Row patterns, event profiles and their label statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenfold.functions import cells as C
from tokenfold.functions import stats as S
from tokenfold.session import keep

EMPTY = "ALL_WT"


def _digest(rows: DataFrame, parts: list[str], samples: DataFrame, name: str) -> DataFrame:
    key = rows.groupBy("sample_id").agg(*S.set_digest(*[F.col(p) for p in parts])).select("sample_id", S.digest_key().alias(name))
    return samples.join(key, "sample_id", "left").fillna(EMPTY, [name])


def pattern_key(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples with the same normalised non-wild-type cells share a key (null is wild type)."""
    c = cells.select("sample_id", "gene", C.norm_cell(F.col("cell")).alias("cell")).filter("cell <> 'WT'")
    return _digest(c, ["gene", "cell"], samples, "key")


def profile_group(events: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples with the same set of (gene, token) share a profile; no events is ALL_WT."""
    return _digest(events, ["gene", "token"], samples, "profile")


def pattern_support(keys: DataFrame) -> DataFrame:
    """log1p of the key's sample count and whether it was seen at least twice."""
    n = keys.groupBy("key").agg(F.count("*").alias("n"))
    return keys.join(n, "key").select("sample_id", "key", F.log1p(F.col("n").cast("double")).alias("support_log1p"),
                                      (F.col("n") >= 2).cast("int").alias("seen_multiple"))


def _uncertainty(counts: Column, n_classes: Column) -> list[Column]:
    """log1p n, entropy over ln C, largest share and conflict of label counts."""
    n = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    h = F.aggregate(counts, F.lit(0.0), lambda a, x: a - (x / n) * F.ln(x / n))
    classes = F.greatest(n_classes, F.lit(2)).cast("double")
    return [F.log1p(n.cast("double")).alias("support_log1p"), (h / F.ln(classes)).alias("entropy"),
            (F.array_max(counts) / n).alias("max_probability"), (F.size(counts) > 1).cast("int").alias("conflict")]


def pattern_uncertainty(keys: DataFrame) -> DataFrame:
    """Label uncertainty of each key over all its samples."""
    c = S.total(keys, F.countDistinct("label"))
    by = keys.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.collect_list("n").alias("ns"))
    return by.withColumn("_c", c).select("key", *_uncertainty(F.col("ns"), F.col("_c")))


FULL = -1  # held fold of counts over all rows


def uncertainty_state(keys: DataFrame, folds: DataFrame) -> DataFrame:
    """(key, fold, measures) without each fold that has the key, and over all rows (fold -1).

    Counts per (key, label, fold) are taken once; what a fold may see is the
    total minus its own part. A key holds at most classes x folds numbers.
    """
    c = S.total(keys, F.countDistinct("label"))
    per = keys.join(folds.select("sample_id", "fold"), "sample_id").groupBy("key", "label", "fold").agg(F.count("*").alias("n"))
    per = per.groupBy("key", "label").agg(F.sum("n").alias("tot"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("held"))
    per = per.groupBy("key").agg(F.collect_list(F.struct("tot", "held")).alias("ls"))
    own = F.array_distinct(F.flatten(F.transform("ls", lambda s: F.map_keys(s["held"]))))
    per = per.select("key", "ls", F.explode(F.concat(own, F.array(F.lit(FULL)))).alias("fold"))
    rest = F.filter(F.transform("ls", lambda s: s["tot"] - F.coalesce(F.element_at(s["held"], F.col("fold")), F.lit(0))), lambda n: n > 0)
    seen = per.select("key", "fold", rest.alias("ns")).filter(F.size("ns") > 0).withColumn("_c", c)
    return seen.select("key", "fold", *_uncertainty(F.col("ns"), F.col("_c")))


def uncertainty_score(keys: DataFrame, samples: DataFrame, state: DataFrame) -> DataFrame:
    """(sample_id, fold, measures) of samples with a fold (-1: not among the learnt rows); unseen keys score zero."""
    j = keys.select("sample_id", "key").join(samples.select("sample_id", "fold"), "sample_id")
    return j.join(state, ["key", "fold"], "left").fillna(0).drop("key")


def pattern_uncertainty_oof(keys: DataFrame, folds: DataFrame) -> DataFrame:
    """Label uncertainty of each sample's key without the sample's own fold; a key unseen elsewhere scores zero."""
    return uncertainty_score(keys, folds, uncertainty_state(keys, folds))


def pattern_posterior(keys: DataFrame, alpha: float = 1.0, minimum: int = 2) -> DataFrame:
    """(key, label, posterior) of keys with enough samples: (count + alpha prior) / (n + alpha)."""
    n_all = S.total(keys, F.count("*"))
    prior = S.keyed_map(keys.groupBy("label").agg(F.count("*").alias("n")), F.col("label"), F.col("n"))
    by = keys.groupBy("key", "label").agg(F.count("*").alias("c"))
    by = by.groupBy("key").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("m"))
    by = by.filter(F.col("n") >= minimum).select("key", "n", "m", F.explode(prior).alias("label", "_p")).withColumn("_n", n_all)
    count = F.coalesce(F.element_at("m", F.col("label")), F.lit(0))
    return by.select("key", "label", "n", ((count + alpha * F.col("_p") / F.col("_n")) / (F.col("n") + alpha)).alias("posterior"))


def posterior_blend(proba: DataFrame, keys: DataFrame, posterior: DataFrame, weight: float) -> DataFrame:
    """(1-w) p + w posterior for samples whose key is known, p otherwise."""
    j = proba.join(keys.select("sample_id", "key"), "sample_id").join(
        posterior.select("key", "label", "posterior"), ["key", "label"], "left")
    mixed = F.when(F.col("posterior").isNull(), F.col("p")).otherwise((1 - weight) * F.col("p") + weight * F.col("posterior"))
    return j.select("sample_id", "label", mixed.alias("p"))


def pattern_summary(keys: DataFrame, minimum: int = 2) -> DataFrame:
    """Matched groups, conflicting groups and matched samples in one row."""
    by = keys.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("labels"))
    m = by.filter(F.col("n") >= minimum)
    return m.agg(F.count("*").alias("matched_groups"), F.count_if(F.col("labels") > 1).alias("conflicting_groups"),
                 F.coalesce(F.sum("n"), F.lit(0)).alias("matched_samples"))


def novelty(events: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """Per sample: unseen-token share as validation row, singleton share per training part.

    ``valid`` belongs to the sample's own fold. ``train_<i>`` is the share of
    tokens seen at most once in the training part that leaves fold i out (null
    in the sample's own fold).
    """
    j = events.select("sample_id", "gene", "token").join(folds.select("sample_id", "fold"), "sample_id")
    per = j.groupBy("gene", "token", "fold").agg(F.count("*").alias("n"))
    per = per.groupBy("gene", "token").agg(F.sum("n").alias("tot"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("held"))
    rest = lambda f: F.col("tot") - F.coalesce(F.element_at("held", f), F.lit(0))
    # only tokens that some part sees at most once can count in a share; a sample's events are counted without them
    rare = keep(per.filter((F.col("tot") - F.array_max(F.map_values("held")) <= 1) & F.col("gene").isNotNull() & F.col("token").isNotNull()))
    rare.count()  # its size is known when the join is planned
    t = j.join(rare, ["gene", "token"])
    flag = lambda hit: F.sum(hit.cast("int"))
    hits = t.groupBy("sample_id", "fold").agg(flag(rest(F.col("fold")) == 0).alias("valid"), *[flag(rest(F.lit(i)) <= 1).alias(f"train_{i}") for i in range(k)])
    g = j.filter("gene is not null and token is not null").groupBy("sample_id", "fold").agg(F.count("*").alias("n")).join(hits, ["sample_id", "fold"], "left")
    part = lambda c: F.coalesce(c, F.lit(0)) / F.col("n")
    g = g.select("sample_id", "fold", part("valid").alias("valid"), *[F.when(F.col("fold") != i, part(f"train_{i}")).alias(f"train_{i}") for i in range(k)])
    empty = [F.when(F.col("fold") == i, F.lit(None)).otherwise(F.coalesce(f"train_{i}", F.lit(0.0))).alias(f"train_{i}") for i in range(k)]
    return folds.select("sample_id", "fold").join(g.drop("fold"), "sample_id", "left").select(
        "sample_id", "fold", F.coalesce("valid", F.lit(0.0)).alias("valid"), *empty)
