"""Deterministic fold construction from hashed ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenfold.functions import cells as C
from tokenfold.functions import stats as S


def id_hash(seed: int | Column, col: str = "sample_id") -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat(F.col(col).cast("string"), F.lit("|"), seed.cast("string")))


def effective_k(samples: DataFrame, k: int, stratum: str = "label") -> Column:
    """min(k, size of the smallest stratum)."""
    sizes = samples.groupBy(stratum).agg(F.count("*").alias("n"))
    return F.least(F.lit(k), S.total(sizes, F.min("n")))


def stratified_folds(samples: DataFrame, k: int, seed: int, stratum: str = "label") -> DataFrame:
    """Stratified k-fold: rank by hashed id inside each stratum, modulo k."""
    ranked = S.hash_rank(samples.withColumn("_h", id_hash(seed)), [stratum], "_h")
    fold = ((F.col("rank") - 1) % effective_k(samples, k, stratum)).cast("int")
    return ranked.select(*samples.columns, F.lit(seed).alias("seed"), fold.alias("fold"))


def group_folds(samples: DataFrame, groups: DataFrame, k: int, seed: int, group: str = "profile", stratum: str = "label") -> DataFrame:
    """Stratified folds that never split a group.

    One row per group carries the stratum of most of its samples and its size;
    groups are dealt out by size, then hash, inside their stratum.
    """
    j = samples.join(groups.select("sample_id", group), "sample_id")
    n = j.groupBy(group, stratum).agg(F.count("*").alias("n"))
    one = n.groupBy(group).agg(
        F.min_by(stratum, F.struct(-F.col("n"), F.col(stratum))).alias("_s"), F.sum("n").alias("_size"))
    ranked = S.hash_rank(one.withColumn("_h", id_hash(seed, group)), ["_s"], "_h", lead=[-F.col("_size")])
    fold = ranked.select(group, ((F.col("rank") - 1) % k).cast("int").alias("fold"))
    return j.join(fold, group).select("sample_id", stratum, group, F.lit(seed).alias("seed"), "fold")


#: Group types that are dealt out together; more types go in blocks by hash, each balanced on its own.
TYPES_PER_BLOCK = 1 << 16


def balanced_group_folds(samples: DataFrame, groups: DataFrame, k: int, seed: int, group: str = "profile", label: str = "label") -> DataFrame:
    """Folds that never split a group and keep every class's share of rows near equal over the folds.

    Groups with the same label counts are of one type. Of a type's n groups each
    fold gets floor(n / k), which changes no balance. The rest go one by one, types
    with the most uneven counts first, to the fold where the mean over classes of
    the spread (standard deviation over folds) of the class's shares ends lowest
    at nine decimals; ties to the fold with fewer rows, then the lower one. Which
    groups of a type go where follows their hash. A null label is a class of its
    own; samples without a group are dropped, as in :func:`group_folds`.
    """
    import pandas as pd

    j = samples.join(groups.select("sample_id", group), "sample_id")
    n = j.groupBy(group, label).agg(F.count("*").alias("n"))
    hist = F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "n")))
    one = n.groupBy(group).agg(F.to_json(hist).alias("_type"), hist.alias("_hist"))
    types = one.groupBy("_type").agg(F.first("_hist").alias("_hist"), F.count("*").alias("_n"))
    names = {r[label]: i for i, r in enumerate(sorted(n.select(label).distinct().collect(), key=lambda r: (r[label] is not None, r[label])))}
    sizes = n.groupBy(label).agg(F.sum("n").alias("n"))
    total = {names[r[label]]: r["n"] for r in sizes.collect()}
    blocks = max(1, -(-types.count() // TYPES_PER_BLOCK))

    def deal(key, pdf):
        import numpy as np

        counts = np.zeros((len(pdf), len(names)))
        for i, h in enumerate(pdf["_hist"]):
            for e in h:
                counts[i, names[e["label"]]] = e["n"]
        order = sorted(range(len(pdf)), key=lambda i: (-round(float(counts[i].std()), 9), pdf["_type"].iloc[i]))
        held, size = np.zeros((k, len(names))), np.array([total[c] for c in range(len(names))], float)
        extras = [None] * len(pdf)
        for i in order:
            extras[i] = []
            for _ in range(int(pdf["_n"].iloc[i]) % k):
                spread = []
                for f in range(k):
                    held[f] += counts[i]
                    spread.append((round(float((held / size).std(axis=0).mean()), 9), held[f].sum(), f))
                    held[f] -= counts[i]
                f = min(spread)[2]
                held[f] += counts[i]
                extras[i].append(f)
        return pd.DataFrame({"_type": pdf["_type"], "_even": pdf["_n"] // k * k, "_extras": extras})

    dealt = types.withColumn("_block", F.pmod(F.xxhash64("_type"), F.lit(blocks))).groupBy("_block").applyInPandas(
        deal, "_type string, _even bigint, _extras array<int>")
    ranked = S.hash_rank(one.select(group, "_type").withColumn("_h", id_hash(seed, group)), ["_type"], "_h").join(dealt, "_type")
    extra = F.try_element_at("_extras", F.greatest(F.col("rank") - F.col("_even"), F.lit(1)).cast("int"))
    fold = F.when(F.col("rank") <= F.col("_even"), (F.col("rank") - 1) % k).otherwise(extra)
    return j.join(ranked.select(group, fold.cast("int").alias("fold")), group).select("sample_id", label, group, F.lit(seed).alias("seed"), "fold")


def class_gap(folds: DataFrame, k: int, label: str = "label") -> DataFrame:
    """Per class: rows, and the largest minus the smallest share of them that one of the ``k`` folds holds."""
    per = folds.groupBy(label, "fold").agg(F.count("*").alias("n"))
    low = F.when(F.count("*") < k, F.lit(0)).otherwise(F.min("n"))
    return per.groupBy(label).agg(F.sum("n").alias("n"), ((F.max("n") - low) / F.sum("n")).alias("gap"))


def holdout(samples: DataFrame, fraction: float, seed: int, stratum: str = "label") -> DataFrame:
    """Mark the first ``fraction`` of every stratum in hash order as held out."""
    ranked = S.hash_rank(samples.withColumn("_h", id_hash(seed)), [stratum], "_h")
    sizes = S.keyed_map(samples.groupBy(stratum).agg(F.count("*").alias("n")), F.col(stratum), F.col("n"))
    held = F.col("rank") <= F.lit(fraction) * F.col("_n")
    return (ranked.withColumn("_n", F.element_at(sizes, F.col(stratum)))
            .select(*samples.columns, held.cast("int").alias("held")))


def strata(samples: DataFrame, burden: DataFrame, k: int) -> DataFrame:
    """Class and burden strata; every class with a stratum below k falls back to the class."""
    combined = F.concat(F.lit("CLASS="), F.col("label"), F.lit("|BURDEN="), F.col("burden_bin"))
    d = samples.join(burden.select("sample_id", "burden"), "sample_id").withColumn("burden_bin", C.burden_bin(F.col("burden")))
    d = d.withColumn("combined", combined)
    n = d.groupBy("label", "combined").agg(F.count("*").alias("n")).groupBy("label").agg(F.min("n").alias("n"))
    smallest = S.keyed_map(n, F.col("label"), F.col("n"))
    stratum = F.when(F.element_at(F.col("_m"), F.col("label")) < k, F.concat(F.lit("CLASS_ONLY="), F.col("label")))
    return d.withColumn("_m", smallest).select("sample_id", "label", "burden_bin", stratum.otherwise(F.col("combined")).alias("stratum"))


def fold_audit(folds: DataFrame, groups: DataFrame, group: str = "profile") -> DataFrame:
    """Per fold: train and valid rows and groups, and groups on both sides."""
    j = folds.select("sample_id", "fold").join(groups.select("sample_id", group), "sample_id")
    per = j.groupBy(group, "fold").agg(F.count("*").alias("n"))
    nf = per.groupBy(group).agg(F.count("*").alias("nf"))
    by = per.join(nf, group).groupBy("fold").agg(
        F.sum("n").alias("valid_size"), F.count("*").alias("valid_groups"),
        F.count(F.when(F.col("nf") > 1, 1)).alias("group_overlap"))
    rows, n_groups = S.total(folds, F.count("*")), S.total(nf, F.count("*"))
    return by.select(
        "fold", (rows - F.col("valid_size")).alias("train_size"), "valid_size",
        (n_groups - F.col("valid_groups") + F.col("group_overlap")).alias("train_groups"), "valid_groups", "group_overlap")


def nested_folds(folds: DataFrame, k_outer: int, k_inner: int, seed: int) -> DataFrame:
    """Inner folds of every outer training part; each part has a seed of its own."""
    outer = F.explode(F.array(*[F.lit(o) for o in range(k_outer)]))
    d = folds.select("sample_id", "label", "fold", outer.alias("outer_fold")).filter("fold <> outer_fold")
    inner_seed = (F.lit(seed) * 1009 + F.col("outer_fold") * 9173) % (2**31 - 1)
    ranked = S.hash_rank(d.withColumn("_h", id_hash(inner_seed)), ["outer_fold", "label"], "_h")
    return ranked.select("sample_id", "label", "outer_fold", ((F.col("rank") - 1) % k_inner).cast("int").alias("inner_fold"))


def holdout_across_seeds(folds: DataFrame, seed: int, fold: int) -> DataFrame:
    """Role of every (sample, seed) row for one held (seed, fold) cell.

    Samples of the held cell are held in its own seed and dropped from the
    selection rows of every other seed.
    """
    held = folds.filter((F.col("seed") == seed) & (F.col("fold") == fold)).select("sample_id", F.lit(1).alias("_hit"))
    d = folds.join(held, "sample_id", "left")
    role = F.when(F.col("_hit").isNull(), "selection").when(F.col("seed") == seed, "held")
    return d.withColumn("role", role).filter(F.col("role").isNotNull()).select("sample_id", "seed", "fold", "role")


def seeds_union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
