"""Recurrent exact tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenfold.functions import stats as S

GT = ["gene", "token"]


def token_support(events: DataFrame) -> DataFrame:
    """Samples per (gene, token); events hold a token once per sample."""
    return events.groupBy(*GT).agg(F.count("*").alias("support"))


def learn_hotspots(events: DataFrame, minimum: int = 5, limit: int = 384) -> DataFrame:
    """The ``limit`` most supported tokens, ties by gene then token, ranked from 1."""
    h = token_support(events).filter(F.col("support") >= minimum)
    return S.top_rows(h, limit, F.desc("support"), F.asc("gene"), F.asc("token"))


def functional_hotspots(events: DataFrame, minimum: int = 5, limit: int = 384) -> DataFrame:
    return learn_hotspots(events.filter("conseq >= 2"), minimum, limit)


def synonymous_hotspots(events: DataFrame, minimum: int = 5, limit: int = 384) -> DataFrame:
    return learn_hotspots(events.filter("conseq = 1"), minimum, limit)


def apply_hotspots(events: DataFrame, hotspots: DataFrame) -> DataFrame:
    return events.join(hotspots.select(*GT, "rank"), GT).select("sample_id", "rank", *GT)


def stable_hotspots(events: DataFrame, folds: DataFrame, minimum: int = 5, min_folds: int = 4, limit: int = 384) -> DataFrame:
    """Tokens frequent enough in at least ``min_folds`` training folds.

    Support outside fold k is the total minus the support in fold k, so events
    are counted once. A fold where the token is absent has the full support
    outside it.
    """
    k = S.total(folds, F.countDistinct("fold"))
    per = events.join(folds.select("sample_id", "fold"), "sample_id").groupBy(*GT, "fold").agg(F.count("*").alias("n"))
    tok = per.groupBy(*GT).agg(
        F.sum("n").alias("support"), F.count("*").alias("seen"), F.collect_list("n").alias("ns"))
    ok = F.size(F.filter("ns", lambda n: F.col("support") - n >= minimum))
    absent = F.when(F.col("support") >= minimum, F.col("k") - F.col("seen")).otherwise(0)
    tok = tok.withColumn("k", k).withColumn("stable_folds", ok + absent)
    tok = tok.filter((F.col("support") >= minimum) & (F.col("stable_folds") >= F.least(F.lit(min_folds), F.col("k"))))
    order = [F.desc("stable_folds"), F.desc("support"), F.asc("gene"), F.asc("token")]
    return S.top_rows(tok.select(*GT, "support", "stable_folds"), limit, *order)


def exact_vocab(events: DataFrame, minimum: int = 5) -> DataFrame:
    """All tokens with enough support; their order is (gene, token)."""
    return token_support(events).filter(F.col("support") >= minimum)


def hotspot_count(events: DataFrame, hotspots: DataFrame, samples: DataFrame) -> DataFrame:
    n = apply_hotspots(events, hotspots).groupBy("sample_id").agg(F.count("*").alias("hotspot_mutation_count"))
    return samples.select("sample_id").join(n, "sample_id", "left").fillna(0)


def gene_hotspot(events: DataFrame, hotspots: DataFrame) -> DataFrame:
    return apply_hotspots(events, hotspots).select("sample_id", "gene").distinct()
