"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenfold.session import settle

#: A word: bytes between the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices_for(rows: int, per_slice: int) -> int:
    return max(1, math.ceil(rows / per_slice))


def numbered(df: DataFrame, group: list[str], order: list[str], rows: int, name: str, value: str | None = None, per_slice: int = 10_000) -> DataFrame:
    """Add a gapless number from 0 inside each group as column ``name``, or the sum of ``value`` over the rows before.

    A group is cut into hashed slices of about ``per_slice`` rows of the whole
    table, rows are numbered inside a slice, and a slice starts where the counts
    of the slices before it end. So one hot group becomes many tasks. The order
    inside a group is the slice, then ``order``; rows equal in all of ``order``
    may swap numbers. ``df`` is read twice: pass a settled table.
    """
    n = slices_for(rows, per_slice)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    step = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy(*group, "_slice").agg(F.sum(step).alias("_n"))
    starts = starts.select(*[F.col(g).alias(f"_of_{g}") for g in [*group, "_slice"]], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = sliced.withColumn("_at", F.coalesce(F.sum(step).over(inside), F.lit(0)))
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in [*group, "_slice"]])
    return own.join(starts, same).select(*df.columns, (F.col("_start") + F.col("_at")).alias(name))


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every id that has a link: (id, component).

    ``links`` has long columns ``a`` and ``b``, in any direction, repeats
    allowed. Each round hooks every id to the smallest of its neighbourhood
    (large star, then small star) with joins and minima only, so a hub never
    meets in one task; rounds end when a round changes nothing. The links of a
    round are settled, so a lost executor replays one round.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = settle(moved.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = state
