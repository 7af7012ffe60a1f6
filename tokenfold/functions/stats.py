"""Exact distributed ranks and quantiles, and other shared table helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HASH_BUCKETS = 3  # leading hex digits of the hash: 4096 buckets


def total(df: DataFrame, expr: Column) -> Column:
    """One aggregate of ``df`` as a scalar subquery (no join, no collect)."""
    return df.agg(expr.alias("v")).scalar()


def keyed_map(df: DataFrame, key: Column, value: Column) -> Column:
    """A small keyed table (one row per class or per fold) as a scalar map."""
    return df.agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), value.alias("v")))).alias("m")).scalar()


def hash_rank(
    df: DataFrame, keys: Sequence[str], hash_col: str, name: str = "rank", lead: Sequence[Column] = ()
) -> DataFrame:
    """``row_number() over (partition by keys order by lead, hash_col)`` without a hot task.

    ``hash_col`` is a hex digest whose leading characters make ordered buckets that
    split every key, however large, evenly. Ranks inside a bucket are shifted
    by the number of rows in the buckets before it. ``lead`` are optional leading
    order columns with few distinct values.
    """
    lead_names = [f"_lead{i}" for i in range(len(lead))]
    group = [*keys, *lead_names, "_bucket"]
    b = df.select("*", *[c.alias(n) for c, n in zip(lead, lead_names)], F.substring(hash_col, 1, HASH_BUCKETS).alias("_bucket"))
    before = W.partitionBy(*keys).orderBy(*lead_names, "_bucket").rowsBetween(W.unboundedPreceding, -1)
    shift = (
        b.groupBy(*group).agg(F.count("*").alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = W.partitionBy(*group).orderBy(hash_col)
    return (
        b.withColumn("_row", F.row_number().over(inside))
        .join(shift, group)
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_row", "_shift", "_bucket", *lead_names)
    )


def range_rank(df: DataFrame, *order: Column, rank: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """Rank from 1 in a total order inside ``keys``, without a task that sorts all rows.

    Rows are ranged by sampled split points of the whole order, sorted inside a
    range and shifted by the sizes of the ranges before it; a key starts at its
    first row. The ranged rows are settled first, so all passes see the same
    ranges. Works for any values: buckets follow the data, not text prefixes.
    """
    from tokenfold.session import settle

    by = [*[F.asc(k) for k in keys], *order]
    part = settle(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = part.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy("_part").orderBy(*by)
    out = part.withColumn("_row", F.row_number().over(inside)).join(shift, "_part").withColumn(rank, F.col("_row") + F.col("_shift"))
    out = out.drop("_row", "_shift", "_part")
    if keys:
        first = out.groupBy(*keys).agg(F.min(rank).alias("_first"))
        out = out.join(first, list(keys)).withColumn(rank, F.col(rank) - F.col("_first") + 1).drop("_first")
    return out.withColumn(rank, F.col(rank).cast("int"))


def _coarse(v: Column) -> Column:
    """A monotone map of a number to at most a few thousand buckets per octave range."""
    octave = F.floor(F.log2(F.abs(v)) * 32) + 40000
    return F.when(v == 0, F.lit(0).cast("bigint")).otherwise((F.signum(v) * octave).cast("bigint"))


def quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float], weight: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per key as columns ``q0, q1, ...``.

    Values are first reduced to (key, value, count). Counts of ordered coarse
    buckets give each bucket its offset, so a hot key is spread over buckets and
    no task sorts or holds all of its values. ``weight`` repeats a value.
    """
    keys = list(keys) or ["_all"]
    d = df if keys != ["_all"] else df.withColumn("_all", F.lit(0))
    times = F.lit(1) if weight is None else F.col(weight)
    d = d.select(*keys, F.col(col).cast("double").alias("_v"), times.alias("_w")).filter(F.col("_v").isNotNull())
    vc = d.groupBy(*keys, "_v").agg(F.sum("_w").alias("_n")).withColumn("_b", _coarse(F.col("_v")))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sizes = (
        vc.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
        .withColumn("_off", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_bn").over(W.partitionBy(*keys)))
        .drop("_bn")
    )
    upto = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    r = vc.join(sizes, [*keys, "_b"]).withColumn("_hi", F.col("_off") + F.sum("_n").over(upto))
    aggs = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, idx in (("l", F.floor(at)), ("u", F.ceil(at))):
            hit = (F.col("_hi") > idx) & (F.col("_hi") - F.col("_n") <= idx)
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_f{i}"))
    out = r.groupBy(*keys).agg(*aggs)
    cols = [
        (F.col(f"_l{i}") + (F.col(f"_u{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
        for i in range(len(probs))
    ]
    return out.select(*[k for k in keys if k != "_all"], *cols)


def quantile_row(df: DataFrame, col: str, probs: Sequence[float]) -> Column:
    """Global quantiles as one scalar array."""
    q = quantiles(df, [], col, probs)
    return q.select(F.array(*[F.col(f"q{i}") for i in range(len(probs))]).alias("q")).scalar()


def set_digest(*parts: Column) -> list[Column]:
    """Order-free digest of a set of rows as three mergeable sums.

    A part is written with its length, a null as ``n``, so different rows have
    different texts. The md5 of each row is cut into two 60-bit numbers that are
    summed: a hot group is digested by partial aggregation, never by collecting.
    """
    mark = lambda p: F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("n"))
    text = F.md5(F.concat(*[mark(p.cast("string")) for p in parts]))
    half = [F.conv(F.substring(text, s, 15), 16, 10).cast("decimal(38,0)") for s in (1, 17)]
    return [F.count("*").alias("_c"), F.sum(half[0]).alias("_s1"), F.sum(half[1]).alias("_s2")]


def digest_key() -> Column:
    return F.concat_ws(":", F.col("_c").cast("string"), F.col("_s1").cast("string"), F.col("_s2").cast("string"))


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1)."""
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0))


def unpivot(df: DataFrame, ids: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide numeric columns to long rows."""
    cols = [c for c in df.columns if c not in ids]
    cast = df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return cast.unpivot([F.col(i) for i in ids], [F.col(f"`{c}`") for c in cols], name, value)


def top_rows(df: DataFrame, n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first n rows of a total order with their rank from 1."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(W.orderBy(*order)))
