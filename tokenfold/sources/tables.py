"""Scans, sinks and the contracts checked at their edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenfold.functions import stats as S


def read_wide(spark: SparkSession, path: str, id_col: str, target: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Wide table with the id as ``sample_id`` and the target as ``label``.

    CSV columns are read as strings from the header, so no inference pass runs.
    """
    if path.rstrip("/").endswith(".csv"):
        header = spark.read.option("header", True).csv(path).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        df = spark.read.schema(schema).option("header", True).csv(path)
    else:
        df = spark.read.parquet(path)
    names = list(columns) if columns is not None else [c for c in df.columns if c not in (id_col, target)]
    label = [F.col(f"`{target}`").alias("label")] if target and target in df.columns else []
    return df.select(F.col(f"`{id_col}`").alias("sample_id"), *label, *[F.col(f"`{c}`") for c in names])


def read_ids(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    return read_wide(spark, path, id_col, columns=[])


def read_folds(wide_folds: DataFrame, samples: DataFrame, seeds: Sequence[int], k: int) -> DataFrame:
    """Fixed wide fold table to long rows; raises on a missing column, id or fold."""
    require_columns(wide_folds, ["sample_id", *[f"fold_seed_{s}" for s in seeds]])
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.col(f"fold_seed_{s}").cast("int").alias("fold")) for s in seeds]))
    long = wide_folds.select("sample_id", pairs.alias("x")).select("sample_id", "x.seed", "x.fold")
    return validate_folds(long, samples, k)


def fold_violations(folds: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    """Rows (check, seed, n) of every broken fold rule; empty when all hold."""
    dup = folds.groupBy("seed", "sample_id").count().filter("count > 1").groupBy("seed").agg(F.count("*").alias("n"))
    bad = folds.filter(F.col("fold").isNull() | ~F.col("fold").between(0, k - 1)).groupBy("seed").agg(F.count("*").alias("n"))
    unknown = folds.join(samples, "sample_id", "left_anti").groupBy("seed").agg(F.count("*").alias("n"))
    n = S.total(samples, F.count("*"))
    per = folds.join(samples.select("sample_id"), "sample_id", "left_semi").groupBy("seed", "fold").agg(F.count("*").alias("c"))
    per = per.groupBy("seed").agg(F.sum("c").alias("rows"), F.count("*").alias("used"))
    absent = per.select("seed", (n - F.col("rows")).alias("n")).filter("n <> 0")
    unused = per.select("seed", (F.lit(k) - F.col("used")).alias("n")).filter("n <> 0")
    out = None
    for name, rows in (("duplicate", dup), ("out_of_range", bad), ("unknown_id", unknown), ("missing_id", absent), ("unused_fold", unused)):
        part = rows.select(F.lit(name).alias("check"), "seed", "n")
        out = part if out is None else out.unionByName(part)
    return out


def validate_folds(folds: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    broken = fold_violations(folds, samples, k).limit(10).collect()
    if broken:
        raise ValueError(f"invalid folds: {[tuple(r) for r in broken]}")
    return folds


def write_scores(proba: DataFrame, path: str, by: Sequence[str] = ("seed",)) -> None:
    proba.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_predictions(pred: DataFrame, path: str, id_col: str = "sample_id") -> None:
    """Range-sorted CSV: part files are in id order and none holds all rows."""
    pred.sort(id_col).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def require_columns(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ValueError(f"missing columns: {absent}")
    if exact and list(columns) != df.columns:
        raise ValueError("columns or their order changed")
    return df


def column_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(place, column, present, missing) of every required column: its null cells, or all rows where it is absent."""
    held = [F.count_if(F.col(f"`{c}`").isNull()) if c in df.columns else F.count(F.lit(1)) for c in columns]
    rows = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.lit(int(c in df.columns)).alias("present"), n.alias("missing"))
            for i, (c, n) in enumerate(zip(columns, held))]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def parity_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """(place, column, other, a_rows, b_rows) of the places where two tables' columns differ in name or order."""
    width = max(len(a.columns), len(b.columns))
    at = lambda df, i: df.columns[i] if i < len(df.columns) else None
    wrong = [(i, at(a, i), at(b, i)) for i in range(width) if at(a, i) != at(b, i)]
    n = b.agg(F.count(F.lit(1)).alias("b_rows"))
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(x).cast("string").alias("column"), F.lit(y).cast("string").alias("other")) for i, x, y in wrong]).cast(
        "array<struct<place:int,column:string,other:string>>")
    return a.agg(F.count(F.lit(1)).alias("a_rows")).select("a_rows", n.scalar().alias("b_rows"), F.explode(rows).alias("r")).select("r.*", "a_rows", "b_rows")


def schema_parity(a: DataFrame, b: DataFrame) -> bool:
    return a.columns == b.columns


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("duplicate column names")
    found = duplicate_keys(df, key).limit(5).collect()
    if found:
        raise ValueError(f"duplicate keys: {[tuple(r) for r in found]}")
    return df


def table_fingerprint(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row (n, fingerprint) over the multiset of the rows; order does not matter."""
    return df.agg(*S.set_digest(*[F.col(c) for c in cols])).select(
        F.col("_c").alias("n"), F.sha2(S.digest_key(), 256).alias("fingerprint"))


def split_fingerprint(folds: DataFrame) -> DataFrame:
    return folds.groupBy("seed", "fold").agg(*S.set_digest(F.col("sample_id"))).select(
        "seed", "fold", F.col("_c").alias("n"), F.sha2(S.digest_key(), 256).alias("fingerprint"))
