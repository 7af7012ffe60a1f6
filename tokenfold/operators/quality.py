"""Profiling, encoding and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenfold.functions import stats as S
from tokenfold.session import keep


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _one_pass(df: DataFrame, measures: dict[str, callable], columns: Sequence[str] | None = None) -> DataFrame:
    """All measures of all columns in one aggregate, unpivoted to one row per column."""
    cols = list(columns or df.columns)
    aggs = [F.struct(*[fn(c).alias(m) for m, fn in measures.items()]).alias(f"_{i}") for i, c in enumerate(cols)]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("s")) for i, c in enumerate(cols)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.column", "r.s.*")


def missing_profile(df: DataFrame, top: int = 20) -> DataFrame:
    m = _one_pass(df, {"missing": lambda c: F.count_if(_q(c).isNull())})
    return m.filter("missing > 0").orderBy(F.desc("missing"), "column").limit(top)


def missing_rate(df: DataFrame) -> DataFrame:
    return _one_pass(df, {"missing_rate": lambda c: F.avg(_q(c).isNull().cast("double"))})


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one value, null counting as a value.

    min = max decides it, so no distinct values are shuffled at all.
    """
    m = _one_pass(df, {
        "lo": lambda c: F.min(_q(c)).cast("string"), "hi": lambda c: F.max(_q(c)).cast("string"),
        "nulls": lambda c: F.count_if(_q(c).isNull()), "n": lambda c: F.count(F.lit(1))})
    one = (F.col("lo") == F.col("hi")) & (F.col("nulls") == 0)
    return m.filter(one | (F.col("nulls") == F.col("n"))).select("column")


def infer_numeric(df: DataFrame, minimum: float = 0.99) -> DataFrame:
    """Columns that are numeric, or text of which at least ``minimum`` parses as a number."""
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema}
    m = _one_pass(df, {
        "parsed": lambda c: F.count(_q(c)) if kinds[c] else F.count(_q(c).cast("string").try_cast("double")),
        "n": lambda c: F.count(_q(c)), "typed": lambda c: F.max(F.lit(kinds[c]))})
    share = F.try_divide(F.col("parsed"), F.col("n"))
    return m.filter(F.col("typed") | (share >= minimum)).select("column", share.alias("share"))


def numeric_profile(df: DataFrame) -> DataFrame:
    cols = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    num = lambda c: _q(c).cast("double")
    return _one_pass(df, {
        "mean": lambda c: F.round(F.avg(num(c)), 4), "std": lambda c: F.round(F.stddev_samp(num(c)), 4),
        "min": lambda c: F.round(F.min(num(c)), 4), "max": lambda c: F.round(F.max(num(c)), 4)}, cols)


def profile_headline(df: DataFrame) -> DataFrame:
    """Row, feature, numeric, categorical, with-missing and constant counts in one row."""
    const = constant_columns(df).withColumn("c", F.lit(1))
    num = infer_numeric(df).withColumn("m", F.lit(1)).select("column", "m")
    base = _one_pass(df, {"nulls": lambda c: F.count_if(_q(c).isNull()), "n": lambda c: F.count(F.lit(1))})
    j = base.join(const, "column", "left").join(num, "column", "left").fillna(0, ["c", "m"])
    return j.agg(
        F.max("n").alias("n_rows"), F.count("*").alias("n_features"),
        F.count_if((F.col("m") == 1) & (F.col("c") == 0)).alias("n_numeric"),
        F.count_if((F.col("m") == 0) & (F.col("c") == 0)).alias("n_categorical"),
        F.count_if(F.col("nulls") > 0).alias("n_with_missing"), F.sum("c").alias("n_constant"))


def ordinal_state(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): alphabetical codes of the observed values."""
    text = df.select(*[_q(c).cast("string").alias(c) for c in columns])
    pairs = text.unpivot([], [_q(c) for c in columns], "column", "value")
    d = pairs.filter(F.col("value").isNotNull()).distinct()
    return S.range_rank(d, F.asc("value"), keys=["column"]).select("column", "value", (F.col("rank") - 1).alias("code"))


def ordinal_encode(df: DataFrame, state: DataFrame, columns: Sequence[str], id_col: str = "sample_id") -> DataFrame:
    """Long (id, column, code); a value not in the state codes as -1."""
    text = df.select(id_col, *[_q(c).cast("string").alias(c) for c in columns])
    long = text.unpivot([id_col], [_q(c) for c in columns], "column", "value")
    j = long.join(state, ["column", "value"], "left")
    return j.select(id_col, "column", F.coalesce("code", F.lit(-1)).alias("code"))


def exact_cells(cells: DataFrame) -> DataFrame:
    """(sample_id, gene, value): whole cells, missing ones by a mark."""
    return cells.select("sample_id", "gene", F.coalesce("cell", F.lit("__MISSING__")).alias("value"))


def _dictionary(exact: DataFrame) -> DataFrame:
    """(gene, value, code, seen) of the texts of :func:`exact_cells` and WT, coded by alphabetical rank minus that of WT.

    ``seen`` is 1 for texts that occur in a sample with an id.
    """
    d = exact.select("gene", "value", F.col("sample_id").isNotNull().cast("int").alias("seen"))
    d = d.unionByName(exact.select("gene").distinct().select("gene", F.lit("WT").alias("value"), F.lit(0).alias("seen")))
    d = S.range_rank(d.groupBy("gene", "value").agg(F.max("seen").alias("seen")), F.asc("value"), rank="code", keys=["gene"])
    wt = d.filter("value = 'WT'").select("gene", F.col("code").alias("wt"))
    return d.join(wt, "gene").select("gene", "value", (F.col("code") - F.col("wt")).alias("code"), "seen")


def wt_zero_codes(exact: DataFrame) -> DataFrame:
    """(gene, value, code): the codes of :func:`ordinal_wt_zero` by text instead of by cell."""
    return _dictionary(exact).filter("seen = 1").drop("seen")


def ordinal_wt_zero(cells: DataFrame) -> DataFrame:
    """Exact-cell codes per gene shifted so that wild type is zero.

    Wild-type cells are implicit in the long table, so WT joins each gene's
    dictionary. The code of a text is its alphabetical rank minus that of WT.
    """
    exact = exact_cells(cells)
    return exact.join(_dictionary(exact).drop("seen"), ["gene", "value"]).select("sample_id", "gene", "code")


def _psi_edges(q: Column) -> Column:
    """Inner bin edges from the reference quantiles, with the one- and two-value rules."""
    u = F.array_distinct(q)
    one = F.get(u, F.lit(0))
    scale = F.greatest(F.abs(one) * 1e-6, F.lit(1e-6))
    return (
        F.when(F.size(u) == 1, F.array(one - scale, one + scale))
        .when(F.size(u) == 2, F.array((one + F.get(u, F.lit(1))) / 2))
        .otherwise(F.slice(u, F.lit(2), F.greatest(F.size(u) - 2, F.lit(0))))
    )


def _psi(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index per key from (keys, _nb, _bin, r, v): reference and compared rows of a bin."""
    c = counts.groupBy(*keys, "_nb").agg(
        F.sum("r").alias("_r"), F.sum("v").alias("_v"), F.map_from_entries(F.collect_list(F.struct("_bin", F.struct("r", "v")))).alias("_m"))
    eps = 1e-6
    share = lambda n, t: (n + eps) / (t + eps * F.col("_nb"))

    def term(b):
        hit = F.element_at("_m", b)
        pr = share(F.coalesce(hit["r"], F.lit(0)), F.col("_r"))
        pv = share(F.coalesce(hit["v"], F.lit(0)), F.col("_v"))
        return (pv - pr) * F.ln(pv / pr)

    terms = F.transform(F.sequence(F.lit(0), F.col("_nb") - 1), term)
    return c.select(*keys, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("psi"))


def _bin(edges: Column, value: str) -> Column:
    return F.size(F.filter(edges, lambda e: e <= F.col(value)))


def _probs(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def psi(ref: DataFrame, cmp: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Population stability index of one column between reference rows and others.

    The edges are the reference quantiles, a scalar; values are counted by bin in
    the tasks that read them, so no row meets a join.
    """
    side = lambda df, r: df.select(F.col(col).cast("double").alias("x"), F.lit(r).alias("r"), F.lit(1 - r).alias("v"))
    edges = _psi_edges(S.quantile_row(ref, col, _probs(bins)))
    d = side(ref, 1).unionByName(side(cmp, 0)).filter(F.col("x").isNotNull())
    d = d.withColumn("_e", edges).select((F.size("_e") + 1).alias("_nb"), _bin(F.col("_e"), "x").alias("_bin"), "r", "v")
    return _psi(d.groupBy("_nb", "_bin").agg(F.sum("r").alias("r"), F.sum("v").alias("v")), []).select("psi")


def fold_psi(features: DataFrame, folds: DataFrame, k: int, bins: int = 10) -> DataFrame:
    """PSI of every feature between the training and the validation part of each fold.

    Rows are counted once by (feature, value, fold); the reference of a fold is
    the total minus that fold, so only distinct values meet the k parts.
    """
    j = features.join(folds.select("sample_id", F.col("fold").alias("_f")), "sample_id")
    c = j.groupBy("feature", F.col("value").cast("double").alias("x"), "_f").agg(F.count("*").alias("n")).filter("x is not null")
    held = F.map_from_entries(F.collect_list(F.struct("_f", "n")))
    c = c.groupBy("feature", "x").agg(F.sum("n").alias("t"), held.alias("h"))
    c = c.select("feature", "x", "t", "h", F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("fold"))
    own = F.coalesce(F.element_at("h", F.col("fold")), F.lit(0))
    c = keep(c.select("fold", "feature", "x", (F.col("t") - own).alias("r"), own.alias("v")))
    keys = ["fold", "feature"]
    q = S.quantiles(c.filter("r > 0"), keys, "x", _probs(bins), weight="r")
    edges = q.select(*keys, _psi_edges(F.array(*[F.col(f"q{i}") for i in range(bins + 1)])).alias("_e"))
    d = c.join(edges, keys).select(*keys, (F.size("_e") + 1).alias("_nb"), _bin(F.col("_e"), "x").alias("_bin"), "r", "v")
    return _psi(d.groupBy(*keys, "_nb", "_bin").agg(F.sum("r").alias("r"), F.sum("v").alias("v")), keys)
