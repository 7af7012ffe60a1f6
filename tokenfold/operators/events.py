"""Cells to events: unpivot, explode, parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenfold.functions import cells as C


def to_cells(wide: DataFrame, id_col: str = "sample_id", genes: list[str] | None = None, keep_null: bool = False) -> DataFrame:
    """Unpivot a wide table to (sample_id, gene, cell), dropping wild-type cells."""
    genes = genes or [c for c in wide.columns if c != id_col]
    long = wide.select(F.col(id_col).alias("sample_id"), *[F.col(f"`{g}`").cast("string").alias(g) for g in genes])
    long = long.unpivot([F.col("sample_id")], [F.col(f"`{g}`") for g in genes], "gene", "cell")
    mutated = C.norm_cell(F.col("cell")) != "WT"
    return long.filter(mutated | F.col("cell").isNull()) if keep_null else long.filter(mutated)


def missing_genes(cells: DataFrame, null_policy: str = "jyp") -> DataFrame:
    """(sample_id, gene) of cells in the MISSING state."""
    if null_policy == "jyp":
        hit = C.cell_state(F.col("cell")) == "MISSING"
    else:
        hit = F.col("cell").isNull()
    return cells.filter(hit).select("sample_id", "gene")


def _explode(cells: DataFrame, tokens: Column) -> DataFrame:
    keep = [F.col(c) for c in cells.columns if c != "cell"]
    return cells.filter(F.col("cell").isNotNull()).select(*keep, F.explode(tokens).alias("token"))


def build_events(cells: DataFrame, dialect: str = "em5") -> DataFrame:
    """One row per (sample_id, gene, token) with the dialect's parsed columns.

    Cells are unique per (sample_id, gene), so tokens are made distinct inside
    the row and no shuffle is needed.
    """
    cell, t = F.col("cell"), F.col("token")
    if dialect in ("em4", "em5"):
        rule = C.consequence4 if dialect == "em4" else C.consequence5
        return _explode(cells, C.split_tokens(cell)).withColumn("conseq", rule(t))
    if dialect == "f":
        f = C.flags_f(t)
        return _explode(cells, C.split_tokens(cell)).select(
            "*", f["kind"].alias("kind"),
            *[f[k].cast("int").alias(k) for k in ("truncating", "missense", "splice")])
    if dialect == "jh":
        # the prefix "p." may stand apart from its token
        joined = F.regexp_replace(cell, r"\b(?i:p)\.\s*", "")
        toks = F.array_distinct(F.transform(C.raw_tokens(joined), C.norm_token_jh))
        out = _explode(cells, F.filter(toks, lambda x: ~x.isin("WT", "MISSING")))
        out = out.withColumn("e", C.parse_event_jh(t))
        return out.select(*[c for c in out.columns if c not in ("token", "e")], F.col("e.exact_event").alias("token"),
                          "e.consequence", "e.position", "e.aa_from", "e.aa_to")
    if dialect == "jyp":
        toks = F.array_distinct(F.transform(C.raw_tokens(cell), C.norm_token_jyp))
        out = _explode(cells, F.filter(toks, lambda x: ~x.isin("WT", "MISSING")))
        return out.select("*", C.parse_event_jyp(t).alias("consequence"), C.protein_position(t).alias("position"),
                          C.aa_transition(t).alias("transition"))
    if dialect in ("jsj1", "jsj2"):
        wild = C.norm_cell(cell).isin(["WT", ""] if dialect == "jsj1" else ["WT", "", "NAN", "NONE"])
        out = _explode(cells.filter(~wild), F.transform(C.raw_tokens(cell), C.jsj_body))
        pos = C.protein_position(t)
        return out.select("*", C.event_type_jsj(t, int(dialect[-1])).alias("event_type"),
                          C.position_bin(pos, "jsj").alias("position_bin"))
    if dialect == "jsj3":
        out = _explode(cells, F.transform(C.raw_tokens(cell), C.norm_token_jsj))
        return out.withColumn("kind", C.kind_jsj(t)).filter(F.col("kind") != "WT")
    raise ValueError(f"unknown dialect {dialect!r}")


def _digit(cond: Column) -> Column:
    return F.least(F.lit(9), F.count(F.when(cond, 1)))


def cell_code(events: DataFrame, version: int = 3) -> DataFrame:
    """Packed code FS*1000 + STOP*100 + MISSENSE*10 + SILENT per (sample, gene)."""
    if version == 3:
        k = F.col("kind")
        code = (_digit(k == "FS") * 1000 + _digit(k == "STOP") * 100 + _digit(k == "MISSENSE") * 10
                + _digit(k == "SILENT"))
        return events.groupBy("sample_id", "gene").agg(code.cast("bigint").alias("code"))
    k = F.col("event_type")
    code = (_digit(k.isin("FS", "DEL", "INS", "DELINS")) * 1000 + _digit(k == "STOP") * 100
            + _digit(k == "SUB") * 10 + _digit(k == "SYN"))
    only_other = F.count(F.when(k == "OTHER", 1)) > 0
    return (
        events.groupBy("sample_id", "gene").agg(code.cast("bigint").alias("code"), only_other.alias("o"))
        .withColumn("code", F.when((F.col("code") == 0) & F.col("o"), F.lit(-1)).otherwise(F.col("code")))
        .drop("o")
    )
