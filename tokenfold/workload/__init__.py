"""Registered queries over the driver tables, each next to its oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenfold.workload import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RAW: dict[str, str] = {}  # oracle text before views and casts
SPEC: dict[str, list[tuple[str, str]]] = {}
_SPARK = {"l": "bigint", "s": "string", "d": "double"}
_DUCK = {"l": "BIGINT", "s": "VARCHAR"}


def _columns(cols: str) -> list[tuple[str, str]]:
    """``"sample_id gene:s w:d"`` to names with a type letter (long by default)."""
    return [tuple((c + ":l").split(":")[:2]) for c in cols.split()]


def _with_views(tail: str) -> str:
    """Prepend the views a query text mentions, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in views.SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(tail)
    return "WITH " + ",\n".join(f"{n} AS ({views.SQL[n]})" for n in needed) + "\n" if needed else ""


def query(name: str, cols: str, sql: str | None = None):
    """Register a query; both engines return the same names, types and 6 decimals."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        spec = _columns(cols)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = []
            for c, t in spec:
                col = F.col(f"`{c}`").cast(_SPARK[t])
                out.append((F.round(col, 6) + F.lit(0.0) if t == "d" else col).alias(c))
            return fn(spark, sf_dir).select(*out)

        QUERIES[name], SPEC[name] = run, spec
        if sql is not None:
            RAW[name] = sql
            cast = ", ".join(
                f'round(cast("{c}" AS DOUBLE), 6) + 0e0 AS "{c}"' if t == "d" else f'cast("{c}" AS {_DUCK[t]}) AS "{c}"'
                for c, t in spec
            )
            ORACLE[name] = f"{_with_views(sql)}SELECT {cast} FROM ({sql}) _q"
        return fn

    return register


def load() -> None:
    from tokenfold.workload import (  # noqa: F401
        q_cells, q_genes, q_profile, q_signatures, q_metrics, q_proba, q_search, q_selection, q_training, q_registry,
    )
