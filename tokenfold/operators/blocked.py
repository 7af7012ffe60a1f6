"""Sparse long tables times tall dense matrices, in blocks that one task can hold.

A tall matrix is a table (b int, m binary): the rows of block ``b`` as doubles. Its rows belong to the samples or to the
features of a sparse table, whose names stand in an index (name, b, i). Only matrices as small as the width squared reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenfold.session import keep, settle

#: Numbers in a block of a tall matrix, entries of a block of the sparse table, partial blocks that one task adds.
CELLS, ENTRIES, FAN_IN = 1 << 20, 1 << 19, 16


def _matrix(value: pa.Scalar | bytes, width: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer() if isinstance(value, pa.Scalar) else value, np.float64).reshape(-1, width)


def _block(b: int, m: np.ndarray) -> pa.Table:
    return pa.table({"b": pa.array([b], pa.int32()), "m": pa.array([np.ascontiguousarray(m, np.float64).tobytes()], pa.binary())})


def _index(names: DataFrame, name: str, blocks: int) -> DataFrame:
    """(name, b, i): blocks by hash, numbers from 0 inside a block."""
    b = names.select(name).distinct().withColumn("b", F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int"))
    return settle(b.withColumn("i", F.row_number().over(Window.partitionBy("b").orderBy(name)) - 1))


def _added(parts: DataFrame, n: int, width: int) -> DataFrame:
    """Sum the partial blocks (b, part, m) of each b, a few at a time."""
    def add(key: tuple, t: pa.Table) -> pa.Table:
        all_ = [_matrix(m, width) for m in t.column("m")]
        out = np.zeros((max(map(len, all_)), width))
        for m in all_:
            out[:len(m)] += m
        return _block(key[0].as_py(), out).append_column("part", pa.array([key[1].as_py()], pa.int64())).select(["b", "part", "m"])

    while n > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("b", "part").applyInArrow(add, "b int, part long, m binary")
        n = math.ceil(n / FAN_IN)
    return parts.select("b", "m")


@dataclass
class Blocked:
    """A sparse table (sample_id, feature, value) in blocks: entries (rb, cb, r, c, value) with the indexes of both sides.

    :meth:`standing` entries are dealt and sorted by block once, so that the
    products of many rounds move the tall matrices only.
    """

    entries: DataFrame
    rows: DataFrame
    columns: DataFrame
    row_blocks: int
    column_blocks: int
    width: int

    @classmethod
    def of(cls, features: DataFrame, width: int | Callable[[int], int], columns: DataFrame | None = None, cells: int = CELLS, per_block: int = ENTRIES) -> Blocked:
        """Lay out a table for tall matrices of ``width`` columns; ``columns`` is the index of another table's features."""
        x = features.select("sample_id", "feature", F.col("value").cast("double").alias("value"))
        if columns is not None:
            x = x.join(columns.select("feature"), "feature", "left_semi")
        n = x.agg(F.count(F.lit(1)), F.count_distinct("sample_id"), F.count_distinct("feature")).first()
        width = width if isinstance(width, int) else width(n[2])
        if columns is None:
            column_blocks = max(1, math.ceil(n[2] * width / cells))
            columns = _index(x, "feature", column_blocks)
        else:
            column_blocks = (columns.agg(F.max("b")).first()[0] or 0) + 1
        row_blocks = max(1, math.ceil(n[1] * width / cells), math.ceil(n[0] / column_blocks / per_block))
        rows = _index(x, "sample_id", row_blocks)
        at = lambda index, name, b, i: index.select(name, F.col("b").alias(b), F.col("i").alias(i))
        entries = x.join(at(columns, "feature", "cb", "c"), "feature").join(at(rows, "sample_id", "rb", "r"), "sample_id")
        return cls(settle(entries.select("rb", "cb", "r", "c", "value")), rows, columns, row_blocks, column_blocks, width)

    def standing(self) -> Blocked:
        """The same table with its entries kept by block until ``release``."""
        parts = max(1, min(self.row_blocks * self.column_blocks, int(self.entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        return replace(self, entries=keep(self.entries.repartition(parts, "rb", "cb").sortWithinPartitions("rb", "cb")))

    def release(self) -> None:
        self.entries.unpersist()

    def _product(self, tall: DataFrame, turn: np.ndarray | None, over: str) -> DataFrame:
        """Contract the side ``over`` of the table with ``tall`` times ``turn``: a tall matrix of the other side."""
        width = self.width if turn is None else turn.shape[1]
        (own, i, n_own), (other, j, n_other) = ("rb", "r", self.row_blocks), ("cb", "c", self.column_blocks)
        if over == "r":
            (own, i, n_own), (other, j, n_other) = (other, j, n_other), (own, i, n_own)
        given = turn.shape[0] if turn is not None else width
        to_at, from_at = (1, 0) if over == "r" else (0, 1)

        def multiply(key: tuple, t: pa.Table, m: pa.Table) -> pa.Table:
            kinds = {"b": pa.int32(), "part": pa.int64(), "m": pa.binary()}
            if not t.num_rows or not m.num_rows:
                return pa.table({c: pa.array([], k) for c, k in kinds.items()})
            dense = _matrix(m.column("m")[0], given)
            dense = dense if turn is None else dense @ turn
            to, from_, value = (t.column(c).to_numpy() for c in (i, j, "value"))
            order = np.argsort(to, kind="stable")
            out, step = np.zeros((int(to.max()) + 1, width)), max(1, (1 << 22) // width)
            for at in range(0, len(order), step):
                part = order[at:at + step]
                first = np.flatnonzero(np.diff(to[part], prepend=-1))
                out[to[part][first]] += np.add.reduceat(value[part, None] * dense[from_[part]], first)
            return _block(key[to_at].as_py(), out).append_column("part", pa.array([key[from_at].as_py()], pa.int64())).select(["b", "part", "m"])

        # both products name the keys in the order by which the entries lie
        spread = tall.select(F.explode(F.sequence(F.lit(0), F.lit(n_own - 1))).alias(own), F.col("b").alias(other), "m")
        met = self.entries.groupBy("rb", "cb").cogroup(spread.groupBy("rb", "cb"))
        return _added(met.applyInArrow(multiply, "b int, part long, m binary"), n_other, width)

    def times(self, tall: DataFrame, turn: np.ndarray | None = None) -> DataFrame:
        """The table times a tall matrix of its features: one of its samples."""
        return self._product(tall, turn, "c")

    def back(self, tall: DataFrame) -> DataFrame:
        """The transposed table times a tall matrix of its samples: one of its features."""
        return self._product(tall, None, "r")

    def gram(self, tall: DataFrame, blocks: int) -> np.ndarray:
        """Inner products of a tall matrix's columns."""
        width = self.width

        def inner(t: pa.Table) -> pa.Table:
            m = _matrix(t.column("m")[0], width)
            return _block(0, m.T @ m).append_column("part", t.column("b").cast(pa.int64())).select(["b", "part", "m"])

        row = _added(tall.groupBy("b").applyInArrow(inner, "b int, part long, m binary"), blocks, width).first()
        return np.zeros((width, width)) if row is None else _matrix(bytes(row["m"]), width)

    def random(self, seed: int, draw: Callable[[np.random.Generator, tuple[int, int]], np.ndarray]) -> DataFrame:
        """A tall matrix of the features drawn by block."""
        width = self.width

        def drawn(key: tuple, t: pa.Table) -> pa.Table:
            b = key[0].as_py()
            return _block(b, draw(np.random.default_rng([seed, b]), (t.num_rows, width)))

        return settle(self.columns.groupBy("b").applyInArrow(drawn, "b int, m binary"))


def weighted(*terms: tuple[float, DataFrame], width: int) -> DataFrame:
    """Sum of tall matrices of one side, each times its weight."""
    def add(key: tuple, t: pa.Table) -> pa.Table:
        all_ = [(w, _matrix(m, width)) for w, m in zip(t.column("w").to_pylist(), t.column("m"))]
        out = np.zeros((max(len(m) for _, m in all_), width))
        for w, m in all_:
            out[:len(m)] += w * m
        return _block(key[0].as_py(), out)

    rows = reduce(DataFrame.unionByName, [t.select("b", F.lit(float(w)).alias("w"), "m") for w, t in terms])
    return rows.groupBy("b").applyInArrow(add, "b int, m binary")


def mapped(tall: DataFrame, width: int, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Change every block of a tall matrix; a block is a task step of its own."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        return _block(key[0].as_py(), change(_matrix(t.column("m")[0], width)))

    return tall.groupBy("b").applyInArrow(run, "b int, m binary")


def named(index: DataFrame, name: str, tall: DataFrame, width: int, column: str) -> DataFrame:
    """(name, array of the row's numbers) of the index's names; rows past the end of a block are zeros."""
    def rows(t: pa.Table, m: pa.Table) -> pa.Table:
        i = t.column("i").to_numpy()
        out = np.zeros((len(i), width))
        if m.num_rows:
            dense = _matrix(m.column("m")[0], width)
            out[i < len(dense)] = dense[i[i < len(dense)]]
        sizes = np.arange(0, (len(i) + 1) * width, width, dtype=np.int32) if width else np.zeros(len(i) + 1, np.int32)
        return pa.table({name: t.column(name), column: pa.ListArray.from_arrays(pa.array(sizes), pa.array(out.ravel()))})

    kind = dict(index.dtypes)[name]
    return index.select(F.col("b").alias("of"), "i", name).groupBy("of").cogroup(tall.groupBy("b")).applyInArrow(rows, f"{name} {kind}, {column} array<double>")


def tall_of(table: DataFrame, name: str, column: str, width: int, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """(index, tall matrix) of a table (name, array of ``width`` numbers)."""
    blocks = max(1, math.ceil(table.count() * width / cells))
    index = _index(table, name, blocks)

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        values = t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        return _block(key[0].as_py(), values[np.argsort(t.column("i").to_numpy())])

    return index, settle(table.select(name, column).join(index, name).groupBy("b").applyInArrow(pack, "b int, m binary"))
