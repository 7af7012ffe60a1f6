"""Products of the sample-by-feature matrix without emitting pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenfold.functions import stats as S

BLOCK = 512
SAMPLES_PER_TASK = 200_000


def _add_blocks(block: int, by: Sequence[str]):
    """Sum of outer products of one pair of feature blocks over the samples of a group."""
    def run(key, table):
        import numpy as np
        import pyarrow as pa

        bi, bj = key[-3].as_py(), key[-2].as_py()

        def entries(name):
            col = table.column(name).combine_chunks()
            flat = col.flatten()
            row = np.repeat(np.arange(len(col)), col.value_lengths().to_numpy(zero_copy_only=False))
            return row, flat.field("idx").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False)

        def dense(part, lo, start, n):
            row, idx, val = part
            a, b = np.searchsorted(row, [start, start + n])
            m = np.zeros((n, block))
            np.add.at(m, (row[a:b] - start, idx[a:b] - lo), val[a:b])
            return m

        left = entries("ea")
        right = left if bi == bj else entries("eb")
        acc = np.zeros((block, block))
        for start in range(0, table.num_rows, 1024):
            n = min(1024, table.num_rows - start)
            a = dense(left, bi * block, start, n)
            acc += a.T @ (a if bi == bj else dense(right, bj * block, start, n))
        i, j = np.nonzero(np.triu(acc) if bi == bj else acc)
        out = {c: pa.array([key[k].as_py()] * len(i), table.schema.field(c).type) for k, c in enumerate(by)}
        return pa.table({**out, "i": pa.array((i + bi * block).astype(np.int32)), "j": pa.array((j + bj * block).astype(np.int32)), "s": pa.array(acc[i, j])})

    return run


def gram(rows: DataFrame, by: Sequence[str] = (), block: int = BLOCK, samples_per_task: int = SAMPLES_PER_TASK) -> DataFrame:
    """Sums (*by, i, j, s) of x_i * x_j over samples, i <= j, zeros left out.

    ``rows`` is (sample_id, idx, value, *by). One pass packs a sample's entries
    and sends them to the pairs of feature blocks that it touches; a task adds
    at most ``samples_per_task`` samples into one block pair and emits its
    non-zero sums once, so nothing grows with the pairs of a sample.
    """
    by = list(by)
    kinds = dict(rows.dtypes)
    packed = rows.groupBy("sample_id", *by).agg(F.collect_list(F.struct("idx", F.col("value").cast("double").alias("value"))).alias("e"))
    at = lambda x: F.floor(x / block).cast("int")
    packed = packed.withColumn("bs", F.array_distinct(F.transform("e", lambda x: at(x["idx"]))))
    pairs = F.flatten(F.transform("bs", lambda a: F.transform(F.filter("bs", lambda b: b >= a), lambda b: F.struct(a.alias("bi"), b.alias("bj")))))
    tasks = F.greatest(F.lit(1), F.ceil(S.total(rows, F.approx_count_distinct("sample_id")) / samples_per_task)).cast("int")
    p = packed.select(*by, "e", F.pmod(F.xxhash64("sample_id"), tasks).cast("int").alias("part"), F.explode(pairs).alias("p"))
    side = lambda b: F.filter("e", lambda x: at(x["idx"]) == F.col(f"p.{b}"))
    other = F.when(F.col("p.bi") == F.col("p.bj"), F.array().cast(packed.schema["e"].dataType)).otherwise(side("bj"))  # a block meets itself: sent once
    p = p.select(*by, F.col("p.bi").alias("bi"), F.col("p.bj").alias("bj"), "part", side("bi").alias("ea"), other.alias("eb"))
    schema = "".join(f"{c} {kinds[c]}, " for c in by) + "i int, j int, s double"
    return p.groupBy(*by, "bi", "bj", "part").applyInArrow(_add_blocks(block, by), schema).groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))
