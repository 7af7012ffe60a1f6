"""Exact top-k inner products with multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenfold.llm.common import slices_for
from tokenfold.llm.vectors import finite, matrix, width

K = 10
SCALE = 1024
#: Segments of a vector, coarse to fine.
LEVELS = (2, 8, 16)
PER_BLOCK = 8_192
PER_QUERIES = 16_384
PILOT = 2_048


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers."""
    return np.floor(x * scale).astype(np.int64)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each segment of l components: sqrt(l) * mean and sqrt(l) * deviation.

    With these as coordinates, |q - x|^2 is at least the squared distance of the
    statistics, and as both sides have the same squared norm, the inner product
    of q and x is at most the inner product of their statistics.
    """
    out = []
    for part in np.array_split(x, segments, axis=1):
        mean = part.mean(axis=1)
        out += [mean * np.sqrt(part.shape[1]), np.sqrt(np.maximum(((part - mean[:, None]) ** 2).sum(axis=1), 0))]
    return np.stack(out, axis=1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2**53:  # doubles hold every partial sum
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def block_top(q: np.ndarray, q_id: np.ndarray, floor: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, levels: tuple[int, ...], step: int = 32):
    """Yield (query row, candidate rows, scores): the block's part of the top k of each query, given a score that k rows reach."""
    levels = [n for n in levels if n < q.shape[1]]
    stats_q = [segment_statistics(q.astype(np.float64), n) for n in levels]
    stats_x = [segment_statistics(x.astype(np.float64), n) for n in levels]
    size_q, size_x = (np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)) for v in (q, x))
    for at in range(0, len(q), step):
        rows = slice(at, at + step)
        slack = 1e-9 * np.outer(size_q[rows], size_x) + 1e-6
        alive = np.ones(slack.shape, bool)
        left = np.arange(len(x))
        for a, b in zip(stats_q, stats_x):
            bound = a[rows] @ b[left].T + slack[:, left]
            alive = alive & (bound >= floor[rows, None])
            kept = np.flatnonzero(alive.any(axis=0))
            left, alive = left[kept], alive[:, kept]
        scores = products(q[rows], x[left])
        alive &= (scores >= floor[rows, None]) & (x_id[left][None, :] != q_id[rows, None])
        for i in np.flatnonzero(alive.any(axis=1)):
            own = np.flatnonzero(alive[i])
            best = own[np.lexsort((x_id[left[own]], -scores[i, own]))[:k]]
            yield at + i, left[best], scores[i, best]


def top_products(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding",
                 levels: tuple[int, ...] = LEVELS, per_block: int = PER_BLOCK, per_queries: int = PER_QUERIES, pilot: int = PILOT) -> DataFrame:
    """Highest inner products of scaled vectors for the rows that ``is_query`` marks: (query_id, rank, vec_id, score).

    Candidates are all rows but those with the query's id. Blocks of candidates
    meet blocks of queries by an equi-join on block numbers. A query first gets
    the k-th best score among a bounded pilot sample of rows as its floor. A block
    then drops candidates whose upper bound from segment means and deviations,
    coarse to fine, lies below the floor, and scores the survivors exactly; a
    block answers with at most k rows a query. Ties go to the smaller id.

    Defined cases: a vector that is null, empty or holds a null or a non-finite
    number takes no part, as query or candidate; a shorter vector counts as
    filled up with zeros; scores must fit a long; equal query rows give one list; rows with a null id take no
    part, as neither tie nor own row can be told; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(finite(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
    counts = rows.agg(F.count(F.lit(1)), F.sum(F.col("q").cast("int"))).first()
    blocks, groups, dim = slices_for(counts[0], per_block), slices_for(counts[1] or 0, per_queries), width(rows, "v")
    sample = rows.orderBy(F.xxhash64(F.lit("pilot"), "id"), "id").limit(pilot).select("id", "v").toArrow()
    held = spark.sparkContext.broadcast((sample.column("id").to_numpy(), scaled(matrix(sample.column("v"), dim), scale)))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = held.value
        for b in batches:
            own, low = b.column(0).to_numpy(), np.full(b.num_rows, np.iinfo(np.int64).min)
            q = scaled(matrix(b.column(1), dim), scale)
            for at in range(0, len(q), 1024):
                part = slice(at, at + 1024)
                s = products(q[part], x)
                s[ids[None, :] == own[part, None]] = np.iinfo(np.int64).min
                if len(ids) >= k:
                    low[part] = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low)], names=["id", "v", "floor"])

    kind = rows.schema["v"].dataType.simpleString()
    asked = rows.where("q").select("id", "v").distinct().mapInArrow(floors, f"id long, v {kind}, floor long")
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    asked = asked.withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    given = rows.select("id", "v", F.pmod(F.xxhash64(F.lit("block"), "id", "v"), F.lit(blocks)).cast("int").alias("xb"))
    given = given.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def score(key_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "query_row": [], "vec_id": [], "score": []}
        if a.num_rows and b.num_rows:
            q, x = scaled(matrix(a.column("v"), dim), scale), scaled(matrix(b.column("v"), dim), scale)
            q_id, x_id, tag = a.column("id").to_numpy(), b.column("id").to_numpy(), a.column("row").to_numpy()
            for i, j, s in block_top(q, q_id, a.column("floor").to_numpy(), x, x_id, k, levels):
                out["query_id"].append(np.full(len(j), q_id[i]))
                out["query_row"].append(np.full(len(j), tag[i]))
                out["vec_id"].append(x_id[j])
                out["score"].append(s)
        return pa.table({c: pa.array(np.concatenate([np.empty(0, np.int64), *v])) for c, v in out.items()})

    met = asked.withColumn("row", F.xxhash64("v")).groupBy("xb", "qb").cogroup(given.groupBy("xb", "qb"))
    scored = met.applyInArrow(score, "query_id long, query_row long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
