"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenfold.llm.common import components
from tokenfold.llm.vectors import finite, matrix, width
from tokenfold.session import settle

COSINE = 0.95
PREFIX = 6
#: The index has sqrt(vectors) pivots, at most this many (their matrix is broadcast).
MOST_PIVOTS = 16_384
#: Candidates drawn for a pivot, and the numbers that all candidates may hold on the driver.
DRAWN, MOST_DRAWN = 4, 1 << 25
#: Members of an inverted list that one task holds on each side.
PER_TILE = 20_000


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _apart(x: np.ndarray, most: int, cosine: float, least: int, step: int = 256) -> np.ndarray:
    """Numbers of the first ``most`` rows with a cosine below ``cosine`` to every row chosen before; the next rows if that gives under ``least``."""
    held: list[int] = []
    for at in range(0, len(x), step):
        new = x[at:at + step]
        free = (new @ x[held].T).max(axis=1) < cosine if held else np.ones(len(new), bool)
        own: list[int] = []
        near = new @ new.T >= cosine
        for i in np.flatnonzero(free).tolist():
            if not near[i, own].any():
                own.append(i)
        held += [at + i for i in own]
        if len(held) >= most:
            break
    held = held[:most]
    if len(held) < least:
        held += np.setdiff1d(np.arange(len(x)), held)[:least - len(held)].tolist()
    return np.array(held, np.int64)


def _spanning(hits: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links (of rows ``a`` and columns ``b`` by number) that join what all of ``hits`` join."""
    x, y = np.empty(0, np.int64), np.empty(0, np.int64)
    label = np.arange(max(a.max(), b.max()) + 1)
    left = hits
    while True:
        row, col = np.flatnonzero(left.any(axis=1)), np.flatnonzero(left.any(axis=0))
        if not len(row):
            return x, y
        x = np.concatenate([x, a[row], a[left[:, col].argmax(axis=0)]])
        y = np.concatenate([y, b[left[row].argmax(axis=1)], b[col]])
        x, y = _forest(x, y)
        label[x] = y
        left = left & (label[a][:, None] != label[b])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer pairs that join the same rows."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def _list_links(p: int, across: bool, x: np.ndarray, prefix: np.ndarray, ball: np.ndarray, side: np.ndarray, n: np.ndarray, cosine: float,
                step: int = 256, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links to add to each member, linked members) of the inverted list of pivot ``p``.

    Members that share a second pivot are compared; a pair counts only where
    ``p`` and that pivot are the two smallest that it shares. Where a block is
    dense in links, they are counted as a matrix and only a spanning part of
    them is kept. Pairs of one ball are linked and counted elsewhere.
    """
    add = np.zeros(len(x), np.int64)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    row, col = np.nonzero(prefix > p)
    second = prefix[row, col]
    order = np.lexsort((*prefix[row].T[::-1], ball[row], second))
    row, second = row[order], second[order]
    cuts = np.flatnonzero(np.diff(second, prepend=-2))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(row)]):
        member, q = row[lo:hi], second[lo]
        if len(member) < 2 or ball[member[0]] >= 0 and ball[member[0]] == ball[member[-1]]:
            continue
        balls = ball[member]
        ends = np.where(balls >= 0, np.searchsorted(balls, balls, side="right"), np.arange(len(member)) + 1)
        # pivots under q besides p: a pair that shares one of them counts there
        under = np.where((prefix[member] < q) & (prefix[member] != p), prefix[member], -1)
        for at in range(0, len(member), step):
            a, begin = member[at:at + step], int(ends[at])
            to = np.arange(begin, len(member))
            for r in under[at]:
                if r >= 0 and len(to) and (under[at:at + step] == r).any(axis=1).all():
                    to = to[(under[to] != r).all(axis=1)]
            if not len(to):
                continue
            b = member[to]
            hits = x[a] @ x[b].T >= cosine
            if np.count_nonzero(hits) > 4 * (len(a) + len(b)):
                hits &= to >= ends[at:at + step, None]
                if across:
                    hits &= side[a][:, None] != side[b]
                for r in np.intersect1d(under[at:at + step], under[to]):
                    if r >= 0:
                        mine, its = np.flatnonzero((under[at:at + step] == r).any(axis=1)), np.flatnonzero((under[to] == r).any(axis=1))
                        hits[np.ix_(mine, its)] = False
                # a member stands once in the list of a second pivot
                add[a] += hits @ n[b]
                add[b] += n[a] @ hits
                i, j = _spanning(hits, a, b)
            else:
                i, j = np.nonzero(hits)
                keep = to[j] >= ends[at + i]
                if across:
                    keep &= side[a[i]] != side[b[j]]
                i, j = a[i[keep]], b[j[keep]]
                shared = (prefix[i][:, :, None] == prefix[j][:, None, :]).any(axis=2) & (prefix[i] >= 0)
                low = np.sort(np.where(shared, prefix[i], np.iinfo(np.int32).max), axis=1)[:, :2]
                own = (low[:, 0] == p) & (low[:, 1] == q)
                i, j = i[own], j[own]
                np.add.at(add, i, n[j])
                np.add.at(add, j, n[i])
            left.append(i)
            right.append(j)
            if sum(map(len, left)) > most:
                i, j = _forest(np.concatenate(left), np.concatenate(right))
                left, right = [i], [j]
    return add, *_forest(np.concatenate(left), np.concatenate(right))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", prefix: int = PREFIX,
                 most_pivots: int = MOST_PIVOTS, per_tile: int = PER_TILE) -> DataFrame:
    """Links and groups of vectors at ``cosine`` or more: (vec_id, n_links, component_id, kept).

    Equal vectors are one point with a count. Up to sqrt(points) pivots, taken in
    hash order and at least twice the angle of ``cosine`` apart, describe a point
    by its ``prefix`` nearest ones; inverted lists hold the points under each of
    these. So a dense group has one or few pivots of its own however many rows it
    holds, and its other nearest ones are far ones that its points have in common
    (where fewer than ``prefix`` are apart, close ones fill up and all pairs meet). Points that share two pivots are compared in
    double precision, so only true links are found; near-duplicates that share
    fewer are missed (recall is measured in the tests). Points within half the
    angle of their nearest pivot form a ball: they are all linked, which counts a
    large group of near copies without its pairs. A list beyond ``per_tile``
    members is cut into pairs of tiles, one task each.

    Defined cases: a vector that is null, empty, zero or holds a null or a
    non-finite number has no links and is its own group; a shorter vector counts
    as filled up with zeros; repeated rows are vectors each; a null id comes last
    in a group; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    ok = finite(F.col(vector)) & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(ok, F.col(vector)).alias("v"))
    rows = rows.withColumn("point", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    points = settle(rows.where("point is not null").groupBy("point", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")))
    count = points.count()
    dim = width(points, "v")
    wanted = min(most_pivots, max(32, math.isqrt(count)))
    drawn = max(wanted, min(DRAWN * wanted, MOST_DRAWN // max(1, dim)))
    held = points.orderBy(F.xxhash64(F.lit("pivot"), "point"), "point").limit(drawn).select("point", "v").toArrow()
    near = _unit(matrix(held.column("v"), dim)) if held.num_rows else np.zeros((0, dim))
    apart = _apart(near, wanted, 2 * cosine**2 - 1 if cosine > 0 else -1.0, prefix)
    pivots = spark.sparkContext.broadcast((near[apart], held.column("point").to_numpy()[apart]))
    ball_cosine = math.sqrt((1 + cosine) / 2) + 1e-9

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, ids = pivots.value
        k = min(prefix, len(near))
        for b in batches:
            found, ball = [], []
            x = _unit(matrix(b.column(1), dim))
            for at in range(0, len(x), 1024):
                s = x[at:at + 1024] @ near.T
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                own = np.take_along_axis(s, top, axis=1)
                first = own.argmax(axis=1)
                nearest = np.take_along_axis(top, first[:, None], axis=1)[:, 0]
                found.append(np.sort(top, axis=1).astype(np.int32))
                ball.append(np.where(own.max(axis=1) >= ball_cosine, nearest, -1))
            held, ball_ = np.concatenate(found), np.concatenate(ball)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * k), pa.array(held.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(ball_.astype(np.int32)), pa.array(ids[ball_], mask=ball_ < 0)],
                                             names=[*b.schema.names, "prefix", "ball", "centre"])

    kind = points.schema["v"].dataType.simpleString()
    described = settle(points.mapInArrow(describe, f"point long, v {kind}, n long, least long, prefix array<int>, ball int, centre long"))
    listed = described.select("point", "v", "n", "prefix", "ball", F.explode("prefix").alias("p"))
    tiles = described.select(F.explode("prefix").alias("_p")).groupBy("_p").agg(F.ceil(F.count(F.lit(1)) / per_tile).cast("int").alias("tiles"))
    listed = listed.join(tiles, F.col("p") == F.col("_p")).withColumn("side", F.pmod(F.xxhash64("point"), F.col("tiles")).cast("int"))
    listed = listed.select("point", "v", "n", "prefix", "ball", "p", "side", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"))
    listed = listed.select("point", "v", "n", "prefix", "ball", "side", "p", F.least("side", "t").alias("lo"), F.greatest("side", "t").alias("hi"))

    def compare(key_: tuple, t: pa.Table) -> pa.Table:
        p, lo, hi = (k.as_py() for k in key_)
        point, n = t.column("point").to_numpy(), t.column("n").to_numpy()
        pre = t.column("prefix").combine_chunks().flatten().to_numpy().reshape(len(point), -1)
        add, a, b = _list_links(p, lo != hi, _unit(matrix(t.column("v"), dim)), pre, t.column("ball").to_numpy(), t.column("side").to_numpy(), n, cosine)
        own = np.flatnonzero(add)
        return pa.table({"a": pa.array(np.concatenate([point[own], point[a]])),
                         "b": pa.array(np.concatenate([point[own], point[b]])),
                         "links": pa.array(np.concatenate([add[own], np.zeros(len(a), np.int64)]))})

    found = settle(listed.groupBy("p", "lo", "hi").applyInArrow(compare, "a long, b long, links long"))
    in_ball = described.where("centre is not null").select(F.col("point").alias("a"), F.col("centre").alias("b"))
    joined = components(found.select("a", "b").unionByName(in_ball))
    added = found.groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("added"))
    balls = described.where("centre is not null").groupBy(F.col("centre").alias("_centre")).agg(F.sum("n").alias("members"))
    per = described.join(added, F.col("point") == F.col("_a"), "left").join(balls, F.col("centre") == F.col("_centre"), "left")
    per = per.select("point", "least", (F.coalesce("members", "n") - 1 + F.coalesce("added", F.lit(0))).alias("n_links"))
    per = per.join(joined, F.col("point") == F.col("id"), "left").withColumn("root", F.coalesce("component", "point")).drop("id", "component")
    groups = per.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    per = per.join(groups, F.col("root") == F.col("_root")).select(F.col("point").alias("_point"), "n_links", "component_id")
    out = rows.select("vec_id", "point").join(per, F.col("point") == F.col("_point"), "left")
    group = F.when(F.col("point").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), group.alias("component_id"),
                      F.col("vec_id").eqNullSafe(group).alias("kept"))
