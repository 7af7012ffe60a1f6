"""Hard negatives of anchor vectors by the threshold algorithm over sorted component lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenfold.llm.common import slices_for
from tokenfold.llm.topk import products, scaled
from tokenfold.llm.vectors import finite, matrix, width
from tokenfold.session import settle

SCALE = 256
#: Positives of an anchor, negatives of a positive, and a negative's least and greatest score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows of a block of candidates, anchors of a group, and rows of the sample that gives first floors.
PER_BLOCK, PER_ANCHORS, PILOT = 1 << 17, 1 << 16, 2_048
LEAST = np.iinfo(np.int64).min


class Lists:
    """Sorted component lists of a block of candidates."""

    def __init__(self, x: np.ndarray, first: int = 16):
        self.x = x
        self.rising = np.argsort(x, axis=0, kind="stable")
        sorted_ = np.take_along_axis(x, self.rising, axis=0)
        n = len(x)
        self.depths = [0, *(d for d in (first << (2 * k) for k in range(32)) if d < n)] if n else []
        self.low, self.high = sorted_[self.depths], sorted_[[n - 1 - d for d in self.depths]]

    def thresholds(self, q: np.ndarray) -> np.ndarray:
        """Per anchor and depth: the most that a row scores which none of the anchor's lists has shown down to that depth."""
        return products(np.maximum(q, 0), self.high) + products(np.minimum(q, 0), self.low)

    def shown(self, q: np.ndarray, depth: int) -> np.ndarray:
        """Rows in the heads of an anchor's lists: from the top where its component is positive, from the bottom where negative."""
        heads = [self.rising[len(self.x) - depth:, q > 0].ravel(), self.rising[:depth, q < 0].ravel()]
        return np.unique(np.concatenate(heads))


def _kth(scores: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Per window [low, high]: its k-th best of ``scores``, or ``low`` where it holds fewer."""
    out = low.copy()
    for w in range(len(low)):
        own = scores[(scores >= low[w]) & (scores <= high[w])]
        if len(own) >= k:
            out[w] = np.partition(own, len(own) - k)[len(own) - k]
    return out


def block_best(q: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray, x_id: np.ndarray, may: np.ndarray, k: int, tile: int = 32):
    """Yield (anchor row, window, candidate rows, scores): a block's part of the k best candidates in each window of each anchor.

    ``low`` and ``high`` (anchors x windows) are inclusive; a window with low > high is empty. ``may`` (anchors x candidates, or a
    function of an anchor row) tells which candidates count. Lists are read deeper, four times as deep each time, until the
    threshold lies strictly below the k-th score of every window; where reading on would show most of the block, the rest of the
    block is scored at once.
    """
    lists = Lists(x)
    busy = np.flatnonzero((low <= high).any(axis=1))
    if not lists.depths or not len(busy):
        return
    limits = lists.thresholds(q[busy])
    deep = []

    def best(i: int, rows: np.ndarray, scores: np.ndarray):
        for w in np.flatnonzero(low[i] <= high[i]):
            own = np.flatnonzero((scores >= low[i, w]) & (scores <= high[i, w]))
            own = own[np.lexsort((x_id[rows[own]], -scores[own]))[:k]]
            if len(own):
                yield i, w, rows[own], scores[own]

    for i, limit in zip(busy.tolist(), limits):
        floors = low[i][low[i] <= high[i]]
        wanted = int(np.argmax(limit < floors.min())) if (limit < floors.min()).any() else len(limit)
        if wanted == 0:
            continue
        reach = lists.depths[wanted] if wanted < len(limit) else len(x)
        if reach * max(1, int((q[i] != 0).sum())) >= len(x):
            deep.append(i)
            continue
        for depth, bound in zip(lists.depths[1:], limit[1:]):
            rows = lists.shown(q[i], depth)
            rows = rows[may(i)[rows]]
            scores = products(q[i:i + 1], x[rows])[0]
            if bound < _kth(scores, low[i], high[i], k)[low[i] <= high[i]].min():
                break
        yield from best(i, rows, scores)
    for at in range(0, len(deep), tile):
        part = deep[at:at + tile]
        for i, scores in zip(part, products(q[part], x)):
            usable = low[i] <= high[i]
            rows = np.flatnonzero((scores >= low[i][usable].min()) & (scores <= high[i][usable].max()) & may(i))
            yield from best(i, rows, scores[rows])


def _windows(anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends (anchors x windows) of lists of windows; missing ones are empty windows."""
    ends = [anchors.column(c).to_pylist() for c in ("low", "high")]
    out = [np.full((len(ends[0]), max([1, *map(len, ends[0])])), fill, np.int64) for fill in (1, 0)]
    for rows, filled in zip(ends, out):
        for i, v in enumerate(rows):
            filled[i, :len(v)] = v
    return out[0], out[1]


def _values(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy(zero_copy_only=False)


def _hundredth(x: Column) -> Column:
    """Floor of x / 100 in whole numbers."""
    return F.floor(x.cast("decimal(25,0)") / F.lit(100)).cast("long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                   per_block: int = PER_BLOCK, per_anchors: int = PER_ANCHORS, pilot: int = PILOT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores being products of floor(scale * x).

    An anchor's positives are its ``positives`` best other rows of its label, a positive's negatives the ``negatives`` best
    rows of other labels with ``low`` to ``high`` hundredths of its score; ties go to the smaller id. Both searches run the
    threshold algorithm on blocks of candidates: every component has a sorted list, an anchor reads it from the end that its own
    component's sign prefers, scores what it meets at random access, and stops where the sum of the list ends is strictly below
    the k-th score of each of its windows. K-th scores among a bounded sample of rows give the first floors; they only save
    reading. Positives are looked for in blocks of the anchor's own label. Blocks and groups of anchors have bounded sizes, however
    many rows a label has.

    Defined cases: rows with a null id or label, or a vector that is null, empty or holds a null or non-finite number take no part;
    shorter vectors count as filled up with zeros; a row with the anchor's id is no candidate of it; repeated candidate rows
    count each, equal anchor rows once; an anchor without other rows of its label, and a positive without a fitting negative (as
    any with a negative score), return nothing; hundredfold scores must fit a long; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(finite(F.col(vector)) & F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"), is_anchor.alias("anchor"))
    counts = rows.agg(F.count(F.lit(1)), F.sum(F.col("anchor").cast("int"))).first()
    dim, blocks, groups = width(rows, "v"), slices_for(counts[0], per_block), slices_for(counts[1] or 0, per_anchors)
    sample = rows.orderBy(F.xxhash64(F.lit("pilot"), "id"), "id").limit(pilot).select("id", "label", "v").toArrow()
    held = spark.sparkContext.broadcast((sample.column("id").to_numpy(), _values(sample, "label"), scaled(matrix(sample.column("v"), dim), scale)))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    asked_as = f"id long, tag long, label {kind['label']}, v {kind['v']}, low array<long>, high array<long>"
    candidates = rows.select("id", "label", "v")
    anchors = rows.where("anchor").select("id", F.xxhash64("label", "v").alias("tag"), "label", "v").distinct()

    def floored(batches: Iterator[pa.RecordBatch], same: bool, k: int) -> Iterator[pa.RecordBatch]:
        """Raise every window's lower end to its k-th score among the sample."""
        ids, labels, x = held.value
        for b in batches:
            t = pa.Table.from_batches([b])
            q, (low, high) = scaled(matrix(t.column("v"), dim), scale), _windows(t)
            own_id, own = _values(t, "id"), _values(t, "label")
            for at in range(0, len(q), 512):
                for i, scores in enumerate(products(q[at:at + 512], x), at):
                    low[i] = _kth(scores[(ids != own_id[i]) & ((labels == own[i]) == same)], low[i], high[i], k)
            yield from t.set_column(t.schema.get_field_index("low"), "low", pa.array(list(low), pa.list_(pa.int64()))).to_batches()

    def found(a: pa.Table, b: pa.Table, same: bool, k: int) -> pa.Table:
        out: dict[str, list] = {"id": [], "tag": [], "w": [], "found_id": [], "score": []}
        if a.num_rows and b.num_rows:
            q, x, (low, high) = scaled(matrix(a.column("v"), dim), scale), scaled(matrix(b.column("v"), dim), scale), _windows(a)
            q_id, tag, own, x_id, other = _values(a, "id"), _values(a, "tag"), _values(a, "label"), _values(b, "id"), _values(b, "label")
            for i, w, j, scores in block_best(q, low, high, x, x_id, lambda i: (x_id != q_id[i]) & ((other == own[i]) == same), k):
                for name, value in (("id", q_id[i]), ("tag", tag[i]), ("w", w)):
                    out[name].append(np.full(len(j), value))
                out["found_id"].append(x_id[j])
                out["score"].append(scores)
        return pa.table({c: pa.array(np.concatenate([np.empty(0, np.int64), *v]).astype(np.int64)) for c, v in out.items()})

    def searched(asked: DataFrame, given: DataFrame, same: bool, k: int) -> DataFrame:
        """The k best of every window over the blocks ``xb`` that an anchor meets: (id, tag, w, found_id, score, rank)."""
        left = asked.withColumn("qb", F.pmod(F.xxhash64("id", "tag"), F.lit(groups)).cast("int"))
        right = given.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        met = left.groupBy("xb", "qb").cogroup(right.groupBy("xb", "qb"))
        pairs = met.applyInArrow(lambda key_, a, b: found(a, b, same, k), "id long, tag long, w long, found_id long, score long")
        best = Window.partitionBy("id", "tag", "w").orderBy(F.desc("score"), "found_id")
        return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    every = F.array(F.lit(int(LEAST))), F.array(F.lit(int(np.iinfo(np.int64).max)))
    asked = anchors.withColumns(dict(zip(("low", "high"), every))).mapInArrow(lambda x: floored(x, True, positives), asked_as)
    sizes = settle(rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("slices")))
    asked = asked.join(sizes, "label").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    given = candidates.join(sizes, "label").withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), "id", "v"), F.col("slices")).cast("int"))
    block = F.xxhash64("label", "slice").alias("xb")
    own = searched(asked.select("id", "tag", "label", "v", "low", "high", block), given.select(*candidates.columns, block), True, positives)
    own = settle(own.groupBy("id", "tag").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("found_id").alias("positive_id"), "score"))).alias("own")))

    asked = anchors.join(own, ["id", "tag"]).withColumn("low", F.transform("own", lambda o: -_hundredth(-o["score"] * low)))
    asked = asked.withColumn("high", F.transform("own", lambda o: _hundredth(o["score"] * high)))
    asked = asked.select("id", "tag", "label", "v", "low", "high").mapInArrow(lambda x: floored(x, False, negatives), asked_as)
    asked = asked.withColumn("xb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    given = candidates.withColumn("xb", F.pmod(F.xxhash64(F.lit("block"), "id", "v"), F.lit(blocks)))
    other = searched(asked, given, False, negatives).withColumnRenamed("score", "negative_score").join(own, ["id", "tag"])
    positive = F.element_at("own", (F.col("w") + 1).cast("int"))
    return other.select(F.col("id").alias("anchor_id"), positive["positive_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                        F.col("found_id").alias("negative_id"), positive["score"].alias("positive_score"), "negative_score")
