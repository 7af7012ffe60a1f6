"""Latent factors of long feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenfold.functions import stats as S
from tokenfold.operators import blocked as B
from tokenfold.operators import genes as G
from tokenfold.operators import hotspots as H
from tokenfold.operators import summaries as Y
from tokenfold.operators import text as T
from tokenfold.operators.gram import gram
from tokenfold.session import keep, settle

TINY = 1e-12
#: Rounds after which a factorisation that has not settled is an error.
MOST_ROUNDS, MOST_ITERATIONS = 60, 200
#: Highest degree of a round's filter, and the most that it may lengthen a direction.
DEGREE, GROWTH = 6, 3e7
#: Features whose inner products the driver may hold, and numbers of a state that a task may carry.
NARROW, MOST_CARRIED = 512, 1 << 17


class NotConverged(RuntimeError):
    """The rounds that were allowed have not led to a stable result."""


def svd_state(features: DataFrame, k: int, extra: int | None = None, rounds: int | None = None, tolerance: float = 1e-3, seed: int = 42,
              cells: int = B.CELLS) -> DataFrame:
    """(feature, v array, s array): right singular vectors and singular values.

    Filtered subspace iteration: a round multiplies the sparse rows with a block
    of k + extra vectors and back, block by block (``blocked``), and the inner
    products that reach the driver give the best vectors inside the block's span.
    A Chebyshev polynomial of A'A then damps what lies below the block's smallest
    singular value. Rounds end when every wanted pair has a residual
    |A'A v - s^2 v| of at most ``tolerance`` times s times the largest s; if 60 rounds
    don't suffice, ``NotConverged`` is raised. With ``rounds`` given, that many are
    made at most, whatever the residual. Signs are fixed so that the largest entry
    of each vector is positive.

    With neither ``extra`` nor ``rounds`` given, a table of at most ``NARROW`` features is solved from
    their inner products, without rounds.
    """
    import numpy as np

    if extra is None and rounds is None:
        features = features.select("sample_id", "feature", F.col("value").cast("double").alias("value"))
        kept = keep(features.filter("sample_id is not null and feature is not null"))
        names = sorted(r["feature"] for r in kept.select("feature").distinct().limit(NARROW + 1).collect())
        state = _narrow_state(kept, names, k) if len(names) <= NARROW else svd_state(kept, k, max(64, k // 2), None, tolerance, seed, cells)
        kept.unpersist()
        return state
    extra = max(64, k // 2) if extra is None else extra
    x = B.Blocked.of(features, lambda n: max(1, min(k + extra, n)), cells=cells).standing()
    v, width = x.random(seed, lambda rng, shape: rng.standard_normal(shape)), x.width
    for done in range(1, (rounds or MOST_ROUNDS) + 1):
        values, basis = np.linalg.eigh(x.gram(v, x.column_blocks))
        ok = values > TINY * max(values[-1], TINY)
        turn = np.zeros_like(basis)
        turn[:, :ok.sum()] = basis[:, ok] / np.sqrt(values[ok])  # orthonormal columns, then zeros
        y = keep(x.times(v, turn))
        ritz, order = np.linalg.eigh(x.gram(y, x.row_blocks))
        ritz, order = np.maximum(ritz[::-1], 0.0), order[:, ::-1]
        z = settle(x.back(y))
        y.unpersist()
        take, square = min(k, int(ok.sum())), x.gram(z, x.column_blocks)
        residual = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", order, square, order) - ritz**2, 0.0))[:take]
        if (residual <= max(tolerance, 1e-7) * np.sqrt(np.maximum(ritz[0] * ritz[:take], TINY))).all():
            break
        if done < (rounds or MOST_ROUNDS):
            best = turn @ order
            v = _filtered(x, B.mapped(v, width, lambda m, best=best: m @ best), B.mapped(z, width, lambda m, order=order: m @ order), ritz)
    else:
        if rounds is None:
            raise NotConverged(f"{MOST_ROUNDS} rounds leave a residual of {(residual / np.sqrt(np.maximum(ritz[0] * ritz[:take], TINY))).max():.1e}")
    x.release()
    last = turn @ order[:, :take]
    wide = settle(B.named(x.columns, "feature", B.mapped(v, width, lambda m: m @ last), take, "v"))
    if not take:
        return wide.select("feature", "v", F.col("v").alias("s"))
    largest = [F.max_by(F.signum(F.col("v")[i]), F.struct(F.abs(F.round(F.col("v")[i], 9)), F.col("feature"))).alias(f"s{i}") for i in range(take)]
    signs = wide.agg(*largest).first()
    flip = F.array(*[F.lit(float(sign or 1.0)) for sign in signs])
    return wide.select("feature", F.zip_with("v", flip, lambda a, b: a * b).alias("v"), F.array(*[F.lit(float(s)) for s in np.sqrt(ritz[:take])]).alias("s"))


def _numbered(spark, names: list) -> DataFrame:
    """(feature, idx) of a short list, as rows that the planner knows the size of."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"feature": names, "idx": pa.array(range(len(names)), pa.int32())}))


def _narrow_state(x: DataFrame, names: list, k: int) -> DataFrame:
    """The state of :func:`svd_state` from the inner products of all features, which one pass adds up."""
    import numpy as np
    import pyarrow as pa

    n, spark = len(names), x.sparkSession
    take, kind = min(k, n), dict(x.dtypes)["feature"]
    schema = f"feature {kind}, v array<double>, s array<double>"
    if not n:
        return spark.createDataFrame([], schema)
    products = np.zeros((n, n))
    for r in gram(x.join(_numbered(spark, names), "feature").select("sample_id", "idx", "value")).collect():
        products[r["i"], r["j"]] = products[r["j"], r["i"]] = r["s"]
    values, vectors = np.linalg.eigh(products)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    take = min(take, int((values > TINY * max(values[0], TINY)).sum()))
    largest = [max(range(n), key=lambda i, c=vectors[:, c]: (abs(round(float(c[i]), 9)), names[i])) for c in range(take)]
    vectors = vectors[:, :take] * [np.sign(vectors[i, c]) or 1.0 for c, i in enumerate(largest)]
    s = np.sqrt(values[:take]).tolist()
    state = spark.createDataFrame(pa.table({"feature": names, "v": vectors.tolist(), "s": [s] * n}, pa.schema([
        ("feature", pa.array(names).type), ("v", pa.list_(pa.float64())), ("s", pa.list_(pa.float64()))])))
    return settle(state.select(F.col("feature").cast(kind).alias("feature"), "v", "s"))


def _filtered(x: B.Blocked, v: DataFrame, z: DataFrame, ritz) -> DataFrame:
    """Chebyshev filter of the vectors ``v``, with A'A v = ``z`` and Ritz values ``ritz``; columns keep about their lengths.

    The degree is the highest that keeps the largest direction from drowning the others in rounding. Where that is 1, or the
    span holds all of the matrix, it is one step of the power iteration.
    """
    import numpy as np

    width, middle = x.width, float(ritz[-1]) / 2
    if middle <= 1e-6 * ritz[0]:
        return z
    rate = np.arccosh(np.maximum((ritz - middle) / middle, 1.0))
    degree = int(min(DEGREE, np.log(2 * GROWTH) / max(rate[0], 1e-9)))
    if degree < 2:
        return z
    grown = np.cosh(degree * rate)
    old, new = settle(v), settle(B.weighted((1 / middle, z), (-1.0, v), width=width))
    for _ in range(degree - 1):
        y = keep(x.times(new))
        old, new = new, settle(B.weighted((2 / middle, x.back(y)), (-2.0, new), (-1.0, old), width=width))
        y.unpersist()
    return settle(B.mapped(new, width, lambda m: m / grown))


def _rows_times(features: DataFrame, state: DataFrame, change=None) -> DataFrame:
    """(sample_id, y array): a sample's entries times the state's rows, each block changed by ``change``."""
    width = int(state.agg(F.max(F.size("v"))).first()[0] or 0)
    if not width:
        return features.select("sample_id", F.array().cast("array<double>").alias("y")).limit(0)
    names = [r["feature"] for r in state.select("feature").limit(NARROW + 1).collect()]
    if len(names) <= NARROW and len(names) * width <= MOST_CARRIED:
        return _narrow_rows(features, state, width, change)
    columns, tall = B.tall_of(state, "feature", "v", width)
    x = B.Blocked.of(features, width, columns)
    y = x.times(tall)
    return B.named(x.rows, "sample_id", y if change is None else B.mapped(y, width, change), width, "y")


def _narrow_rows(features: DataFrame, state: DataFrame, width: int, change) -> DataFrame:
    """:func:`_rows_times` for a state that every task can carry: a sample's entries meet in one row."""
    import numpy as np
    import pyarrow as pa

    held = state.select("feature", "v").collect()
    dense, kind = np.array([r["v"] for r in held]), dict(features.dtypes)["sample_id"]
    index = _numbered(features.sparkSession, [r["feature"] for r in held])
    x = features.filter("sample_id is not null").join(index, "feature")
    packed = x.groupBy("sample_id").agg(F.collect_list(F.struct("idx", F.col("value").cast("double").alias("value"))).alias("e"))

    def rows(batches):
        for b in batches:
            e = b.column("e")
            flat, size = e.flatten(), e.value_lengths().to_numpy(zero_copy_only=False)
            at, value = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("idx", "value"))
            end = np.cumsum(size)
            y, step = np.zeros((len(size), width)), max(1, (1 << 20) // width)
            first = 0
            while first < len(size):
                begin = end[first] - size[first]
                last = max(first + 1, int(np.searchsorted(end, begin + step, "right")))
                part = slice(begin, end[last - 1])
                y[first:last] = np.add.reduceat(value[part, None] * dense[at[part]], end[first:last] - size[first:last] - begin)
                first = last
            y = y if change is None else change(y)
            sizes = pa.array(np.arange(0, (len(size) + 1) * width, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), pa.ListArray.from_arrays(sizes, pa.array(y.ravel()))], ["sample_id", "y"])

    return packed.mapInArrow(rows, f"sample_id {kind}, y array<double>")


def svd_apply(features: DataFrame, state: DataFrame) -> DataFrame:
    """Latent coordinates (sample_id, feature ``svd_i``, value) = row times V."""
    y = _rows_times(features, state).select("sample_id", F.posexplode("y").alias("i", "value"))
    return y.select("sample_id", F.concat(F.lit("svd_"), F.col("i").cast("string")).alias("feature"), "value")


def explained_variance(latent: DataFrame, features: DataFrame, samples: DataFrame) -> DataFrame:
    """(feature, variance, ratio) of each latent column over the total column variance."""
    n = S.total(samples, F.count("*"))

    def variance(df):
        g = df.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).withColumn("n", n)
        return g.select("feature", (F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2).alias("variance"))

    total = S.total(variance(features), F.sum("variance"))
    return variance(latent).withColumn("ratio", F.col("variance") / total)


def compress(token_features: DataFrame, f1: DataFrame, folds: DataFrame, held: int, k: int, min_df: int = 2) -> DataFrame:
    """DF filter, TF-IDF and SVD fitted without the held fold, plus scaled summary columns."""
    t = keep(T.token_tfidf(token_features, folds, held, min_df))
    train = folds.filter(F.col("fold") != held).select("sample_id")
    state = svd_state(t.join(train, "sample_id", "left_semi"), k)
    cols = [c for c in f1.columns if c != "sample_id"]
    scaled = Y.standardize(f1, Y.standardize_state(f1.join(train, "sample_id", "left_semi"), cols), cols)
    return svd_apply(t, state).unionByName(S.unpivot(scaled, ["sample_id"]).select("sample_id", "feature", "value"))


def _nonnegative(target, inner, steps: int):
    """Row factors for fixed modules: ``steps`` multiplicative updates from all ones."""
    import numpy as np

    w = np.ones_like(target)
    for _ in range(steps):
        w *= target / (w @ inner + TINY)
    return w


def _narrow_rounds(x: DataFrame, names: list, k: int, seed: int, iterations: int | None, steps: int, tolerance: float) -> DataFrame:
    """The rounds of :func:`nmf_state` for modules that every task can carry: a round is one pass over the samples."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    n, spark = len(names), x.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = x.join(_numbered(spark, names), "feature").groupBy("sample_id").agg(F.collect_list(F.struct("idx", "value")).alias("e"))
    packed = keep(packed.select("e"))
    total = x.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0

    def run(v, inner):
        def rows(batches):
            against, back, seen = np.zeros((k, k)), np.zeros((n, k)), False
            for batch in batches:
                e = batch.column("e")
                flat, size = e.flatten(), e.value_lengths().to_numpy(zero_copy_only=False)
                at, value = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("idx", "value"))
                end, first, step = np.cumsum(size), 0, max(1, (1 << 20) // k)
                while first < len(size):
                    begin = end[first] - size[first]
                    last = max(first + 1, int(np.searchsorted(end, begin + step, "right")))
                    part = slice(begin, end[last - 1])
                    y = np.add.reduceat(value[part, None] * v[at[part]], end[first:last] - size[first:last] - begin)
                    w, first, seen = _nonnegative(y, inner, steps), last, True
                    against += w.T @ w
                    of = np.repeat(np.arange(len(w)), size[last - len(w):last])
                    for c in range(k):
                        back[:, c] += np.bincount(at[part], weights=value[part] * w[of, c], minlength=n)
            if seen:
                m = np.ascontiguousarray(np.vstack([back, against]))
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId() % parts], pa.int64()),
                                                  pa.array([m.tobytes()], pa.binary())], ["b", "part", "m"])

        m = B._added(packed.mapInArrow(rows, "b int, part long, m binary"), parts * B.FAN_IN, k).first()
        both = np.zeros((n + k, k)) if m is None else B._matrix(bytes(m["m"]), k)
        return both[:n], both[n:]

    v, error = np.random.default_rng([seed, 0]).random((n, k)) + 0.1, None
    for _ in range(iterations or MOST_ITERATIONS):
        inner = v.T @ v
        back, against = run(v, inner)
        before, error = error, total - 2 * float((v * back).sum()) + float((inner * against).sum())
        for _ in range(steps):
            v = v * back / (v @ against + TINY)
        if iterations is None and before is not None and before - error <= tolerance * total:
            break
    else:
        if iterations is None:
            raise NotConverged(f"{MOST_ITERATIONS} rounds leave the error falling")
    packed.unpersist()
    kind = dict(x.dtypes)["feature"]
    state = spark.createDataFrame(pa.table({"feature": names, "v": v.tolist()}))
    return settle(state.select(F.col("feature").cast(kind).alias("feature"), "v"))


def nmf_state(features: DataFrame, k: int, seed: int = 42, iterations: int | None = None, steps: int = 20, tolerance: float = 1e-4,
              cells: int | None = None) -> DataFrame:
    """(feature, v array): non-negative modules of the whole matrix, its zeros included.

    Squared error, multiplicative updates. Given the modules a sample's factors
    follow from its own entries and the k x k inner products, so a round is one
    product with the rows and one back; modules stay a table. Rounds end when the
    squared error falls by less than ``tolerance`` of the matrix's squared norm; if 200 don't suffice,
    ``NotConverged`` is raised. With ``iterations`` given, that many are made.

    Unless ``cells`` is given, modules of at most ``NARROW`` features are carried by the tasks instead of standing in blocks.
    """
    import numpy as np
    import pyarrow as pa

    if cells is None:
        features = features.select("sample_id", "feature", F.col("value").cast("double").alias("value"))
        kept = keep(features)
        seen = [r["feature"] for r in kept.select("feature").distinct().limit(NARROW + 1).collect()]
        names = [None] * (None in seen) + sorted(f for f in seen if f is not None)  # as in the blocks: a null name has a module row, but no entries
        narrow = len(names) <= NARROW and len(names) * k <= MOST_CARRIED and any(f is not None for f in names)
        state = _narrow_rounds(kept.filter("sample_id is not null and feature is not null"), names, k, seed, iterations, steps, tolerance) if narrow else nmf_state(kept, k, seed, iterations, steps, tolerance, B.CELLS)
        kept.unpersist()
        return state
    x = B.Blocked.of(features, k, cells=cells).standing()
    total = x.entries.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
    v = x.random(seed, lambda rng, shape: rng.random(shape) + 0.1)
    error = None
    for _ in range(iterations or MOST_ITERATIONS):
        inner = x.gram(v, x.column_blocks)
        w = keep(B.mapped(x.times(v), k, lambda y: _nonnegative(y, inner, steps)))
        against = x.gram(w, x.row_blocks)

        def update(own: pa.Table, z: pa.Table) -> pa.Table:
            a, b = B._matrix(own.column("m")[0], k), B._matrix(z.column("m")[0], k)
            met, new = float((a * b).sum()), a
            for _ in range(steps):
                new = new * b / (new @ against + TINY)
            return B._block(own.column("b")[0].as_py(), new).append_column("met", pa.array([met]))

        z = x.back(w).withColumnRenamed("b", "of")
        both = settle(v.groupBy("b").cogroup(z.groupBy("of")).applyInArrow(update, "b int, m binary, met double"))
        w.unpersist()
        before, error = error, total - 2 * (both.agg(F.sum("met")).first()[0] or 0.0) + float((inner * against).sum())
        v = both.select("b", "m")
        if iterations is None and before is not None and before - error <= tolerance * total:
            break
    else:
        if iterations is None:
            raise NotConverged(f"{MOST_ITERATIONS} rounds leave the error falling")
    x.release()
    return settle(B.named(x.columns, "feature", v, k, "v"))


def nmf_apply(features: DataFrame, state: DataFrame, steps: int = 60) -> DataFrame:
    """Module weights (sample_id, module, value) of samples, seen or not, for learnt modules."""
    width = int(state.agg(F.max(F.size("v"))).first()[0] or 0)
    columns, tall = B.tall_of(state, "feature", "v", max(1, width))
    inner = B.Blocked(state, state, columns, 1, 1, max(1, width)).gram(tall, (columns.agg(F.max("b")).first()[0] or 0) + 1)
    w = _rows_times(features, state, lambda y: _nonnegative(y, inner, steps))
    return w.select("sample_id", F.posexplode("y").alias("module", "value"))


def nmf(features: DataFrame, k: int, seed: int = 42, iterations: int | None = None) -> DataFrame:
    """Non-negative modules (sample_id, module, value) of the given samples."""
    return nmf_apply(features, nmf_state(features, k, seed, iterations))


def genes_burden_hotspot(events: DataFrame, samples: DataFrame, minimum: int = 5, limit: int = 384) -> DataFrame:
    """Gene flags, burden, hotspot flags and hotspot count as one feature table."""
    h = settle(H.learn_hotspots(events, minimum, limit))
    one = F.lit(1.0).alias("value")
    burden = Y.burden(events, samples).select("sample_id", "burden", "burden_log1p", "burden_rate")
    hits = H.apply_hotspots(events, h).select("sample_id", F.concat_ws(":", "gene", "token").alias("feature"), one)
    return G.assemble({
        "gene": G.gene_presence(events).select("sample_id", F.col("gene").alias("feature"), one),
        "summary": S.unpivot(burden, ["sample_id"]), "hotspot": hits,
        "hotspots": S.unpivot(H.hotspot_count(events, h, samples), ["sample_id"])})
