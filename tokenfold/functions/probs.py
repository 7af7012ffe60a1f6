"""Row-wise math on probability arrays (index = class id, no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def let(expr: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.transform(F.array(expr), fn)[0]


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def normalize(p: Column) -> Column:
    """Divide by the sum."""
    return let(p, lambda a: let(total(a), lambda t: F.transform(a, lambda x: x / t)))


def clip(p: Column, low: float = 1e-12) -> Column:
    return F.transform(p, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(1.0)))


def softmax(score: Column, temperature: float | Column = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return let(score, lambda a: let(F.array_max(a), lambda top: normalize(F.transform(a, lambda x: F.exp((x - top) / t)))))


def log_clip(p: Column) -> Column:
    return F.transform(p, lambda x: F.ln(F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0))))


def calibrate(p: Column, temperature: float | Column) -> Column:
    """Temperature scaling of probabilities: softmax(ln p / T) = normalised p^(1/T)."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return normalize(F.transform(p, lambda x: F.pow(F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0)), 1 / t)))


def mix(p: Column, q: Column, w: float | Column) -> Column:
    """(1 - w) p + w q, not renormalised."""
    w = w if isinstance(w, Column) else F.lit(float(w))
    return F.zip_with(p, q, lambda a, b: (1 - w) * a + w * b)


def blend(p: Column, q: Column, w: float | Column) -> Column:
    return normalize(mix(p, q, w))


def weighted_sum(arrays: Sequence[Column], weights: Sequence[float | Column]) -> Column:
    def scaled(a, w):
        w = w if isinstance(w, Column) else F.lit(float(w))
        return F.transform(a, lambda x: x * w)

    parts = [scaled(a, w) for a, w in zip(arrays, weights)]
    return reduce(lambda u, v: F.zip_with(u, v, lambda x, y: x + y), parts)


def argmax(p: Column) -> Column:
    """Class id of the largest entry, the lowest id on ties."""
    return let(p, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def top_two(p: Column) -> Column:
    """Struct (top1, top2, gap) with ties to the lower id."""
    def rest(a, first):
        return F.transform(a, lambda x, i: F.when(i == first, F.lit(-1e300)).otherwise(x))

    def pick(a, first):
        return let(rest(a, first), lambda r: F.struct(
            first.alias("top1"), (F.array_position(r, F.array_max(r)) - 1).cast("int").alias("top2"), (F.array_max(a) - F.array_max(r)).alias("gap")))

    return let(p, lambda a: let((F.array_position(a, F.array_max(a)) - 1).cast("int"), lambda first: pick(a, first)))


def at(p: Column, i: int | Column) -> Column:
    """Entry of a class id, null outside."""
    return F.get(p, i if isinstance(i, Column) else F.lit(i))


def put(p: Column, values: dict) -> Column:
    """Replace entries: ``values`` maps a class id (int or column) to its new value."""
    def entry(x, i):
        out = None
        for k, v in values.items():
            out = F.when(i == k, v) if out is None else out.when(i == k, v)
        return out.otherwise(x)

    return F.transform(p, entry)


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.ln(x))


def adjust_prior(p: Column, prior: Column, gamma: float | Column, temperature: float | Column) -> Column:
    """p^(1/T) / prior^gamma, renormalised."""
    g = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    raw = F.zip_with(clip(p), clip(prior), lambda x, q: F.pow(x, 1 / t) / F.pow(q, g))
    return normalize(raw)


def pair_right(p: Column, left: int, right: int, temperature: float, offset: float) -> Column:
    """Right share of a pair: sigmoid(ln(right/left)/T - offset)."""
    lo, hi = (F.greatest(at(p, i), F.lit(1e-12)) for i in (left, right))
    return 1 / (1 + F.exp(-((F.ln(hi) - F.ln(lo)) / temperature - offset)))


def split_pair(p: Column, left: int, right: int, share: Column, active: Column) -> Column:
    """Keep the pair's mass and give the right class ``share`` of it where active."""
    mass = at(p, left) + at(p, right)
    return F.when(active, put(p, {left: mass * (1 - share), right: mass * share})).otherwise(p)


def base_right(p: Column, left: int, right: int) -> Column:
    return at(p, right) / F.greatest(at(p, left) + at(p, right), F.lit(1e-12))
