"""Algebra on array columns (feature vectors of a fixed length)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row. What a lambda takes from outside is computed anew for
    each item, so that a mean within a variance within a transform costs the cube of the length."""
    return F.transform(F.array(value), then)[0]


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(a: Column, c) -> Column:
    return F.transform(a, lambda x: x * c)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(mul(a, b), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def linear(a: Column, weight: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """weight (rows: outputs) times a, plus bias; weights are literals and fold at planning."""
    rows = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weight])
    out = F.transform(rows, lambda r: dot(r, a))
    return out if bias is None else add(out, F.array(*[F.lit(float(b)) for b in bias]))


def linear_part(a: Column, weight: Sequence[Sequence[float]], start: Column) -> Column:
    """The part of linear() that a, as the places from `start` (1 the first) of a longer vector, gives."""
    rows = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weight])
    return F.transform(rows, lambda r: dot(F.slice(r, start, F.size(a)), a))


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x < 0, slope * x).otherwise(x)


def elu(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(x > 0, x).otherwise(F.expm1(x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(a: Column) -> Column:
    e = bound(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return bound(e, lambda e: bound(total(e), lambda s: F.transform(e, lambda x: x / s)))


def log_softmax(a: Column) -> Column:
    rest = bound(F.array_max(a), lambda top: top + F.log(total(F.transform(a, lambda x: F.exp(x - top)))))
    return bound(rest, lambda rest: F.transform(a, lambda x: x - rest))


def argmax(a: Column) -> Column:
    """The place of the largest number, the first of equal ones."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def l2_normalise(a: Column) -> Column:
    return bound(a, lambda a: bound(F.sqrt(dot(a, a)), lambda norm: F.transform(a, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))))


def row_normalise(a: Column) -> Column:
    """x / sum(x), 0 where the sum is 0."""
    return bound(a, lambda a: bound(total(a), lambda s: F.transform(a, lambda x: F.when(s != 0, x / s).otherwise(0.0))))


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    def spread(a: Column) -> Column:
        return bound(mean(a), lambda m: F.struct(m.alias("m"), F.sqrt(mean(F.transform(a, lambda x: (x - m) * (x - m))) + eps).alias("s")))

    return bound(a, lambda a: bound(spread(a), lambda k: F.transform(a, lambda x: (x - k["m"]) / k["s"])))


def time_encoding(t: Column, dim: int) -> Column:
    """cos(t * w) with w from 1 down to 1e-9 on a log scale."""
    w = [10 ** (-9 * j / max(1, dim - 1)) for j in range(dim)]
    return F.transform(F.array(*[F.lit(float(x)) for x in w]), lambda x: F.cos(t * x))


def time_projection(h: Column, ts: Column, set_at: Column, weight: Sequence[float]) -> Column:
    """h * (1 + weight * (ts - set_at) / (ts + 1)): states drift with the time since they were set."""
    gap = (ts - set_at) / (ts + 1)
    return mul(h, F.transform(F.array(*[F.lit(float(x)) for x in weight]), lambda w: 1 + w * gap))


def squeeze(a: Column) -> Column:
    """The only item of a dimension of one."""
    return a[0]


def reshape(a: Column, rows: int, cols: int) -> Column:
    """A flat vector as rows of `cols` numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(a, i * cols + 1, cols))


def mean_rows(a: Column, rows: int) -> Column:
    """The element-wise mean of nested rows (heads)."""
    return scale(F.aggregate(F.slice(a, 2, F.size(a)), a[0], add), 1.0 / rows)


def drop_out(a: Column, p: float, training: bool, key: Column, seed: int = 0) -> Column:
    """Identity unless training; then a mask hashed from the row's key and the place."""
    if not training:
        return a
    keep = lambda x, i: F.when(F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(1000)) >= int(1000 * p), x / (1 - p)).otherwise(0.0)
    return F.transform(a, keep)


def reduce_vectors(rows: DataFrame, key: list[str], x: str, dim: int, how: str = "sum") -> DataFrame:
    """Element-wise sum, mean or max of vectors by key: one aggregate for each place, combined before
    the shuffle, so a key ships one vector for each task."""
    f = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    parts = rows.groupBy(*key).agg(*[f(F.col(x)[i]).alias(f"_{i}") for i in range(dim)])
    return parts.select(*key, F.array(*[F.col(f"_{i}") for i in range(dim)]).alias(x))


def long_form(rows: DataFrame, key: list[str], x: str, digits: int = 6) -> DataFrame:
    """(key, pos, val) of vectors, rounded."""
    return rows.select(*key, F.posexplode(x).alias("pos", "v")).select(*key, F.col("pos").cast("long").alias("pos"), F.round("v", digits).alias("val"))
