"""Maps over arrays and the equi-joins that maps of several arrays are."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.interval import Box, Interval
from ..sources.frame import ArrayFrame
from .windows import dealt

BROADCAST_ROWS = 100_000  # an array of at most so many coordinates may be broadcast; its box proves the bound


def small(a: ArrayFrame):
    """The frame, marked for broadcast if its box is small enough."""
    return F.broadcast(a.df) if a.box.volume <= BROADCAST_ROWS else a.df


def apply(a: ArrayFrame, f: Callable[[Column], Column]) -> ArrayFrame:
    got = a.value(f(F.col("v")))
    return ArrayFrame(got.df, got.box, got.sparse, a.origin, lambda v: f(a.of_origin(v)), a.shift)


def formula(a: ArrayFrame, f: Callable[..., Column]) -> ArrayFrame:
    """f sees the value and then the coordinates."""
    return a.value(f(F.col("v"), *[F.col(d) for d in a.dims]))


def add_1(a: ArrayFrame) -> ArrayFrame:
    return apply(a, lambda v: v + 1)


def multiply_2(a: ArrayFrame) -> ArrayFrame:
    return apply(a, lambda v: v * 2)


def square(a: ArrayFrame) -> ArrayFrame:
    return apply(a, lambda v: v * v)


def reciprocal_sqrt(a: ArrayFrame) -> ArrayFrame:
    """Zero gives infinity."""
    return apply(a, lambda v: F.when(v == 0, F.lit(float("inf"))).otherwise(1 / F.sqrt(v.cast("double"))))


def power(v: Column, n: int) -> Column:
    """By repeated squaring."""
    out = None
    while n:
        if n & 1:
            out = v if out is None else out * v
        v, n = v * v, n >> 1
    return F.lit(1) if out is None else out


def horner(v: Column, coefficients: list[int]) -> Column:
    """Coefficients from the highest power down."""
    out = F.lit(coefficients[0]).cast("long")
    for c in coefficients[1:]:
        out = out * v + c
    return out


def zip_with(f: Callable[..., Column], *arrays: ArrayFrame) -> ArrayFrame:
    """f over the values of arrays at equal coordinates.

    An operand may lack dimensions of the first: it is broadcast along them.  The result's box is the common one, and
    each operand is cut to it before it is joined.  Arrays of one origin are not joined: they are one projection of it, or
    one window where they are moved against each other along one dimension.
    """
    first = arrays[0]
    box = Box(first.box)
    for a in arrays[1:]:
        box = box & a.box
    if all(a.origin is first.origin and a.dims == first.dims for a in arrays):
        away = [dict(a.shift) for a in arrays]
        moved = {d for s in away for d in first.dims if s.get(d, 0) != away[0].get(d, 0)}
        if len(moved) <= 1:
            return _same_origin(f, arrays, away, moved, box)
    out = first.df.where(box.holds()).withColumnRenamed("v", "v0")
    for i, a in enumerate(arrays[1:], 1):
        own = ArrayFrame(a.df.where(Box({d: box[d] for d in a.dims}).holds()).withColumnRenamed("v", f"v{i}"), Box({d: box[d] for d in a.dims}))
        out = out.join(small(own), a.dims) if a.dims else out.crossJoin(F.broadcast(own.df))  # a scalar: one row
    return ArrayFrame(out.select(*box, f(*[F.col(f"v{i}") for i in range(len(arrays))]).alias("v")), box)


def _same_origin(f: Callable[..., Column], arrays: tuple[ArrayFrame, ...], away: list[dict[str, int]], moved: set[str], box: Box) -> ArrayFrame:
    first, dims = arrays[0], arrays[0].dims
    df = first.origin.select(*[(F.col(d) + F.lit(away[0].get(d, 0)).cast("long")).alias(d) for d in dims], "v")
    if not moved:
        return ArrayFrame(df.where(box.holds()).select(*box, f(*[a.of_origin(F.col("v")) for a in arrays]).alias("v")), box, first.sparse)
    (d,) = moved
    steps = [away[0].get(d, 0) - s.get(d, 0) for s in away]  # an array's value stands so far on from the first's
    reach = box.with_(**{d: (box[d] + Interval(min(steps), max(steps))) | box[d]})
    df, keys, own = dealt(df.where(reach.holds()), reach, d, min(steps), max(steps))
    over = [Window.partitionBy(*[e for e in dims if e != d], *keys).orderBy(d).rangeBetween(k, k) for k in steps]
    df = df.select(*dims, *keys, *[F.struct(F.first("v").over(w).alias("v"), F.count(F.lit(1)).over(w).alias("n")).alias(f"s{i}") for i, w in enumerate(over)])
    there = own & box.holds()
    for i in range(len(arrays)):
        there = there & (F.col(f"s{i}.n") > 0)
    return ArrayFrame(df.where(there).select(*box, f(*[a.of_origin(F.col(f"s{i}.v")) for i, a in enumerate(arrays)]).alias("v")), box, first.sparse)


def subtract(a: ArrayFrame, b: ArrayFrame) -> ArrayFrame:
    return zip_with(lambda x, y: x - y, a, b)


def multiply(a: ArrayFrame, b: ArrayFrame) -> ArrayFrame:
    return zip_with(lambda x, y: x * y, a, b)


def exp_series(v: Column, terms: int) -> Column:
    """1 + v + v^2 / 2 + ... by Horner's rule."""
    out = F.lit(1.0)
    for k in range(terms - 1, 0, -1):
        out = 1.0 + v / k * out
    return out


def call(a: ArrayFrame, f: Callable[..., int], *coordinates: str) -> ArrayFrame:
    """A user's pure scalar function of the value and some coordinates, in Arrow batches; the slow path, for what columns
    cannot say."""
    @F.pandas_udf("long")
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series([f(*own) for own in x.itertuples(index=False)], dtype="int64")

    return a.value(run(F.struct("v", *coordinates)))


def require(a: ArrayFrame, holds: Callable[[Column], Column], message: str) -> ArrayFrame:
    """The array, whose evaluation fails with the message where a value does not hold."""
    ok = holds(F.col("v"))
    return a.value(F.when(ok, F.col("v")).otherwise(F.raise_error(F.lit(message)).cast("long")))


def outer_product(a: ArrayFrame, b: ArrayFrame) -> ArrayFrame:
    """c(i, j) = a(i) * b(j); the dimensions' names must differ."""
    got = a.df.withColumnRenamed("v", "v0").crossJoin(small(b).withColumnRenamed("v", "v1"))
    box = Box({**a.box, **b.box})
    return ArrayFrame(got.select(*box, (F.col("v0") * F.col("v1")).alias("v")), box)
