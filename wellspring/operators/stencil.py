"""Stencils.

A rectangle sum is separable: one range window a dimension, each partitioned by the others and, where a line is long, by
chunks of it with a halo, so that the number of tasks grows with every dimension.  Ranges, not rows, so that gaps in the
coordinates stay gaps.  Only outputs with full support are given, as in a pipeline whose output box is the input's without
its halo; pad first to keep the box.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.interval import Box, Interval
from ..sources.frame import ArrayFrame
from .reindex import copy, identity
from .windows import CHUNK, dealt


def required(out: Box, taps: dict[str, tuple[int, int]]) -> Box:
    """The input box that an output box needs."""
    return Box({d: i + Interval(*taps[d]) if d in taps else i for d, i in out.items()})


def rectangle_sum(a: ArrayFrame, taps: dict[str, tuple[int, int]], chunk: int = CHUNK) -> ArrayFrame:
    """taps: dimension to (first, last) offset."""
    df, n = a.df.withColumn("n", F.lit(1).cast("long")), 1
    for d, (low, high) in taps.items():
        df, keys, own = dealt(df, a.box, d, low, high, chunk)
        w = Window.partitionBy(*[e for e in a.dims if e != d], *keys).orderBy(d).rangeBetween(low, high)
        df = df.select(*a.dims, *keys, F.sum("v").over(w).alias("v"), F.sum("n").over(w).alias("n")).where(own).drop(*keys)
        n *= high - low + 1
    box = Box({d: Interval(i.min - taps[d][0], i.max - taps[d][1]) if d in taps else i for d, i in a.box.items()})
    return ArrayFrame(df.where(F.col("n") == n).select(*a.dims, "v"), box)


def square_sum(a: ArrayFrame, radius: int, x: str = "x", y: str = "y") -> ArrayFrame:
    return rectangle_sum(a, {x: (-radius, radius), y: (-radius, radius)})


def chunked_sum(a: ArrayFrame, d: str, low: int, high: int, chunk: int = CHUNK) -> ArrayFrame:
    """A sum along one dimension."""
    return rectangle_sum(a, {d: (low, high)}, chunk)


def scatter_sum(a: ArrayFrame, taps: list[dict[str, int]], weights: list[int] | None = None) -> ArrayFrame:
    """Any taps with weights: each value goes to the outputs that read it, and partial sums meet."""
    rows = [F.struct(*[F.lit(-t.get(d, 0)).cast("long").alias(f"_{d}") for d in a.dims], F.lit((weights or [1] * len(taps))[i]).cast("long").alias("_w")) for i, t in enumerate(taps)]
    df = a.df.withColumn("t", F.explode(F.array(*rows)))
    got = df.groupBy(*[(F.col(d) + F.col(f"t._{d}")).alias(d) for d in a.dims]).agg(F.sum(F.col("v") * F.col("t._w")).alias("v"), F.count("*").alias("n"))
    box = Box({d: Interval(i.min - min(t.get(d, 0) for t in taps), i.max - max(t.get(d, 0) for t in taps)) for d, i in a.box.items()})
    return ArrayFrame(got.where((F.col("n") == len(taps)) & box.holds()).select(*a.dims, "v"), box)


def padded_sum(a: ArrayFrame, radius: int, pad: int, x: str = "x", y: str = "y") -> ArrayFrame:
    """The box stays: what lies outside counts as the pad."""
    taps = {x: (-radius, radius), y: (-radius, radius)}
    return rectangle_sum(copy(a, identity(a.box), required(a.box, taps), pad), taps)


def pyramid_up(fine: ArrayFrame, coarse: ArrayFrame) -> ArrayFrame:
    """The four coarse values around a fine one, summed, plus the fine one.

    Coarse coordinates are floor(x / 2) and floor((x + 1) / 2); each fine value is dealt to its four, and one equi-join
    brings the values.
    """
    taps = F.explode(F.array(*[F.struct(*[F.lit(k >> i & 1).cast("long").alias(d) for i, d in enumerate(fine.dims)]) for k in range(1 << len(fine.dims))]))
    asked = fine.df.withColumnRenamed("v", "f").withColumn("t", taps)
    asked = asked.select(*fine.dims, "f", *[F.expr(f"({d} + t.{d} - pmod({d} + t.{d}, 2)) div 2").alias(f"_{d}") for d in fine.dims])
    src = coarse.df.select(*[F.col(d).alias(f"_{d}") for d in coarse.dims], F.col("v").alias("c"))
    got = asked.join(src, [f"_{d}" for d in fine.dims]).groupBy(*fine.dims).agg((F.sum("c") + F.max("f")).alias("v"), F.count("*").alias("n"))
    box = Box({d: i & Interval(coarse.box[d].min * 2, coarse.box[d].max * 2) for d, i in fine.box.items()})
    return ArrayFrame(got.where(F.col("n") == 1 << len(fine.dims)).select(*fine.dims, "v"), box)
