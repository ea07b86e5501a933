"""Reductions: an empty sum or xor is 0 and an empty maximum is minus infinity, and the kept dimensions stay total.

What a line's values need from the whole line (softmax, norms, centring) is a window where the box proves lines short, and
a pre-aggregated table joined back where they are long: no task ever holds a long line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.intmath import positive_div, trunc_div
from ..functions.interval import Box
from ..sources.frame import ArrayFrame, domain
from .elementwise import BROADCAST_ROWS, small, zip_with

SHORT = 4096  # values of a line that a window may hold
BLOCK = 1024  # rows and columns of a block of a product


def _restore(a: ArrayFrame, empty) -> ArrayFrame:
    """Coordinates that no value reached get the empty case; needed only where the source is sparse."""
    df = domain(a.df.sparkSession, a.box).join(a.df, a.dims, "left") if a.dims else a.df
    return ArrayFrame(df.select(*a.dims, F.coalesce("v", F.lit(empty)).alias("v")), a.box)


def total(a: ArrayFrame, *over: str) -> ArrayFrame:
    """Sum over dimensions."""
    keep = [d for d in a.dims if d not in over]
    got = ArrayFrame(a.df.groupBy(*keep).agg(F.sum("v").alias("v")), a.box.without(*over))
    return _restore(got, 0) if a.sparse or a.box.empty or not keep else got


def greatest(a: ArrayFrame, *over: str) -> ArrayFrame:
    keep = [d for d in a.dims if d not in over]
    got = ArrayFrame(a.df.groupBy(*keep).agg(F.max("v").alias("v")), a.box.without(*over))
    return _restore(got, float("-inf")) if a.sparse or a.box.empty or not keep else got


def reduce(a: ArrayFrame, f: Callable[[Column], Column], empty, *over: str) -> ArrayFrame:
    """Any aggregate of the values; empty: its value where there are none."""
    keep = [d for d in a.dims if d not in over]
    got = ArrayFrame(a.df.groupBy(*keep).agg(f(F.col("v")).alias("v")), a.box.without(*over))
    return _restore(got, empty) if a.sparse or a.box.empty or not keep else got


def grains(a: ArrayFrame, *kept: list[str]) -> DataFrame:
    """(grain, dimensions..., v): sums over several sets of kept dimensions in one pass over the source; a dimension that
    a set does not keep is 0."""
    every = [d for d in a.dims if any(d in k for k in kept)]
    # Each row goes to every set; partial sums meet before the shuffle.
    sets = F.array(*[F.struct(F.lit(i).cast("long").alias("grain"), *[(F.col(d) if d in k else F.lit(0).cast("long")).alias(d) for d in every]) for i, k in enumerate(kept)])
    return a.df.select(F.explode(sets).alias("s"), "v").select("s.*", "v").groupBy("grain", *every).agg(F.sum("v").alias("v"))


def two_grains(a: ArrayFrame, fine: list[str], coarse: list[str]) -> tuple[ArrayFrame, ArrayFrame]:
    """Sums over two sets of kept dimensions, the coarse one from the fine one."""
    one = total(a, *[d for d in a.dims if d not in fine])
    return one, total(one, *[d for d in fine if d not in coarse])


def _bits(v: Column, bits: int) -> Column:
    return v.bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long"))


def xor(a: ArrayFrame, *over: str, bits: int = 32) -> ArrayFrame:
    return reduce(a, lambda v: F.bit_xor(_bits(v, bits)), 0, *over)


def xor_required(out: Box, inputs: list[tuple[ArrayFrame, dict[str, tuple[int, int]]]], bits: int = 32) -> ArrayFrame:
    """Xor of every element that an output needs of every input, cut to so many bits.

    taps: how far an output reaches in a dimension; a dimension that the output lacks is needed whole, and one that an
    input lacks is the same for all.  Every value goes to the outputs that need it; nothing is joined.
    """
    parts = []
    for a, taps in inputs:
        df = a.df
        whole = [d for d in a.dims if d not in out]
        if whole:
            df = df.groupBy(*[d for d in a.dims if d in out]).agg(F.bit_xor("v").alias("v"))
        for d in out:
            if d not in a.box:
                df = df.withColumn(d, F.explode(F.sequence(F.lit(out[d].min).cast("long"), F.lit(out[d].max).cast("long"))))
            elif taps.get(d, (0, 0)) != (0, 0):
                df = df.withColumn(d, F.explode(F.sequence(F.col(d) - taps[d][1], F.col(d) - taps[d][0])))
        parts.append(df.where(out.holds()).select(*out, _bits(F.col("v"), bits).alias("v")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return ArrayFrame(both.groupBy(*out).agg(F.bit_xor("v").alias("v")), out)


def _known(a: ArrayFrame, along: str, **stats: Column) -> DataFrame:
    """The rows with aggregates of their line."""
    keep = [d for d in a.dims if d != along]
    if a.box[along].bounded and a.box[along].extent <= SHORT:
        w = Window.partitionBy(*keep)
        return a.df.select(*a.df.columns, *[s.over(w).alias(n) for n, s in stats.items()])
    line = ArrayFrame(a.df.groupBy(*keep).agg(*[s.alias(n) for n, s in stats.items()]), a.box.without(along))
    return a.df.join(small(line), keep) if keep else a.df.crossJoin(F.broadcast(line.df))  # one row


def softmax(a: ArrayFrame, along: str) -> ArrayFrame:
    """Stable: the greatest of a line is taken off first."""
    e = sum_exp(a, along)[0]
    return ArrayFrame(_known(e, along, t=F.sum("v")).select(*e.dims, (F.col("v") / F.col("t")).alias("v")), e.box)


def sum_exp(a: ArrayFrame, along: str) -> tuple[ArrayFrame, ArrayFrame]:
    """Two outputs: exp(v - greatest of the line), and the sum of that over the line."""
    e = ArrayFrame(_known(a, along, m=F.max("v")).select(*a.dims, F.exp(F.col("v") - F.col("m")).alias("v")), a.box)
    return e, total(e, along)


def normalize(e: ArrayFrame, totals: ArrayFrame) -> ArrayFrame:
    """Values by their line's total, which comes from another stage."""
    return zip_with(lambda v, t: v / t, e, totals)


def l2_normalize(a: ArrayFrame, along: str) -> ArrayFrame:
    """A row of zeros has no direction: its values are not a number."""
    norm = F.sqrt(F.col("t"))
    df = _known(a, along, t=F.sum(F.col("v") * F.col("v")))
    return ArrayFrame(df.select(*a.dims, F.when(norm == 0, F.lit(float("nan"))).otherwise(F.col("v") / norm).alias("v")), a.box)


def centered(a: ArrayFrame, along: str) -> ArrayFrame:
    """v - (sum along the dimension + 1)."""
    return ArrayFrame(_known(a, along, t=F.sum("v")).select(*a.dims, (F.col("v") - (F.col("t") + 1)).alias("v")), a.box)


def matmul(a: ArrayFrame, b: ArrayFrame, block: int = BLOCK, most: int = BROADCAST_ROWS) -> ArrayFrame:
    """a(i, k), b(k, j): joined on the shared dimension and summed, with partial sums before the shuffle.

    A right side of at most so many values is broadcast.  Otherwise both sides are dealt to blocks of i, j and k, so that the number of tasks
    grows with all three and not with the values of k alone: a row of a goes to each block of j, one of b to each of i.
    """
    (k,) = [d for d in a.dims if d in b.box]
    (i,), (j,) = [d for d in a.dims if d != k], [d for d in b.dims if d != k]
    common = a.box[k] & b.box[k]
    left = a.df.where(common.holds(F.col(k))).withColumnRenamed("v", "a")
    right = ArrayFrame(b.df.where(common.holds(F.col(k))), b.box.with_(**{k: common}))
    on = [k]
    if right.box.volume > most:
        all_i, all_j = (F.explode(F.sequence(F.lit(x.min // block).cast("long"), F.lit(x.max // block).cast("long"))) for x in (a.box[i], b.box[j]))
        left = left.withColumn("_i", positive_div(F.col(i), block)).withColumn("_j", all_j)
        right = ArrayFrame(right.df.withColumn("_j", positive_div(F.col(j), block)).withColumn("_i", all_i), right.box)
        on = ["_i", "_j", k]
    other = F.broadcast(right.df) if on == [k] else right.df
    got = left.join(other.withColumnRenamed("v", "b"), on).groupBy(i, j).agg(F.sum(F.col("a") * F.col("b")).alias("v"))
    return ArrayFrame(got, Box({i: a.box[i], j: b.box[j]}))


def box_downsample(a: ArrayFrame) -> ArrayFrame:
    """(sum of 2 by 2, plus 2) / 4, truncating as kernels do."""
    got = a.df.groupBy(*[positive_div(F.col(d), 2).alias(d) for d in a.dims]).agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    box = Box({d: i.floordiv(2) for d, i in a.box.items()})
    return ArrayFrame(got.where(F.col("n") == 1 << len(a.dims)).select(*a.dims, trunc_div(F.col("s") + 2, 4).alias("v")), box)
