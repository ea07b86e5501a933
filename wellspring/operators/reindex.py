"""The copy family: out[d] = src[map(d)], or a pad where the source has nothing.

Maps are first-class and compose on the driver, so that a chain of copies costs one projection.  A map that can be
inverted becomes a projection of the source; any other becomes a join of the output's coordinates with the source.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intmath import positive_div, positive_mod
from ..functions.interval import Box, Interval, point
from ..sources.frame import ArrayFrame, domain
from .elementwise import small


@dataclass(frozen=True)
class Affine:
    """scale * dim + offset of one output dimension; without a dimension, a constant."""

    dim: str | None
    scale: int = 1
    offset: int = 0

    def column(self) -> Column:
        return F.lit(self.offset).cast("long") if self.dim is None or self.scale == 0 else F.col(self.dim) * self.scale + self.offset

    def image(self, out: Box) -> Interval:
        return point(self.offset) if self.dim is None else out[self.dim] * self.scale + self.offset

    def after(self, inner: Affine) -> Affine:
        """This map of what inner gives."""
        return Affine(inner.dim, self.scale * inner.scale, self.scale * inner.offset + self.offset)


Map = dict[str, Affine]


def compose(first: Map, then: Map) -> Map:
    """first: source by middle coordinates; then: middle by output coordinates."""
    return {d: a.after(then[a.dim]) if a.dim is not None else a for d, a in first.items()}


def required(maps: Map, out: Box) -> Box:
    """The part of the source that an output box needs."""
    return Box({d: a.image(out) for d, a in maps.items()})


def _invertible(maps: Map) -> bool:
    used = [a.dim for a in maps.values() if a.dim is not None and a.scale != 0]
    return len(used) == len(set(used))


def spread(df: DataFrame, dims: Box) -> DataFrame:
    """Repeat rows along new dimensions."""
    for d, i in dims.items():
        df = df.limit(0).withColumn(d, F.lit(0).cast("long")) if i.empty else df.withColumn(d, F.explode(F.sequence(F.lit(i.min).cast("long"), F.lit(i.max).cast("long"))))
    return df


def pull(src: ArrayFrame, maps: Map, out: Box) -> ArrayFrame:
    """Without padding: rows of the output that the source covers."""
    df = src.df.where((src.box & required(maps, out)).holds()).select(*[F.col(d).alias(f"_{d}") for d in src.dims], "v")
    if not _invertible(maps):
        wanted = domain(src.df.sparkSession, out).select(*out, *[maps[d].column().alias(f"_{d}") for d in src.dims])
        return ArrayFrame(wanted.join(df, [f"_{d}" for d in src.dims]).select(*out, "v"), out)
    got: dict[str, Column] = {}
    for d, a in maps.items():
        s = F.col(f"_{d}")
        if a.dim is None or a.scale == 0:
            df = df.where(s == a.offset)
        else:
            k, moved = abs(a.scale), (s - a.offset) * (1 if a.scale > 0 else -1)
            if k > 1:
                df = df.where(positive_mod(moved, k) == 0)
            got[a.dim] = positive_div(moved, k) if k > 1 else moved
    df = df.select(*[c.alias(d) for d, c in got.items()], "v")
    df = df.where(Box({d: out[d] for d in got}).holds())
    return ArrayFrame(spread(df, out.without(*got)).select(*out, "v"), out)


def copy(src: ArrayFrame, maps: Map, out: Box, pad: int | ArrayFrame | None = None, crop_to: Box | None = None, **slice_to: int) -> ArrayFrame:
    """pad: a constant, an array (dimensions it lacks are broadcast), or None: the source must cover the output.

    crop_to: only this part of the output is made.  slice_to: the output is one slice of an array with these dimensions.
    """
    if slice_to:
        return place(copy(src, maps, out, pad, crop_to), **slice_to)
    out = out if crop_to is None else out & crop_to
    need = required(maps, out)
    if pad is None:
        if not src.box.contains(need):
            raise ValueError(f"source {dict(src.box)} does not cover {dict(need)}")
        return pull(src, maps, out)
    got = domain(src.df.sparkSession, out).join(pull(src, maps, out).df, list(out), "left")
    if isinstance(pad, ArrayFrame):
        got = got.join(small(pad).withColumnRenamed("v", "p"), pad.dims, "left")
        return ArrayFrame(got.select(*out, F.coalesce("v", "p").alias("v")), out)
    return ArrayFrame(got.select(*out, F.coalesce("v", F.lit(pad)).alias("v")), out)


def identity(box: Box) -> Map:
    return {d: Affine(d) for d in box}


def crop(a: ArrayFrame, to: Box) -> ArrayFrame:
    out = a.box & to
    return a if out == a.box else ArrayFrame(a.df.where(to.holds()), out, a.sparse, a.origin, a.fn, a.shift)


def slice_at(a: ArrayFrame, **at: int) -> ArrayFrame:
    df = a.df
    for d, k in at.items():
        df = df.where(F.col(d) == k)
    return ArrayFrame(df.drop(*at), a.box.without(*at), a.sparse)


def translate(a: ArrayFrame, **by: int) -> ArrayFrame:
    df = a.df.select(*[(F.col(d) + by[d]).alias(d) if by.get(d) else F.col(d) for d in a.dims], "v")
    away = dict(a.shift)
    return ArrayFrame(df, Box({d: i + by.get(d, 0) for d, i in a.box.items()}), a.sparse, a.origin, a.fn, tuple((d, away.get(d, 0) + by.get(d, 0)) for d in a.dims))


def flip(a: ArrayFrame, d: str) -> ArrayFrame:
    return ArrayFrame(a.df.withColumn(d, -F.col(d)).select(*a.dims, "v"), a.box.with_(**{d: -a.box[d]}), a.sparse)


def transpose(a: ArrayFrame, names: dict[str, str]) -> ArrayFrame:
    """names: new name of each dimension."""
    out = Box({names[d]: i for d, i in a.box.items()})
    return ArrayFrame(a.df.select(*[F.col(d).alias(names[d]) for d in a.dims], "v"), out, a.sparse)


def diagonal(a: ArrayFrame, d: str, e: str) -> ArrayFrame:
    """Read with one output coordinate for two of the source."""
    box = a.box.without(e).with_(**{d: a.box[d] & a.box[e]})
    return ArrayFrame(a.df.where(F.col(d) == F.col(e)).drop(e), box, a.sparse)


def strided(a: ArrayFrame, d: str, scale: int, offset: int = 0) -> ArrayFrame:
    """out[x] = a[scale * x + offset], over all x that the source covers."""
    i = a.box[d]
    out = Interval(-((offset - i.min) // scale) if scale else 0, (i.max - offset) // scale if scale else -1)
    return pull(a, identity(a.box) | {d: Affine(d, scale, offset)}, a.box.with_(**{d: out}))


def upsample(a: ArrayFrame, *dims: str, by: int = 2) -> ArrayFrame:
    """Nearest: out[y] = a[floor(y / by)]."""
    df, box = a.df, a.box
    for d in dims:
        df = df.withColumn(d, F.explode(F.sequence(F.col(d) * by, F.col(d) * by + (by - 1))))
        box = box.with_(**{d: Interval(box[d].min * by, box[d].max * by + by - 1)})
    return ArrayFrame(df.select(*box, "v"), box)


def broadcast(a: ArrayFrame, **dims: Interval) -> ArrayFrame:
    box = Box({**a.box, **dims})
    return ArrayFrame(spread(a.df, Box(dims)).select(*box, "v"), box)


def broadcast_like(a: ArrayFrame, to: Box) -> ArrayFrame:
    """A dimension of extent 1 stretches to the other's; settled on the driver, from the boxes."""
    flat = [d for d in to if d in a.box and a.box[d].is_point and not to[d].is_point]
    missing = [d for d in to if d not in a.box]
    return broadcast(ArrayFrame(a.df.drop(*flat), a.box.without(*flat)), **{d: to[d] for d in [*flat, *missing]})


def concat(d: str, *arrays: ArrayFrame) -> ArrayFrame:
    """One after the other along a dimension, each re-based; the first one's start is the result's."""
    at, moved = arrays[0].box[d].min, []
    for a in arrays:
        moved.append(translate(a, **{d: at - a.box[d].min}))
        at += a.box[d].extent
    df = fold(lambda x, y: x.unionByName(y), [m.df for m in moved])
    return ArrayFrame(df, moved[0].box.with_(**{d: Interval(arrays[0].box[d].min, at - 1)}))


def stack(d: str, *arrays: ArrayFrame, at: int | None = None) -> ArrayFrame:
    """A new dimension that numbers the arrays, at a position among the others: the last where none is given or there are
    fewer."""
    df = fold(lambda x, y: x.unionByName(y), [a.df.withColumn(d, F.lit(i).cast("long")) for i, a in enumerate(arrays)])
    dims = arrays[0].dims
    dims.insert(len(dims) if at is None or at < 0 else min(at, len(dims)), d)
    box = Box({e: Interval(0, len(arrays) - 1) if e == d else arrays[0].box[e] for e in dims})
    return ArrayFrame(df.select(*box, "v"), box)


def place(a: ArrayFrame, **at: int) -> ArrayFrame:
    """One slice of an array with more dimensions: the inverse of slice_at."""
    box = Box({**a.box, **{d: point(k) for d, k in at.items()}})
    return ArrayFrame(a.df.select(*[F.lit(at[d]).cast("long").alias(d) if d in at else F.col(d) for d in box], "v"), box, a.sparse)


def merge(out: Box, *sources: tuple[ArrayFrame, Map]) -> ArrayFrame:
    """Several sources copied into one array; where two meet the later one stands, where none reaches nothing does.

    Sources whose parts cannot meet, which their boxes tell, are a plain union.
    """
    parts = []
    for src, maps in sources:
        reach = Box(out)
        for d, a in maps.items():
            if a.dim is not None and a.scale in (1, -1) and src.box[d].bounded:
                reach = reach.with_(**{a.dim: reach[a.dim] & (src.box[d] - a.offset) * a.scale})
        parts.append((pull(src, maps, out).df.select(*out, "v"), reach))
    df = fold(lambda x, y: x.unionByName(y), [p.withColumn("_i", F.lit(i)) for i, (p, _) in enumerate(parts)])
    meet = any(not (a & b).empty for i, (_, a) in enumerate(parts) for _, b in parts[:i])
    if meet:
        df = df.groupBy(*out).agg(F.max_by("v", "_i").alias("v"))
    return ArrayFrame(df.select(*out, "v"), out, sparse=meet or sum(r.volume for _, r in parts) != out.volume)


def element(a: ArrayFrame, **at: int | None) -> DataFrame:
    """(v): the value at a place, null if it lies outside the box; an index of None stands at the box's minimum."""
    where = {d: a.box[d].min if at.get(d) is None else at[d] for d in a.dims}
    one = a.df.sparkSession.range(1).select()
    if not all(a.box[d].contains(k) for d, k in where.items()):
        return one.select(F.lit(None).cast(a.df.schema["v"].dataType).alias("v"))
    return one.join(slice_at(a, **where).df.select("v"), how="left")


def per_tile(a: ArrayFrame, sizes: dict[str, int], kernel, within: Box | None = None) -> ArrayFrame:
    """A kernel over whole tiles: it gets the rows of one as a pandas frame and gives rows of the same columns.

    A tile is one task's group, so its size is what bounds memory, not the array's.
    """
    names = [f"_{d}" for d in sizes]
    df = a.df.select(*a.df.columns, *[positive_div(F.col(d) - a.box[d].min, n).alias(f"_{d}") for d, n in sizes.items()])
    got = df.groupBy(*names).applyInPandas(lambda g: kernel(g.drop(columns=names)), a.df.schema)
    return ArrayFrame(got, within or a.box, a.sparse)


def split(a: ArrayFrame, d: str, at: int) -> tuple[ArrayFrame, ArrayFrame]:
    """Two parts, the second re-based to start where the first does."""
    low = crop(a, Box({d: Interval(None, at - 1)}))
    high = crop(a, Box({d: Interval(at, None)}))
    return low, translate(high, **{d: a.box[d].min - at})


def reshape(a: ArrayFrame, dims: dict[str, int], batch: tuple[str, ...] = ()) -> ArrayFrame:
    """The same values in the order of their flat index, first dimension innermost; batch dimensions pass through."""
    flat, stride = F.lit(0).cast("long"), 1
    for d in a.dims:
        if d not in batch:
            flat = flat + (F.col(d) - a.box[d].min) * stride
            stride *= a.box[d].extent
    df, step, cols = a.df.withColumn("_i", flat), 1, []
    for d, n in dims.items():
        cols.append(positive_mod(positive_div(F.col("_i"), step), n).alias(d))
        step *= n
    if step != stride:
        raise ValueError(f"{step} values cannot hold {stride}")
    box = Box({**{d: Interval(0, n - 1) for d, n in dims.items()}, **{d: a.box[d] for d in batch}})
    return ArrayFrame(df.select(*cols, *batch, "v"), box)


def tile(a: ArrayFrame, n: int) -> ArrayFrame:
    """(x, y) to (xi, yi, xo, yo), the inner ones below n."""
    df = a.df.select(*[positive_mod(F.col(d), n).alias(f"{d}i") for d in a.dims], *[positive_div(F.col(d), n).alias(f"{d}o") for d in a.dims], "v")
    return ArrayFrame(df, Box({**{f"{d}i": Interval(0, n - 1) for d in a.dims}, **{f"{d}o": i.floordiv(n) for d, i in a.box.items()}}))


def untile(a: ArrayFrame, n: int) -> ArrayFrame:
    dims = [d[:-1] for d in a.dims if d.endswith("i")]
    df = a.df.select(*[(F.col(f"{d}o") * n + F.col(f"{d}i")).alias(d) for d in dims], "v")
    return ArrayFrame(df, Box({d: Interval(a.box[f"{d}o"].min * n, a.box[f"{d}o"].max * n + n - 1) for d in dims}))


def im2col(a: ArrayFrame, taps: dict[str, tuple[int, int, int]]) -> ArrayFrame:
    """out(x, dx) = a(x * stride + dx * dilation) for dx < count; taps: dimension to (stride, dilation, count).

    Scattered from the source: each value goes to the outputs that read it, so no join is needed.
    """
    df, box = a.df, Box(a.box)
    for d, (s, dil, k) in taps.items():
        i = a.box[d]
        last = (i.max - i.min - (k - 1) * dil) // s
        df = df.withColumn(f"d{d}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
        moved = F.col(d) - i.min - F.col(f"d{d}") * dil
        df = df.where(positive_mod(moved, s) == 0).withColumn(d, positive_div(moved, s)).where(F.col(d).between(0, last))
        box = Box({**box.with_(**{d: Interval(0, last)}), f"d{d}": Interval(0, k - 1)})
    return ArrayFrame(df.select(*box, "v"), box)
