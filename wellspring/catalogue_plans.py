"""More named queries: pipelines through the planner, and compositions of copies, reductions and stencils."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import GRID, E, H, R, V, _rect, emb, query, sixth
from .functions import intmath as im
from .functions.interval import Box, Interval, box
from .operators import elementwise as ew
from .operators import reduce as rd
from .operators import reindex as ri
from .operators import stencil as st
from .plans.graph import Buffer, Pipeline, Stage, halo, pointwise
from .sources import frame as fr
from .sources.frame import ArrayFrame

XY = ("x", "y")


def buffers(*names: str, dims: tuple[str, ...] = XY) -> list[Buffer]:
    return [Buffer(n, dims) for n in names]


def inner(src: ArrayFrame, radius: int) -> Box:
    return Box({d: Interval(i.min + radius, i.max - radius) for d, i in src.box.items()})


def cube(s, d) -> ArrayFrame:
    """The embedding grid with its columns as 8 by 8."""
    return ri.reshape(emb(s, d), {"p": 8, "q": 8}, batch=("y",))


# -- copies -----------------------------------------------------------------------------------------------------------
@query(f"WITH {E} SELECT x, y, v FROM E WHERE x < 50 UNION ALL SELECT x + 50, y, v * 2 FROM E WHERE x + 50 <= 99")
def sources_merged(s, d):
    """Two sources that overlap: the later one stands."""
    a = emb(s, d)
    return ri.merge(a.box.with_(x=Interval(0, 99)), (a, ri.identity(a.box)), (ew.multiply_2(a), {"x": ri.Affine("x", 1, -50), "y": ri.Affine("y")}))


@query(f"WITH {E} SELECT x, y, v FROM E WHERE x < 20 UNION ALL SELECT x, y, v * v FROM E WHERE x >= 30")
def sources_apart(s, d):
    """Two sources with a gap between them, which stays undefined."""
    a = emb(s, d)
    low, high = ri.crop(a, Box(x=Interval(0, 19), y=Interval())), ri.crop(ew.square(a), Box(x=Interval(30, 63), y=Interval()))
    return ri.merge(a.box, (low, ri.identity(a.box)), (high, ri.identity(a.box)))


@query(f"WITH {E} SELECT x, y, 4::BIGINT AS z, v FROM E")
def slice_written(s, d):
    a = emb(s, d)
    return ri.copy(a, ri.identity(a.box), a.box, z=4)


@query(f"WITH {E}, {H}, {GRID.format(x0=-1, x1=6, y0=-2, y1=3)} SELECT G.x, G.y, coalesce(v, 0) AS v FROM G LEFT JOIN E ON G.x = E.x AND G.y = E.y")
def copy_cropped(s, d):
    """Only a crop of the padded output is made."""
    a = emb(s, d)
    out = Box(x=Interval(-3, 66), y=Interval(a.box["y"].min - 2, a.box["y"].max + 2))
    return ri.copy(a, ri.identity(a.box), out, 0, crop_to=Box(x=Interval(-1, 5), y=Interval()))


@query(f"WITH {E} SELECT x, y, 0::BIGINT AS z, v FROM E UNION ALL SELECT x, y, 1::BIGINT, v * v FROM E UNION ALL SELECT x, y, 2::BIGINT, v + 1 FROM E")
def stack_first(s, d):
    a = emb(s, d)
    return ri.stack("z", a, ew.square(a), ew.add_1(a), at=0)


@query(f"WITH {E} SELECT x, y, v FROM E UNION ALL SELECT x - 10 + 64, y, v FROM E WHERE x >= 10 UNION ALL SELECT x + 118, y, v * 2 FROM E WHERE x < 7")
def concat_three(s, d):
    """Sources of different extents."""
    a = emb(s, d)
    cut = lambda lo, hi, b: ri.crop(b, Box(x=Interval(lo, hi), y=Interval()))
    return ri.concat("x", a, cut(10, 63, a), cut(0, 6, ew.multiply_2(a)))


@query(f"WITH {E} SELECT x // 8 AS p, y AS q, x % 8 AS y, v FROM E")
def permute_3d(s, d):
    return ri.transpose(cube(s, d), {"p": "y", "q": "p", "y": "q"})


@query(f"WITH {E}, C AS (SELECT x % 8 AS p, x // 8 AS q, y, v FROM E) SELECT y AS p, g.g AS q, k.q AS y, coalesce(C.v, -1) AS v FROM (SELECT unnest(range(-1, 9))::BIGINT AS g) g, (SELECT DISTINCT y, q FROM C) k LEFT JOIN C USING (y, q) WHERE C.p = g.g UNION ALL SELECT y, g.g, q, -1 FROM (SELECT DISTINCT y, q FROM C) k, (SELECT unnest([-1, 8])::BIGINT AS g) g")
def pad_transpose_3d(s, d):
    a = cube(s, d)
    padded = ri.copy(a, ri.identity(a.box), a.box.with_(p=Interval(-1, 8)), -1)
    return ri.transpose(padded, {"p": "q", "q": "y", "y": "p"})


@query(f"WITH {E} SELECT x, y, v FROM E")
def broadcast_dropped(s, d):
    """A new dimension in between, which the next copy drops."""
    a = emb(s, d)
    return ri.slice_at(ri.broadcast(a, z=Interval(0, 2)), z=1)


@query(f"WITH {V} SELECT x, v FROM V")
def identity_1d(s, d):
    a = fr.events(s, d)
    return ri.copy(a, ri.identity(a.box), a.box)


@query(f"WITH {E} SELECT x % 8 AS p, x // 8 AS q, y, v FROM E")
def identity_3d(s, d):
    a = cube(s, d)
    return ri.copy(a, ri.identity(a.box), a.box)


@query(f"WITH {E} SELECT k.x, e.y, e.v FROM (SELECT unnest(range(5))::BIGINT AS x) k, E e WHERE e.x = 9")
def stride_zero(s, d):
    """Every output reads the same place."""
    a = emb(s, d)
    return ri.copy(a, {"x": ri.Affine("x", 0, 9), "y": ri.Affine("y")}, a.box.with_(x=Interval(0, 4)))


@query(f"WITH {E}, {H}, {GRID.format(x0=0, x1=64, y0=0, y1=1)} SELECT G.x, G.y, CASE WHEN G.x + 6 > 63 THEN 7 ELSE coalesce(v, -1) END AS v FROM G LEFT JOIN E ON E.x = G.x + 3 AND G.x + 6 <= 63 AND E.y = G.y AND E.x >= 3")
def padded_copies(s, d):
    """Two padded copies, one after the other: what the first pads, the second moves."""
    a = emb(s, d)
    moved = ri.copy(a, {"x": ri.Affine("x", 1, -3), "y": ri.Affine("y")}, a.box, -1)
    return ri.copy(moved, {"x": ri.Affine("x", 1, 6), "y": ri.Affine("y")}, a.box, 7)


@query(f"WITH {E}, A AS (SELECT x + 3 AS x, y - 2 AS y, v FROM E) {_rect('A', (-1, 1), (-1, 1))}")
def translated_stencil(s, d):
    return st.square_sum(ri.translate(emb(s, d), x=3, y=-2), 1)


@query(f"WITH {E} SELECT x * 2 + i AS x, y * 2 + j AS y, v FROM E, (SELECT unnest([0, 1])::BIGINT AS i) p, (SELECT unnest([0, 1])::BIGINT AS j) q")
def upsample_xy(s, d):
    return ri.upsample(emb(s, d), "x", "y")


@query(f"WITH {V} SELECT 0::BIGINT AS k, 1::BIGINT AS there, (SELECT v FROM V WHERE x = 5) AS v UNION ALL SELECT 1, 0, 0 UNION ALL SELECT 2, 1, (SELECT v FROM V WHERE x = (SELECT min(x) FROM V)) UNION ALL SELECT 3, 1, (SELECT v FROM V WHERE x = (SELECT max(x) FROM V))")
def element_lookups(s, d):
    """Inside, outside, with an index that is left open, and at the last place."""
    a = fr.events(s, d)
    got = [ri.element(a, x=k).select(F.lit(i).cast("long").alias("k"), im.truth(F.col("v").isNotNull()).alias("there"), F.coalesce("v", F.lit(0)).alias("v")) for i, k in enumerate((5, a.box["x"].max + 1, None, a.box["x"].max))]
    return got[0].union(got[1]).union(got[2]).union(got[3])


@query(f"WITH {E} SELECT x, y, v - min(v) OVER (PARTITION BY x // 16, y // 16) AS v FROM E")
def tile_kernel(s, d):
    """A kernel that sees a tile at a time."""
    return ri.per_tile(emb(s, d), {"x": 16, "y": 16}, lambda g: g.assign(v=g["v"] - g["v"].min()))


# -- maps ---------------------------------------------------------------------------------------------------------------
@query(f"WITH {R} SELECT x, y, round(1 + v * (1 + v / 2 * (1 + v / 3 * (1 + v / 4 * (1 + v / 5)))), 6) AS v FROM R")
def exp_series(s, d):
    return sixth(ew.apply(emb(s, d, real=True), lambda v: ew.exp_series(v, 6)))


@query(f"WITH {E} SELECT x, y, (v * 7 + x) % 1000 AS v FROM E")
def user_function(s, d):
    return ew.call(emb(s, d), lambda v, x: int((v * 7 + x) - 1000 * int((v * 7 + x) / 1000)), "x")


@query(f"WITH {E} SELECT x, y, v FROM E")
def asserted(s, d):
    """Fails if a value breaks the assertion."""
    return ew.require(emb(s, d), lambda v: F.abs(v) < 10**9, "a value is out of range")


@query(f"WITH {E} SELECT x, y, v * 3 AS v FROM E")
def scalar_constant(s, d):
    return ew.multiply(emb(s, d), fr.scalar(s, 3))


_SAT = "CAST(greatest(least({x}, 9223372036854775807::HUGEINT), -9223372036854775808::HUGEINT) AS BIGINT)"
_A, _B = "(v::HUGEINT * 150000000000000)", "(v::HUGEINT * -90000000000000)"


@query(f"WITH {V}, W AS (SELECT x, v - 50000 AS v FROM V), S AS (SELECT x, {_SAT.format(x=_A)}::HUGEINT AS a, {_SAT.format(x=_B)}::HUGEINT AS b, CAST(x % 7 - 3 AS HUGEINT) AS k FROM W) SELECT x, {_SAT.format(x='a + a')} AS twice, {_SAT.format(x='a - b')} AS away, CASE WHEN k = 0 THEN 0 ELSE {_SAT.format(x='(a - ((a % abs(k)) + abs(k)) % abs(k)) // k')} END AS part, (a + a NOT BETWEEN -9223372036854775808::HUGEINT AND 9223372036854775807::HUGEINT)::BIGINT AS over_add, (a - b NOT BETWEEN -9223372036854775808::HUGEINT AND 9223372036854775807::HUGEINT)::BIGINT AS over_sub FROM S")
def saturating_family(s, d):
    v = F.col("v") - 50000
    df = fr.events(s, d).df.select("x", im.sat_mul(v, 150_000_000_000_000).alias("a"), im.sat_mul(v, -90_000_000_000_000).alias("b"), (F.col("x") % 7 - 3).alias("k"))
    a, b = F.col("a"), F.col("b")
    return df.select("x", im.sat_add(a, a).alias("twice"), im.sat_sub(a, b).alias("away"), im.sat_div(a, F.col("k")).alias("part"), im.truth(im.overflows("add", a, a)).alias("over_add"), im.truth(im.overflows("sub", a, b)).alias("over_sub"))


# -- what the planner knows ---------------------------------------------------------------------------------------------
_STAIRS = [((0, 4, 4),), ((3, 5, 10),), ((1, 6, 4), (2, 9, -6)), ((0, 3, 2), (5, 4, 1), (1, 12, -11)), ((-7, -8, 16),)]
_STEP = "CASE WHEN {b} = 0 THEN 0 ELSE (({x} + {a}) - ((({x} + {a}) % abs({b})) + abs({b})) % abs({b})) // {b} * {c} END"


def _stairs_sql() -> str:
    parts = []
    for i, stairs in enumerate(_STAIRS):
        total, slope = (" + ".join(t) for t in zip(*[(_STEP.format(x="x", a=a, b=b, c=c), f"({c})::DOUBLE / {b}") for a, b, c in stairs]))
        wild = f"abs({slope}) > 1e-12"
        parts.append(f"SELECT {i}::BIGINT AS k, ({wild})::BIGINT AS wild, CASE WHEN {wild} THEN 0 ELSE min({total}) END::BIGINT AS low, CASE WHEN {wild} THEN 0 ELSE max({total}) END::BIGINT AS high FROM (SELECT unnest(range(-5000, 5000))::BIGINT AS x)")
    return " UNION ALL ".join(parts)


@query(_stairs_sql())
def staircase_bounds(s, d):
    """Sums of staircases: bounded where the slopes cancel."""
    got = [(k, *im.staircase_range(*stairs)) for k, stairs in enumerate(_STAIRS)]
    return s.createDataFrame([(k, int(low is None), low or 0, high or 0) for k, low, high in got], "k long, wild long, low long, high long")


_INTERVALS = [(2, 7), (-4, 3), (-9, -5), (0, 0), (0, 6), (-3, 0)]


@query(f"WITH I AS (SELECT * FROM (VALUES {', '.join(f'({i}::BIGINT, {a}, {b})' for i, (a, b) in enumerate(_INTERVALS))}) t(i, a, b)), M AS (SELECT i, unnest(range(a, b + 1))::BIGINT AS m FROM I) SELECT p.i, q.i AS j, min(p.m * q.m)::BIGINT AS m0, max(p.m * q.m)::BIGINT AS m1, min({_STEP.format(x='p.m', a=0, b='q.m', c=1)})::BIGINT AS d0, max({_STEP.format(x='p.m', a=0, b='q.m', c=1)})::BIGINT AS d1, (min(p.m) > 0)::BIGINT AS positive, (max(p.m) <= 0)::BIGINT AS below FROM M p, M q GROUP BY 1, 2")
def interval_products(s, d):
    """Products and quotients of intervals are the least hulls of their members'."""
    own = [Interval(*x) for x in _INTERVALS]
    rows = [(i, j, (p * q).min, (p * q).max, p.floordiv(q).min, p.floordiv(q).max, int(p.is_positive), int(p.is_non_positive)) for i, p in enumerate(own) for j, q in enumerate(own)]
    return s.createDataFrame(rows, "i long, j long, m0 long, m1 long, d0 long, d1 long, positive long, below long")


# -- products and reductions ----------------------------------------------------------------------------------------------
@query(f"WITH {E}, {H} SELECT o.x, p.y, sum(v)::BIGINT AS v FROM H, (SELECT unnest(range(31))::BIGINT AS x) o, (SELECT unnest(range((h - 2) // 2 + 1))::BIGINT AS y FROM H) p, (SELECT unnest(range(3))::BIGINT AS dx) dx, (SELECT unnest(range(3))::BIGINT AS dy) dy, E WHERE E.x = o.x * 2 + dx AND E.y = p.y * 2 + dy GROUP BY 1, 2")
def im2col_reduce_2d(s, d):
    return rd.total(ri.im2col(emb(s, d), {"x": (2, 1, 3), "y": (2, 1, 3)}), "dx", "dy")


@query(f"WITH {V} SELECT o.x, sum(v)::BIGINT AS v FROM (SELECT unnest(range(((SELECT max(x) FROM V) - 6) // 4 + 1))::BIGINT AS x) o, (SELECT unnest(range(4))::BIGINT AS k) k JOIN V ON V.x = o.x * 4 + k.k * 2 GROUP BY 1")
def im2col_scalars(s, d):
    """Stride, dilation and count are scalar arguments; the footprint follows from them."""
    src = fr.events(s, d)
    a, cols, out = Buffer("in", ("x",)), Buffer("cols", ("x", "dx")), Buffer("out", ("x",))

    def need(o: Box, k: dict[str, int]) -> Box:
        return Box(x=o["x"] * k["S"] + o["dx"] * k["D"])

    Stage(lambda i, S, D, K: ri.im2col(i, {"x": (S, D, K)}), [(a, need)], [cols], "im2col")
    Stage(lambda i, *_: rd.total(i, "dx"), [(cols, lambda o, k: Box(x=o["x"], dx=Interval(0, k["K"] - 1)))], [out], "reduce")
    scalars = {"S": 4, "D": 2, "K": 4}
    last = (src.box["x"].max - src.box["x"].min - (scalars["K"] - 1) * scalars["D"]) // scalars["S"]
    return Pipeline([a], [out], ("S", "D", "K")).evaluate({"out": box(x=(0, last))}, {"in": src}, scalars)["out"]


@query(f"WITH {E}, {H}, A AS (SELECT x - i AS x, y - j AS y, v FROM E, (SELECT unnest(range(-1, 2))::BIGINT AS i) p, (SELECT unnest(range(-2, 1))::BIGINT AS j) q UNION ALL SELECT x, y, v * v FROM E UNION ALL SELECT g.x, E.y, v FROM E, (SELECT unnest(range(64))::BIGINT AS x) g) SELECT x, y, bit_xor(v & 65535)::BIGINT AS v FROM A, H WHERE x BETWEEN 1 AND 62 AND y BETWEEN 2 AND h GROUP BY 1, 2")
def xor_inputs(s, d):
    """Three inputs: one with a halo, one point for point, one needed along whole rows."""
    a = emb(s, d)
    out = Box(x=Interval(1, 62), y=Interval(2, a.box["y"].max))
    rows = ri.transpose(a, {"x": "k", "y": "y"})
    return rd.xor_required(out, [(a, {"x": (-1, 1), "y": (-2, 0)}), (ew.square(a), {}), (rows, {})], bits=16)


@query(f"WITH {E} SELECT y, bit_or(v)::BIGINT AS v FROM E GROUP BY y")
def reduce_any(s, d):
    """Any aggregate as the reduction."""
    return rd.reduce(emb(s, d), F.bit_or, 0, "x")


@query(f"WITH {E} SELECT y AS i, b.i AS j, sum(a.v * b.v)::BIGINT AS v FROM E a JOIN (SELECT y AS i, x, v FROM E WHERE y < 200) b USING (x) GROUP BY 1, 2")
def matmul_blocks(s, d):
    """Rows of the grid against 200 of its rows, dealt to blocks."""
    a = ri.transpose(emb(s, d), {"x": "k", "y": "i"})
    b = ri.transpose(emb(s, d, rows=Interval(0, 199)), {"x": "k", "y": "j"})
    return rd.matmul(a, ArrayFrame(b.df, b.box), block=64, most=0)


# -- stencils -------------------------------------------------------------------------------------------------------------
@query(f"WITH {E}, F AS (SELECT 63 - x AS x, y, v * 2 AS v FROM E), A AS (SELECT x, y, v + 1 AS v FROM E), P AS ({_rect('A', (-1, 1), (-1, 1))}), Q AS ({_rect('F', (-2, 2), (-2, 2))}) SELECT x, y, P.v - Q.v AS v FROM P JOIN Q USING (x, y)")
def stencil_two_inputs(s, d):
    """Two inputs, a map and a stencil each, and their difference."""
    src = emb(s, d)
    one, two, p, q, u, w, out = buffers("one", "two", "p", "q", "u", "w", "out")
    Stage(ew.add_1, [(one, pointwise)], [p])
    Stage(ew.multiply_2, [(two, pointwise)], [q])
    Stage(lambda i: st.square_sum(i, 1), [(p, halo(x=(-1, 1), y=(-1, 1)))], [u], "sum3x3")
    Stage(lambda i: st.square_sum(i, 2), [(q, halo(x=(-2, 2), y=(-2, 2)))], [w], "sum5x5")
    Stage(ew.subtract, [(u, pointwise), (w, pointwise)], [out])
    mirrored = ri.translate(ri.flip(src, "x"), x=63)
    return Pipeline([one, two], [out]).evaluate({"out": inner(src, 2)}, {"one": src, "two": mirrored})["out"]


@query(f"WITH {E}, {H}, {GRID.format(x0=-1, x1=65, y0=-1, y1=2)}, A AS (SELECT G.x, G.y, coalesce(v, 0) AS v FROM G LEFT JOIN E ON G.x = E.x AND G.y = E.y) {_rect('A', (-1, 1), (-1, 1))}")
def padded_separable(s, d):
    """Pad and transpose, sum along one dimension, transpose back, and sum along it again."""
    a = emb(s, d)
    swap = {"x": "y", "y": "x"}
    padded = ri.transpose(ri.copy(a, ri.identity(a.box), st.required(a.box, {"x": (-1, 1), "y": (-1, 1)}), 0), swap)
    return st.rectangle_sum(ri.transpose(st.rectangle_sum(padded, {"x": (-1, 1)}), swap), {"x": (-1, 1)})


@query(f"WITH {E} SELECT a.x, a.y, (a.v + coalesce(b.v, 0) + coalesce(c.v, 0))::BIGINT AS v FROM E a LEFT JOIN E b ON b.x = a.x AND b.y = a.y - 1 LEFT JOIN E c ON c.x = a.x AND c.y = a.y + 1")
def padded_im2col_reduce(s, d):
    """A stencil as a padded copy with a tap dimension, summed over it."""
    a = emb(s, d)
    padded = ri.copy(a, ri.identity(a.box), st.required(a.box, {"y": (-1, 1)}), 0)
    cols = ri.im2col(padded, {"y": (1, 1, 3)})
    return ri.translate(rd.total(cols, "dy"), y=a.box["y"].min)


@query(f"WITH {V}, {H}, G AS (SELECT x, v FROM V) SELECT x, (v + coalesce(lag(v) OVER w, 0) + coalesce(lead(v) OVER w, 0))::BIGINT AS v FROM G WINDOW w AS (ORDER BY x)")
def padded_im2col_reduce_1d(s, d):
    a = fr.events(s, d)
    padded = ri.copy(a, ri.identity(a.box), st.required(a.box, {"x": (-1, 1)}), 0)
    return ri.translate(rd.total(ri.im2col(padded, {"x": (1, 1, 3)}), "dx"), x=a.box["x"].min)


# -- pipelines ------------------------------------------------------------------------------------------------------------
@query(f"WITH {E} SELECT x, y, ((v * 2 + 1) * 2 + 1) * 2 AS v FROM E")
def chain_planned(s, d):
    """Five stages, which Catalyst makes one projection."""
    src = emb(s, d)
    own = buffers("in", "b1", "b2", "b3", "b4", "out")
    for a, b, f in zip(own, own[1:], (ew.multiply_2, ew.add_1, ew.multiply_2, ew.add_1, ew.multiply_2)):
        Stage(f, [(a, pointwise)], [b])
    return Pipeline(own[:1], own[-1:]).evaluate({"out": src.box}, {"in": src})["out"]


@query(f"WITH {E}, {V} SELECT 0::BIGINT AS k, x, y, v + 1 AS v FROM E UNION ALL SELECT 1, x, 0, v * 2 FROM V")
def disjoint_outputs(s, d):
    """Two graphs that share nothing, evaluated together."""
    grid, line = emb(s, d), fr.events(s, d)
    a, out = buffers("a", "left")
    b, other = buffers("b", "right", dims=("x",))
    Stage(ew.add_1, [(a, pointwise)], [out])
    Stage(ew.multiply_2, [(b, pointwise)], [other])
    got = Pipeline([a, b], [out, other]).evaluate({"left": grid.box, "right": line.box}, {"a": grid, "b": line})
    return got["left"].df.select(F.lit(0).cast("long").alias("k"), "x", "y", "v").union(got["right"].df.select(F.lit(1).cast("long"), "x", F.lit(0).cast("long"), "v"))


@query(f"WITH {E} SELECT x, y, v + (x * 10 + 1) AS v FROM E WHERE x < 4")
def map_of_constant(s, d):
    """A constant buffer, mapped and broadcast along the grid."""
    src = emb(s, d, cols=Interval(0, 3))
    a, plus, out = Buffer("in", XY), Buffer("plus", ("x",)), Buffer("out", XY)
    fixed = Buffer("fixed", ("x",), constant=fr.constant(s, [(i, 10 * i) for i in range(4)], ["x"]))
    Stage(ew.add_1, [(fixed, pointwise)], [plus])
    Stage(lambda p, q: ew.zip_with(lambda v, k: v + k, p, q), [(a, pointwise), (plus, lambda o: o.without("y"))], [out], "add")
    return Pipeline([a], [out]).evaluate({"out": src.box}, {"in": src})["out"]


@query(f"WITH {R}, M AS (SELECT *, exp(v + 1 - max(v + 1) OVER (PARTITION BY y)) AS e FROM R) SELECT x, y, round(e / sum(e) OVER (PARTITION BY y) + 1, 6) AS v FROM M")
def softmax_planned(s, d):
    """Five stages, one of them with two outputs."""
    src = emb(s, d, real=True)
    a, plus, e, soft, out = buffers("in", "plus", "e", "soft", "out")
    (t,) = buffers("t", dims=("y",))
    whole = lambda o: o.with_(x=src.box["x"])
    Stage(ew.add_1, [(a, pointwise)], [plus])
    Stage(lambda i: rd.sum_exp(i, "x"), [(plus, whole)], [e, t], "sum_exp")
    Stage(rd.normalize, [(e, pointwise), (t, lambda o: o.without("x"))], [soft])
    Stage(ew.add_1, [(soft, pointwise)], [out])
    return sixth(Pipeline([a], [out]).evaluate({"out": src.box}, {"in": src})["out"])


@query(f"WITH {E}, A AS ({_rect('E', (-1, 1), (-1, 1))}) SELECT x, y, v * 2 - (v + 1) AS v FROM A")
def rooted_diamond(s, d):
    """A root kept for its two consumers."""
    src = emb(s, d)
    a, mid, p, q, out = buffers("in", "mid", "p", "q", "out")
    mid.compute_root()
    Stage(lambda i: st.square_sum(i, 1), [(a, halo(x=(-1, 1), y=(-1, 1)))], [mid], "sum3x3")
    Stage(ew.multiply_2, [(mid, pointwise)], [p])
    Stage(ew.add_1, [(mid, pointwise)], [q])
    Stage(ew.subtract, [(p, pointwise), (q, pointwise)], [out])
    return Pipeline([a], [out]).evaluate({"out": inner(src, 1)}, {"in": src})["out"]


@query(f"WITH {E} SELECT x, y, (v + 1) * 2 AS v FROM E WHERE x BETWEEN 3 AND 50")
def aligned_stage(s, d):
    """The producer works on multiples of 16; the consumer takes what it needs."""
    src = emb(s, d)
    a, mid, out = buffers("in", "mid", "out")
    Stage(ew.add_1, [(a, pointwise)], [mid], align={"x": 16})
    Stage(ew.multiply_2, [(mid, pointwise)], [out])
    return Pipeline([a], [out]).evaluate({"out": src.box.with_(x=Interval(3, 50))}, {"in": src})["out"]


@query(f"WITH {E} {_rect('E', (-1, 1), (-1, 1))}")
def tiled_loop(s, d):
    """Column by column tiles of 24, the last one clamped."""
    src = emb(s, d)
    a, out = buffers("in", "out")
    Stage(lambda i: st.square_sum(i, 1), [(a, halo(x=(-1, 1), y=(-1, 1)))], [out], "sum3x3")
    return Pipeline([a], [out]).loop({"out": inner(src, 1)}, {"x": 24}, {"in": src})["out"]


@query(f"WITH {E} SELECT x, v FROM E WHERE y = 7")
def slices_of_slices(s, d):
    """Several dimensions at once, one of them put back."""
    a = ri.place(ri.slice_at(cube(s, d), y=7), y=7)
    return ri.slice_at(ri.transpose(ri.reshape(a, {"x": 64}, batch=("y",)), {"x": "x", "y": "z"}), z=7)
