"""Named queries over the driver's tables, each with the same computation in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import intmath as im
from .functions.interval import Box, Interval, box, point
from .operators import elementwise as ew
from .operators import reduce as rd
from .operators import reindex as ri
from .operators import stencil as st
from .plans.graph import Buffer, Pipeline, Stage, halo, pointwise
from .sources import frame as fr
from .sources.frame import ArrayFrame

# The arrays of the SQL side: E quantized embeddings, R the same unquantized, V events, O orders, N the nation grid.
E = "E AS (SELECT vec_id AS y, unnest(range(64))::BIGINT AS x, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 1000) AS BIGINT) AS v FROM embeddings)"
R = "R AS (SELECT vec_id AS y, unnest(range(64))::BIGINT AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
V = "V AS (SELECT event_id AS x, CAST(floor(value * 1000) AS BIGINT) AS v FROM events)"
O = "O AS (SELECT o_orderkey AS x, CAST(floor(o_totalprice * 1000) AS BIGINT) AS v FROM orders)"
N = "N AS (SELECT CAST(n_nationkey % 5 AS BIGINT) AS x, CAST(n_nationkey // 5 AS BIGINT) AS y, CAST(n_regionkey AS BIGINT) AS v FROM nation)"
H = "H AS (SELECT CAST(max(vec_id) AS BIGINT) AS h FROM embeddings)"
GRID = "G AS (SELECT x, y FROM (SELECT unnest(range({x0}, {x1}))::BIGINT AS x) a, (SELECT unnest(range({y0}, h + {y1}))::BIGINT AS y FROM H) b)"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None):
    """Register a function of (spark, sf_dir) that gives an array or a DataFrame."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = f(spark, sf_dir)
            return got.df if isinstance(got, ArrayFrame) else got

        QUERIES[f.__name__] = Query(run, sql)
        return f

    return add


def emb(s, d, **k) -> ArrayFrame:
    return fr.embeddings(s, d, **k)


def sixth(a: ArrayFrame) -> ArrayFrame:
    return ew.apply(a, lambda v: F.round(v, 6))


def _map(name: str, f, sql: str) -> None:
    def run(s, d):
        return ew.apply(emb(s, d), f)

    run.__name__ = name
    query(f"WITH {E} SELECT x, y, {sql} AS v FROM E")(run)


# -- elementwise ------------------------------------------------------------------------------------------------------
_map("map_add1", lambda v: v + 1, "v + 1")
_map("map_mul2", lambda v: v * 2, "v * 2")
_map("map_square", lambda v: v * v, "v * v")
_map("map_identity", lambda v: v, "v")
_map("map_chain", lambda v: ((v * 2 + 1) * 3 + 4) * 5, "((v * 2 + 1) * 3 + 4) * 5")
_map("map_power5", lambda v: ew.power(v, 5), "v * v * v * v * v")
_map("poly_horner", lambda v: ew.horner(v, [2, -3, 5, 7]), "((2 * v - 3) * v + 5) * v + 7")
_map("calc_select_minmax", lambda v: F.when(v < 10, F.least(v + 3, F.lit(7))).when((v % 3 == 0) | (v > 90), F.greatest(v, F.lit(50)) * 2).otherwise(v - 1), "CASE WHEN v < 10 THEN least(v + 3, 7) WHEN v % 3 = 0 OR v > 90 THEN greatest(v, 50) * 2 ELSE v - 1 END")
_map("calc_compare_logic", lambda v: im.truth(v <= 5) + 2 * im.truth(v == 8) + 4 * im.truth(v != 9) + 8 * im.truth((v > 0) & (v < 70)), "(v <= 5)::BIGINT + 2 * (v = 8)::BIGINT + 4 * (v <> 9)::BIGINT + 8 * (v > 0 AND v < 70)::BIGINT")
_map("trunc_division", lambda v: im.trunc_div(v, 4), "v // 4")
_map("clamp_values", lambda v: im.clamp(v, -50, 75), "greatest(-50, least(v, 75))")
_map("wrap_byte", lambda v: im.wrap(v + 2, 8, signed=False), "((v + 2) % 256 + 256) % 256")
_map("wrap_short", lambda v: im.wrap(v * 1000, 16), "CASE WHEN ((v * 1000) % 65536 + 65536) % 65536 >= 32768 THEN ((v * 1000) % 65536 + 65536) % 65536 - 65536 ELSE ((v * 1000) % 65536 + 65536) % 65536 END")


@query(f"WITH {E} SELECT x, y, CASE WHEN v = 0 THEN CAST('inf' AS DOUBLE) ELSE round(1 / sqrt(v * v), 6) END AS v FROM E")
def reciprocal_sqrt(s, d):
    return ew.apply(ew.reciprocal_sqrt(ew.square(emb(s, d))), lambda v: F.round(v, 6))


@query(f"WITH {E} SELECT a.x, a.y, a.v - b.v AS v FROM E a, E b WHERE a.x = b.x AND a.y = b.y + 1")
def binary_subtract(s, d):
    a = emb(s, d)
    return ew.subtract(a, ri.translate(a, y=1))


@query(f"WITH {E} SELECT a.x, a.y, a.v * b.v AS v FROM E a, E b WHERE a.x = b.x + 2 AND a.y = b.y")
def binary_multiply(s, d):
    a = emb(s, d)
    return ew.multiply(a, ri.translate(a, x=2))


@query(f"WITH {E} SELECT a.x, a.y, (a.v + 1) - (b.v + 1) AS v FROM E a, E b WHERE a.y = b.y AND b.x = a.x + 1")
def self_shift_diff(s, d):
    a = ew.add_1(emb(s, d))
    return ew.subtract(a, ri.translate(a, x=-1))


@query(f"WITH {E} SELECT a.x, a.y, (a.v + 2) - (b.v + 2) AS v FROM E a, E b WHERE a.y = b.y AND b.x = a.x + 32")
def half_diff(s, d):
    a = ew.apply(emb(s, d), lambda v: v + 2)
    low, high = ri.split(a, "x", 32)
    return ew.subtract(low, high)


@query(f"WITH {E} SELECT x, y, (v + 1) * (v * 2) - (v + 1) AS v FROM E")
def diamond(s, d):
    a = emb(s, d)
    one = ew.add_1(a)
    return ew.zip_with(lambda p, q, r: p * q - r, one, ew.multiply_2(a), one)


@query(f"WITH {V} SELECT x, b, CASE WHEN b = 0 THEN 0 ELSE (v - ((v % abs(b)) + abs(b)) % abs(b)) // b END AS q, CASE WHEN b = 0 THEN 0 ELSE ((v % abs(b)) + abs(b)) % abs(b) END AS r FROM (SELECT x, v - 50000 AS v, CAST(x % 13 - 6 AS BIGINT) AS b FROM V)")
def euclid_divmod(s, d):
    v = fr.events(s, d).df.select("x", (F.col("v") - 50000).alias("v"), (F.col("x") % 13 - 6).alias("b"))
    return v.select("x", "b", im.euclid_div(F.col("v"), F.col("b")).alias("q"), im.euclid_mod(F.col("v"), F.col("b")).alias("r"))


_EU = "(({a}) - ((({a}) % 7) + 7) % 7) // 7"


@query(f"WITH {V} SELECT x, {_EU.format(a='v - 50000')} AS fl, {_EU.format(a='v - 50000 + 3')} AS ro, {_EU.format(a='v - 50000 + 6')} AS ce, ({_EU.format(a='v - 50000')}) * 7 AS dn, ({_EU.format(a='v - 50000 + 6')}) * 7 AS up FROM V")
def division_family(s, d):
    v = F.col("v") - 50000
    return fr.events(s, d).df.select("x", im.floor_div(v, 7).alias("fl"), im.round_div(v, 7).alias("ro"), im.ceil_div(v, 7).alias("ce"), im.align_down(v, 7).alias("dn"), im.align_up(v, 7).alias("up"))


_BIG = "(v::HUGEINT * 1000000000000000)"


@query(f"WITH {V}, W AS (SELECT x, v - 50000 AS v FROM V) SELECT x, CAST(greatest(least({_BIG}, 9223372036854775807::HUGEINT), -9223372036854775808::HUGEINT) AS BIGINT) AS sat, CASE WHEN {_BIG} BETWEEN -9223372036854775808::HUGEINT AND 9223372036854775807::HUGEINT THEN 0 ELSE 1 END::BIGINT AS over, CASE WHEN {_BIG} BETWEEN -9223372036854775808::HUGEINT AND 9223372036854775807::HUGEINT THEN CAST({_BIG} AS BIGINT) ELSE 0 END AS checked FROM W")
def saturating(s, d):
    v, k = F.col("v") - 50000, 10**15
    return fr.events(s, d).df.select("x", im.sat_mul(v, k).alias("sat"), im.truth(im.overflows("mul", v, k)).alias("over"), im.checked("mul", v, k).alias("checked"))


@query(f"WITH {V} SELECT x, CASE WHEN v % 2 <> 0 AND v % 3 <> 0 THEN 1 ELSE 0 END::BIGINT AS a, CASE WHEN v % 2 <> 0 OR v % 3 <> 0 THEN 1 ELSE 0 END::BIGINT AS o, CASE WHEN v % 5 <> 0 THEN v ELSE -v END AS s, CASE WHEN v % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS n, CASE WHEN v <> 0 THEN 1 ELSE 0 END::BIGINT AS b, abs(v) AS m FROM V")
def logic_functions(s, d):
    v = F.col("v")
    return fr.events(s, d).df.select("x", im.and_then(v % 2, v % 3).alias("a"), im.or_else(v % 2, v % 3).alias("o"), im.select(v % 5, v, -v).alias("s"), im.negate(v % 4).alias("n"), im.boolean(v).alias("b"), F.abs(v).alias("m"))


# -- bounds -----------------------------------------------------------------------------------------------------------
@query(f"WITH {E} SELECT x, y, v FROM E WHERE x BETWEEN 5 AND 20 AND y BETWEEN 10 AND 99")
def crop_box(s, d):
    return emb(s, d, rows=Interval(10, 99), cols=Interval(5, 20))


@query(f"WITH {E} SELECT x, v FROM E WHERE y = 7")
def slice_row(s, d):
    return ri.slice_at(emb(s, d, rows=point(7)), y=7)


@query(f"WITH {E} SELECT x, y, v FROM E WHERE x >= 60")
def half_open(s, d):
    return ri.crop(emb(s, d), Box(x=Interval(60, None), y=Interval()))


@query(f"WITH {V} SELECT v FROM V WHERE x = 5")
def element_at(s, d):
    return ri.slice_at(fr.events(s, d, within=point(5)), x=5)


@query(f"WITH {E} SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS volume FROM E")
def box_fields(s, d):
    a = emb(s, d)
    return s.range(1).select(*[F.lit(i).cast("long").alias(n) for n, i in (("x0", a.box["x"].min), ("x1", a.box["x"].max), ("y0", a.box["y"].min), ("y1", a.box["y"].max), ("volume", a.box.volume))])


# -- copies -----------------------------------------------------------------------------------------------------------
def _grown(a: ArrayFrame, x: int, y: int) -> Box:
    return Box(x=Interval(a.box["x"].min - x, a.box["x"].max + x), y=Interval(a.box["y"].min - y, a.box["y"].max + y))


@query(f"WITH {E}, {H}, {GRID.format(x0=-3, x1=67, y0=-2, y1=3)} SELECT G.x, G.y, coalesce(v, 0) AS v FROM G LEFT JOIN E ON G.x = E.x AND G.y = E.y")
def pad_const(s, d):
    a = emb(s, d)
    return ri.copy(a, ri.identity(a.box), _grown(a, 3, 2), 0)


@query(f"WITH {E} SELECT x, y, CASE WHEN x BETWEEN 1 AND 8 AND y BETWEEN 2 AND 4 THEN v ELSE 0 END AS v FROM E")
def pad_crop(s, d):
    a = emb(s, d)
    return ri.copy(ri.crop(a, box(x=(1, 8), y=(2, 4))), ri.identity(a.box), a.box, 0)


@query(f"WITH {E} SELECT g.x, g.y, coalesce(e.v, g.v) AS v FROM E g LEFT JOIN E e ON g.x = e.x + 4 AND g.y = e.y - 3")
def pad_buffer(s, d):
    a = emb(s, d)
    return ri.copy(a, {"x": ri.Affine("x", 1, -4), "y": ri.Affine("y", 1, 3)}, a.box, a)


@query(f"WITH {E} SELECT g.x, g.y, coalesce(e.v, p.v) AS v FROM E g LEFT JOIN E e ON g.x = e.x + 4 AND g.y = e.y JOIN E p ON p.x = g.x AND p.y = 0")
def pad_broadcast_buffer(s, d):
    a = emb(s, d)
    return ri.copy(a, {"x": ri.Affine("x", 1, -4), "y": ri.Affine("y")}, a.box, ri.slice_at(a, y=0))


@query(f"WITH {E}, {H}, {GRID.format(x0=0, x1=64, y0=0, y1=1)} SELECT G.x, G.y, coalesce(v, -1) AS v FROM G LEFT JOIN E ON G.x = E.x + 2 AND G.y = E.y - 5")
def translate_pad(s, d):
    a = emb(s, d)
    first = {"x": ri.Affine("x", 1, -1), "y": ri.Affine("y", 1, 5)}
    return ri.copy(a, ri.compose(first, {"x": ri.Affine("x", 1, -1), "y": ri.Affine("y")}), a.box, -1)


@query(f"WITH {E} SELECT x, -y AS y, v FROM E")
def flip_y(s, d):
    return ri.flip(emb(s, d), "y")


@query(f"WITH {E} SELECT y AS x, x AS y, v FROM E")
def transpose(s, d):
    return ri.transpose(emb(s, d), {"x": "y", "y": "x"})


@query(f"WITH {E} SELECT x, v FROM E WHERE x = y")
def diagonal(s, d):
    return ri.diagonal(emb(s, d, rows=Interval(0, 63)), "x", "y")


@query(f"WITH {E} SELECT (x - 5) // 3 AS x, y, v FROM E WHERE (x - 5) % 3 = 0 AND x >= 5 UNION ALL SELECT -1 AS x, y, v FROM E WHERE x = 2")
def strided_copy(s, d):
    return ri.strided(emb(s, d), "x", 3, 5)


@query(f"WITH {E} SELECT x, y * 2 + k AS y, v FROM E, (SELECT unnest([0, 1])::BIGINT AS k)")
def upsample_nn(s, d):
    return ri.upsample(emb(s, d), "y")


@query(f"WITH {E} SELECT x, y // 2 AS y, v FROM E WHERE y % 2 = 0")
def downsample_pick(s, d):
    return ri.strided(emb(s, d), "y", 2)


@query(f"WITH {E} SELECT x, z, v FROM E, (SELECT unnest(range(5))::BIGINT AS z) WHERE y = 3")
def broadcast_row(s, d):
    return ri.broadcast(ri.slice_at(emb(s, d, rows=point(3)), y=3), z=Interval(0, 4))


@query(f"WITH {E} SELECT a.x, a.y, a.v - b.v AS v FROM E a JOIN E b ON a.x = b.x AND b.y = 0")
def broadcast_binary(s, d):
    a = emb(s, d)
    return ew.subtract(a, ri.slice_at(a, y=0))


@query(f"WITH {E} SELECT a.x, a.y, a.v + b.v AS v FROM E a JOIN E b ON a.y = b.y AND b.x = 0")
def broadcast_conditional(s, d):
    a = emb(s, d)
    one = ri.crop(a, Box(x=point(0), y=Interval()))
    return ew.zip_with(lambda p, q: p + q, a, ri.broadcast_like(one, a.box))


@query(f"WITH {E} SELECT x, y, v + 1 AS v FROM E UNION ALL SELECT x + 64, y, v * 2 FROM E")
def concat(s, d):
    a = emb(s, d)
    return ri.concat("x", ew.add_1(a), ew.multiply_2(a))


@query(f"WITH {E} SELECT x, y, 0::BIGINT AS z, v FROM E UNION ALL SELECT x, y, 1::BIGINT, v * v FROM E")
def stack(s, d):
    a = emb(s, d)
    return ri.stack("z", a, ew.square(a))


@query(f"WITH {E}, {H} SELECT a.x, a.y, a.v - b.v AS v FROM H, E a JOIN E b ON a.x = b.x WHERE b.y = a.y + (h + 1) // 2 AND a.y < (h + 1) // 2")
def split_diff(s, d):
    a = emb(s, d)
    low, high = ri.split(a, "y", a.box["y"].min + a.box["y"].extent // 2)
    return ew.subtract(low, high)


@query(f"WITH {E} SELECT a.x, a.v - b.v AS v FROM E a JOIN E b ON a.x = b.x WHERE a.y = 0 AND b.y = 1")
def slice_diff(s, d):
    a = emb(s, d, rows=Interval(0, 1))
    return ew.subtract(ri.slice_at(a, y=0), ri.slice_at(a, y=1))


@query(f"WITH {E}, {H} SELECT (y * 64 + x) % (h + 1) AS p, (y * 64 + x) // (h + 1) AS q, v FROM E, H")
def reshape(s, d):
    a = emb(s, d)
    return ri.reshape(a, {"p": a.box["y"].extent, "q": a.box["x"].extent})


@query(f"WITH {E} SELECT x % 8 AS p, x // 8 AS q, y, v FROM E")
def reshape_batch(s, d):
    return ri.reshape(emb(s, d), {"p": 8, "q": 8}, batch=("y",))


@query(f"WITH {E} SELECT x % 4 AS xi, y % 4 AS yi, x // 4 AS xo, y // 4 AS yo, v FROM E")
def tile(s, d):
    return ri.tile(emb(s, d), 4)


@query(f"WITH {E} SELECT x, y, v FROM E")
def untile(s, d):
    return ri.untile(ri.tile(emb(s, d), 4), 4)


_IM = "SELECT o.x, k.dx, v FROM (SELECT unnest(range(((SELECT max(x) FROM V) - 6) // 2 + 1))::BIGINT AS x) o, (SELECT unnest(range(3))::BIGINT AS dx) k JOIN V ON V.x = o.x * 2 + k.dx * 3"


@query(f"WITH {V} {_IM}")
def im2col(s, d):
    return ri.im2col(fr.events(s, d), {"x": (2, 3, 3)})


@query(f"WITH {V} SELECT x, sum(v)::BIGINT AS v FROM ({_IM}) GROUP BY x")
def im2col_reduce(s, d):
    return rd.total(ri.im2col(fr.events(s, d), {"x": (2, 3, 3)}), "dx")


@query(f"WITH {E}, {H} SELECT a.x - dx AS x, a.y - dy AS y, dx, dy, v FROM H, E a, (SELECT unnest(range(2))::BIGINT AS dx) p, (SELECT unnest(range(2))::BIGINT AS dy) q WHERE a.x - dx BETWEEN 0 AND 62 AND a.y - dy BETWEEN 0 AND h - 1")
def im2col_2d(s, d):
    return ri.im2col(emb(s, d), {"x": (1, 1, 2), "y": (1, 1, 2)})


@query(f"WITH {N}, M AS (SELECT x, y, v FROM N) SELECT g.x, g.y, coalesce(M.v, -1) AS v FROM (SELECT a.x, b.y FROM (SELECT unnest(range(-1, 6))::BIGINT AS x) a, (SELECT unnest(range(-1, 6))::BIGINT AS y) b) g LEFT JOIN M ON g.x = M.x AND g.y = M.y")
def pad_constant_array(s, d):
    a = fr.nation_grid(s, d)
    return ri.copy(a, ri.identity(a.box), _grown(a, 1, 1), -1)


@query(f"WITH {E}, T AS (SELECT x, v FROM E WHERE y = 0 AND x <= 1) SELECT g.x, coalesce(a.v, 0) - coalesce(b.v, 0) AS v FROM (SELECT unnest(range(10))::BIGINT AS x) g LEFT JOIN T a ON a.x = g.x - 6 LEFT JOIN T b ON b.x = g.x - 4")
def two_shifts(s, d):
    a = ri.slice_at(emb(s, d, rows=point(0), cols=Interval(0, 1)), y=0)
    out = box(x=(0, 9))
    return ew.subtract(ri.copy(a, {"x": ri.Affine("x", 1, -6)}, out, 0), ri.copy(a, {"x": ri.Affine("x", 1, -4)}, out, 0))


@query("SELECT x, y, y * 1000 + x AS v FROM (SELECT unnest(range(40))::BIGINT AS x) a, (SELECT unnest(range(30))::BIGINT AS y) b")
def generator(s, d):
    return fr.generate(s, box(x=(0, 39), y=(0, 29)), F.col("y") * 1000 + F.col("x"))


# -- products and reductions --------------------------------------------------------------------------------------------
@query(f"WITH {N}, P AS (SELECT p_partkey AS i, CAST(p_size AS BIGINT) AS v FROM part) SELECT i, x, y, (P.v + 1) * (N.v + 1) AS v FROM P, N")
def outer_product(s, d):
    part = ri.transpose(fr.column_array(s, d, "part", "p_partkey", F.col("p_size").cast("long")), {"x": "i"})
    return ew.outer_product(ew.add_1(part), ew.add_1(fr.nation_grid(s, d)))


def _left(s, d) -> ArrayFrame:
    return ri.transpose(emb(s, d), {"x": "k", "y": "i"})


def _right(s, d) -> ArrayFrame:
    """Square, so that it has a row for each of the 64 columns of the left side."""
    return ri.transpose(emb(s, d, rows=Interval(0, 63)), {"x": "j", "y": "k"})


_MM = "SELECT a.y AS i, b.x AS j, sum(a.v * b.v)::BIGINT AS v FROM E a JOIN E b ON a.x = b.y GROUP BY 1, 2"


@query(f"WITH {E} {_MM}")
def matmul(s, d):
    return rd.matmul(_left(s, d), _right(s, d))


@query(f"WITH {E}, M AS ({_MM}) SELECT i, c.x AS j, sum(M.v * c.v)::BIGINT AS v FROM M JOIN E c ON c.y = M.j GROUP BY 1, 2")
def matmul_chain(s, d):
    ab = ri.transpose(rd.matmul(_left(s, d), _right(s, d)), {"i": "i", "j": "k"})
    return rd.matmul(ab, _right(s, d))


@query(f"WITH {E} SELECT y, sum(v)::BIGINT AS v FROM E GROUP BY y")
def sum_dim(s, d):
    return rd.total(emb(s, d), "x")


@query(f"WITH {E} SELECT 0::BIGINT AS grain, y, sum(v)::BIGINT AS v FROM E GROUP BY y UNION ALL SELECT 1, 0, sum(v)::BIGINT FROM E")
def sum_two_grains(s, d):
    return rd.grains(emb(s, d), ["y"], [])


@query(f"WITH {E} SELECT y, max(v) AS v FROM E GROUP BY y")
def max_dim(s, d):
    return rd.greatest(emb(s, d), "x")


@query(f"WITH {E} SELECT y, bit_xor(v & 65535)::BIGINT AS v FROM E GROUP BY y")
def xor_dim(s, d):
    return rd.xor(emb(s, d), "x", bits=16)


@query(f"WITH {E} SELECT x, y, v - (sum(v) OVER (PARTITION BY x) + 1)::BIGINT AS v FROM E")
def center_diff(s, d):
    return rd.centered(emb(s, d), "y")


@query("WITH K AS (SELECT unnest(range((SELECT max(l_linenumber) FROM lineitem) - (SELECT min(l_linenumber) FROM lineitem) + 1))::BIGINT + (SELECT min(l_linenumber) FROM lineitem) AS y) SELECT y, coalesce(v, 0)::BIGINT AS v FROM K LEFT JOIN (SELECT l_linenumber AS k, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1) ON y = k")
def sum_sparse(s, d):
    li = fr.read(s, d, "lineitem")
    return rd.total(fr.scatter(li, {"x": F.col("l_orderkey"), "y": F.col("l_linenumber")}, F.col("l_quantity").cast("long")), "x")


@query("SELECT l_orderkey AS x, CAST(l_linenumber AS BIGINT) AS y, sum(CAST(l_quantity AS BIGINT))::BIGINT AS v FROM lineitem GROUP BY 1, 2")
def scatter_lineitem(s, d):
    li = fr.read(s, d, "lineitem")
    return fr.scatter(li, {"x": F.col("l_orderkey"), "y": F.col("l_linenumber")}, F.col("l_quantity").cast("long"))


@query(f"WITH {R}, M AS (SELECT *, exp(v + 1 - max(v + 1) OVER (PARTITION BY y)) AS e FROM R) SELECT x, y, round(e / sum(e) OVER (PARTITION BY y) + 1, 6) AS v FROM M")
def softmax(s, d):
    return sixth(ew.add_1(rd.softmax(ew.add_1(emb(s, d, real=True)), "x")))


@query(f"WITH {R} SELECT x, y, round(v / sqrt(sum(v * v) OVER (PARTITION BY y)), 6) AS v FROM R")
def l2_norm(s, d):
    return sixth(rd.l2_normalize(emb(s, d, real=True), "x"))


@query(f"WITH {R}, S AS (SELECT y, 1 / sqrt(sum(v * v)) AS r FROM R GROUP BY y) SELECT x, y, round(v * r, 6) AS v FROM R JOIN S USING (y)")
def l2_norm_stages(s, d):
    a = emb(s, d, real=True)
    return sixth(ew.multiply(a, ew.reciprocal_sqrt(rd.total(ew.square(a), "x"))))


# -- stencils -----------------------------------------------------------------------------------------------------------
def _rect(src: str, dx: tuple[int, int], dy: tuple[int, int]) -> str:
    n = (dx[1] - dx[0] + 1) * (dy[1] - dy[0] + 1)
    return f"SELECT x - dx AS x, y - dy AS y, sum(v)::BIGINT AS v FROM {src}, (SELECT unnest(range({dx[0]}, {dx[1] + 1}))::BIGINT AS dx) p, (SELECT unnest(range({dy[0]}, {dy[1] + 1}))::BIGINT AS dy) q GROUP BY 1, 2 HAVING count(*) = {n}"


@query(f"WITH {E} {_rect('E', (-1, 1), (-1, 1))}")
def sum3x3(s, d):
    """Through the planner: the input is read where the output needs it."""
    src = emb(s, d)
    a, out = Buffer("in", ("x", "y")), Buffer("out", ("x", "y"))
    Stage(lambda i: st.square_sum(i, 1), [(a, halo(x=(-1, 1), y=(-1, 1)))], [out], "sum3x3")
    want = Box(x=Interval(1, 62), y=Interval(src.box["y"].min + 1, src.box["y"].max - 1))
    return Pipeline([a], [out]).evaluate({"out": want}, {"in": src})["out"]


@query(f"WITH {E} {_rect('E', (-2, 2), (-2, 2))}")
def sum5x5(s, d):
    return st.square_sum(emb(s, d), 2)


@query(f"WITH {E} {_rect('E', (-1, 3), (0, 1))}")
def sum_rectangle(s, d):
    return st.rectangle_sum(emb(s, d), {"x": (-1, 3), "y": (0, 1)})


@query(f"WITH {E} {_rect('E', (-1, 1), (-1, 1))}")
def sum_separable(s, d):
    return st.rectangle_sum(st.rectangle_sum(emb(s, d), {"x": (-1, 1)}), {"y": (-1, 1)})


@query(f"WITH {E} SELECT x - dx AS x, y - dy AS y, sum(v * w)::BIGINT AS v FROM E, (VALUES (0::BIGINT, 0::BIGINT, 4::BIGINT), (1, 0, -1), (-1, 0, -1), (0, 1, -1), (0, -1, -1)) t(dx, dy, w) GROUP BY 1, 2 HAVING count(*) = 5")
def weighted_taps(s, d):
    return st.scatter_sum(emb(s, d), [{}, {"x": 1}, {"x": -1}, {"y": 1}, {"y": -1}], [4, -1, -1, -1, -1])


@query(f"WITH {E}, A AS (SELECT x, y, v + 1 AS v FROM E), B AS ({_rect('A', (-1, 1), (-1, 1))}) {_rect('B', (-1, 1), (-1, 1))}")
def stencil_chain(s, d):
    return st.square_sum(st.square_sum(ew.add_1(emb(s, d)), 1), 1)


@query(f"WITH {E}, A AS ({_rect('E', (-1, 1), (-1, 1))}), B AS ({_rect('E', (-2, 2), (-2, 2))}) SELECT x, y, A.v - B.v AS v FROM A JOIN B USING (x, y)")
def stencil_diff(s, d):
    """A diamond through the planner: the input's need is the hull of both consumers'."""
    src = emb(s, d)
    a, p, q, out = (Buffer(n, ("x", "y")) for n in ("in", "p", "q", "out"))
    Stage(lambda i: st.square_sum(i, 1), [(a, halo(x=(-1, 1), y=(-1, 1)))], [p], "sum3x3")
    Stage(lambda i: st.square_sum(i, 2), [(a, halo(x=(-2, 2), y=(-2, 2)))], [q], "sum5x5")
    Stage(ew.subtract, [(p, pointwise), (q, pointwise)], [out], "subtract")
    want = Box(x=Interval(2, 61), y=Interval(src.box["y"].min + 2, src.box["y"].max - 2))
    return Pipeline([a], [out]).evaluate({"out": want}, {"in": src})["out"]


@query(f"WITH {E}, {H}, {GRID.format(x0=-1, x1=65, y0=-1, y1=2)}, A AS (SELECT G.x, G.y, coalesce(v + 1, 6) AS v FROM G LEFT JOIN E ON G.x = E.x AND G.y = E.y) {_rect('A', (-1, 1), (-1, 1))}")
def padded_sum3x3(s, d):
    return st.padded_sum(ew.add_1(emb(s, d)), 1, 6)


@query(f"WITH {E}, A AS ({_rect('E', (-1, 1), (-1, 1))}) SELECT x + 3 AS x, y - 2 AS y, v FROM A")
def stencil_translated(s, d):
    return ri.translate(st.square_sum(emb(s, d), 1), x=3, y=-2)


@query(f"WITH {V} SELECT x - k AS x, sum(v)::BIGINT AS v FROM V, (SELECT unnest(range(-1, 2))::BIGINT AS k) GROUP BY 1 HAVING count(*) = 3")
def halo_stencil_1d(s, d):
    return st.chunked_sum(fr.events(s, d), "x", -1, 1, chunk=1000)


@query(f"WITH {O} SELECT x - k AS x, sum(v)::BIGINT AS v FROM O, (SELECT unnest(range(0, 7))::BIGINT AS k) GROUP BY 1 HAVING count(*) = 7")
def trailing_sum_1d(s, d):
    return st.chunked_sum(fr.orders(s, d), "x", 0, 6)


_DOWN = "SELECT x // 2 AS x, y // 2 AS y, (sum(v) + 2)::BIGINT // 4 AS v FROM {a} GROUP BY 1, 2 HAVING count(*) = 4"
_UP = "SELECT f.x, f.y, (any_value(f.v) + sum(c.v))::BIGINT AS v FROM {f} f, (SELECT unnest([0, 1])::BIGINT AS dx) p, (SELECT unnest([0, 1])::BIGINT AS dy) q JOIN {c} c ON c.x = (f.x + dx) // 2 AND c.y = (f.y + dy) // 2 GROUP BY f.x, f.y HAVING count(*) = 4"


@query(f"WITH {E} {_DOWN.format(a='E')}")
def down2x(s, d):
    return rd.box_downsample(emb(s, d))


@query(f"WITH {E}, C AS ({_DOWN.format(a='E')}) {_UP.format(f='E', c='C')}")
def pyramid_up(s, d):
    a = emb(s, d)
    return st.pyramid_up(a, rd.box_downsample(a))


@query(f"WITH {E}, L1 AS ({_DOWN.format(a='E')}), L2 AS ({_DOWN.format(a='L1')}), L3 AS ({_DOWN.format(a='L2')}), L4 AS ({_DOWN.format(a='L3')}), U3 AS ({_UP.format(f='L3', c='L4')}), U2 AS ({_UP.format(f='L2', c='U3')}), U1 AS ({_UP.format(f='L1', c='U2')}) {_UP.format(f='E', c='U1')}")
def pyramid4(s, d):
    levels = [emb(s, d)]
    for _ in range(4):
        levels.append(rd.box_downsample(levels[-1]))
    up = levels.pop()
    while levels:
        up = st.pyramid_up(levels.pop(), up)
    return up


# -- pipelines ----------------------------------------------------------------------------------------------------------
@query(f"WITH {E}, S AS (SELECT y, sum(v + 5)::BIGINT AS t FROM E GROUP BY y) SELECT x, y, (v + 5) * 10 - t AS v FROM E JOIN S USING (y)")
def planned_multi_output(s, d):
    """Scalar argument, derived scalar, two outputs of one stage, one of them broadcast."""
    src = emb(s, d)
    a, one, row, out = Buffer("in", ("x", "y")), Buffer("one", ("x", "y")), Buffer("row", ("y",)), Buffer("out", ("x", "y"))

    def both(i: ArrayFrame, k: int, _: int):
        plus = ew.apply(i, lambda v: v + k)
        return plus, rd.total(plus, "x")

    Stage(both, [(a, pointwise)], [one, row], "both")
    Stage(lambda p, r, _, twice: ew.zip_with(lambda v, t: v * twice - t, p, r), [(one, pointwise), (row, lambda o: o.without("x"))], [out], "scale")
    p = Pipeline([a], [out], ("k",), {"twice": lambda v: v["k"] * 2})
    return p.evaluate({"out": src.box}, {"in": src}, {"k": 5})["out"]


@query("SELECT event_type, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, count(*) AS n, sum(CAST(floor(value * 1000) AS BIGINT))::BIGINT AS total FROM events GROUP BY 1, 2")
def windowed_events(s, d):
    """The batch form of the streaming extension."""
    from .streaming.sliding import windowed_sum

    return windowed_sum(fr.read(s, d, "events")).withColumn("start", F.unix_timestamp("start"))


from . import catalogue_plans  # noqa: E402, F401  registers the rest
