"""Array frames: one bigint column a dimension, one value column ``v``, and a box known on the driver.

Coordinates are unique and total over the box, unless the frame says it is sparse.  A broadcast dimension is an absent
column.  Strides, folds and storage have no place here: they are physical.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.interval import Box, Interval


@dataclass(frozen=True)
class ArrayFrame:
    df: DataFrame
    box: Box
    sparse: bool = False
    # Where the values come from, if they are a function of those of one frame, each moved by a fixed step: arrays of the
    # same origin meet in a projection or a window instead of a join.
    root: DataFrame | None = field(default=None, compare=False, repr=False)
    fn: Callable[[Column], Column] | None = field(default=None, compare=False, repr=False)
    shift: tuple[tuple[str, int], ...] = field(default=(), compare=False, repr=False)

    @property
    def origin(self) -> DataFrame:
        return self.df if self.root is None else self.root

    def of_origin(self, v: Column) -> Column:
        """The value, from that of the origin."""
        return v if self.fn is None else self.fn(v)

    @property
    def dims(self) -> list[str]:
        return list(self.box)

    def value(self, v: Column) -> ArrayFrame:
        return ArrayFrame(self.df.select(*self.dims, v.alias("v")), self.box, self.sparse)

    def check_total(self) -> bool:
        """Is there one row for each coordinate of the box?"""
        n, d = self.df.agg(F.count("*"), F.count_distinct(*self.dims)).first() if self.dims else (self.df.count(),) * 2
        return n == d == self.box.volume


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured(df: DataFrame, dims: list[str]) -> Box:
    """The box of a frame whose bounds are not known: one aggregate over the dimensions alone."""
    row = df.agg(*[f(d) for d in dims for f in (F.min, F.max)]).first()
    return Box({d: Interval(*(row[2 * i : 2 * i + 2] if row[2 * i] is not None else (0, -1))) for i, d in enumerate(dims)})


def quantized(v: Column) -> Column:
    return F.floor(v.cast("double") * 1000).cast("long")


def embeddings(spark: SparkSession, sf_dir: str, rows: Interval | None = None, cols: Interval = Interval(0, 63), real: bool = False) -> ArrayFrame:
    """x: position, y: vec_id.  rows are pushed to the scan; cols are cut before the vector is exploded."""
    src = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    if rows is not None:
        src = src.where(rows.holds(F.col("vec_id")))
    have = measured(src, ["vec_id"])["vec_id"]
    part = F.slice("embedding", cols.min + 1, cols.extent)
    df = src.select(F.col("vec_id").alias("y"), F.posexplode(part).alias("p", "e")).select((F.col("p") + cols.min).cast("long").alias("x"), "y", (F.col("e").cast("double") if real else quantized(F.col("e"))).alias("v"))
    return ArrayFrame(df, Box(x=cols, y=have if rows is None else rows & have))


def column_array(spark: SparkSession, sf_dir: str, table: str, key: str, value: Column, within: Interval | None = None) -> ArrayFrame:
    """A dense column as an array along its key."""
    src = read(spark, sf_dir, table)
    if within is not None:
        src = src.where(within.holds(F.col(key)))
    df = src.select(F.col(key).cast("long").alias("x"), value.alias("v"))
    return ArrayFrame(df, measured(df, ["x"]))


def events(spark: SparkSession, sf_dir: str, within: Interval | None = None) -> ArrayFrame:
    return column_array(spark, sf_dir, "events", "event_id", quantized(F.col("value")), within)


def orders(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    return column_array(spark, sf_dir, "orders", "o_orderkey", quantized(F.col("o_totalprice")))


def nation_grid(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    """A small constant: 5 by 5."""
    df = read(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).cast("long").alias("x"), F.expr("n_nationkey div 5").cast("long").alias("y"), F.col("n_regionkey").cast("long").alias("v"))
    return ArrayFrame(df, Box(x=Interval(0, 4), y=Interval(0, 4)))


def scatter(df: DataFrame, dims: dict[str, Column], value: Column, how=F.sum) -> ArrayFrame:
    """Rows whose coordinates repeat: reduced to one value a coordinate first.  The result is sparse."""
    rows = df.select(*[c.cast("long").alias(d) for d, c in dims.items()], value.alias("v"))
    return ArrayFrame(rows.groupBy(*dims).agg(how("v").alias("v")), measured(rows, list(dims)), sparse=True)


def domain(spark: SparkSession, box: Box) -> DataFrame:
    """All coordinates of a box: the longest dimension is dealt over the cluster, the others are exploded in place."""
    dims = sorted(box, key=lambda d: -box[d].extent)
    if not dims:
        return spark.range(1).select()
    first = box[dims[0]]
    df = spark.range(first.min, first.max + 1).withColumnRenamed("id", dims[0])
    for d in dims[1:]:
        if box[d].empty:
            df = df.limit(0).withColumn(d, F.lit(0).cast("long"))
        else:
            df = df.withColumn(d, F.explode(F.sequence(F.lit(box[d].min).cast("long"), F.lit(box[d].max).cast("long"))))
    return df.select(*box)


def generate(spark: SparkSession, box: Box, formula: Column) -> ArrayFrame:
    """A producer without inputs: a formula over the coordinates."""
    return ArrayFrame(domain(spark, box).select(*box, formula.alias("v")), box)


def constant(spark: SparkSession, rows: list[tuple], dims: list[str]) -> ArrayFrame:
    """A small array given by value: (coordinates..., value).  No rows: an empty box; no dimensions: a scalar."""
    df = spark.createDataFrame(rows, ", ".join(f"{d} long" for d in [*dims, "v"]))
    return ArrayFrame(df, Box({d: Interval(min((r[i] for r in rows), default=0), max((r[i] for r in rows), default=-1)) for i, d in enumerate(dims)}))


def scalar(spark: SparkSession, v: int) -> ArrayFrame:
    """An array without dimensions."""
    return constant(spark, [(v,)], [])


def write(a: ArrayFrame, path: str) -> None:
    a.df.write.mode("overwrite").parquet(path)
