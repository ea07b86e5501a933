"""Helpers shared by the training-data operators: spill tables, row keys and Arrow plumbing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST = (1 << 63) - 1  # stands for a null id in orderings, so that nulls come last


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir, which the cluster or the caller must set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of the write go as soon as it is done; the table stays until ``release``."""
    path = f"{shared_dir(spark)}/wellspring/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers that do not find it on their path."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    name = Path(tempfile.mkdtemp()) / "wellspring.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted((root / "wellspring").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(name))


_shipped: set[str] = set()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows: whole texts can be very long, so a batch must not hold many of them."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def doc_key(doc_id: Column, text: Column) -> list[Column]:
    """(d, k): the id (null last) and a hash of id and text.  Rows equal in both are the same document."""
    d = F.coalesce(doc_id.cast("long"), F.lit(LAST))
    return [d.alias("d"), F.xxhash64(d, F.coalesce(text, F.lit(""))).alias("k")]


def keyed(docs: DataFrame) -> DataFrame:
    """(d, k, text, row): the row of docs as one struct, so that extra columns cannot clash with ours."""
    return docs.select(*doc_key(F.col("doc_id"), F.col("text")), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.struct("*").alias("row"))


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def lists(flat: np.ndarray, sizes: list[int] | np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
