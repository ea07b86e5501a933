"""An extension: sums of an endless one-dimensional array over tumbling ranges of its coordinate.

Late values are taken until the watermark passes their range; state is dropped then, so it stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_sum(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(event_type, start, n, total): values quantized to thousandths, so sums do not depend on their order."""
    v = F.floor(F.col("value") * 1000).cast("long")
    if dict(events.dtypes)["ts"] == "timestamp_ntz":  # a watermark needs an instant; read it as UTC, whatever the session's zone
        events = events.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"))
    got = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(v).alias("total"))
    return got.select("event_type", F.col("w.start").alias("start"), "n", "total")
