"""Windows along one dimension that do not run in one partition a line: long lines are cut into chunks with a halo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intmath import positive_div
from ..functions.interval import Box

CHUNK = 4096


def dealt(df: DataFrame, box: Box, d: str, low: int, high: int, chunk: int = CHUNK) -> tuple[DataFrame, list[str], Column]:
    """(rows, columns to partition by, which rows are a chunk's own) for windows that reach from low to high.

    A value near a border goes to the chunks on both sides of it.  A short line stays whole.
    """
    chunk = max(chunk, high - low)
    if box[d].bounded and box[d].extent <= chunk:
        return df, [], F.lit(True)
    low, high = min(low, 0), max(high, 0)
    first, last = positive_div(F.col(d) - high, chunk), positive_div(F.col(d) - low, chunk)
    return df.withColumn("_c", F.explode(F.sequence(first, last))), ["_c"], F.col("_c") == positive_div(F.col(d), chunk)
