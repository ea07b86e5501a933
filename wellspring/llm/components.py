"""Connected components of an edge table, in rounds of large-star and small-star.

Each round is two shuffles over the edges that are left; the number of rounds grows with the logarithm of the longest
path, not with its length.  Nothing goes to the driver but one count and one sum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

MOST_ROUNDS = 60


def _hub(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links (u, v) with m: the least of u and all its v.  The minimum is pre-aggregated and joined back, so that a hub
    with very many links can be split."""
    least = materialize(spark, links.groupBy("u").agg(F.min("v").alias("m")))
    return links.join(least.select("u", F.least("u", "m").alias("m")), "u")


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges: (a, b) of one ordered type, in any direction.  Returns (node, root): root is the least
    node reachable; a node that is its own root has no row."""
    edges = materialize(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hub(spark, both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(spark, large)
        hub = _hub(spark, large)
        small = hub.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hub.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(spark, small)
        # With the number of links and this sum unchanged, every node hangs on its root.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
