"""Mixing sources to target weights: subset-sum budget fitting.

Size of a document: its words.  Sources, by code point with null last, weigh 1, 2, 3, repeating, and share all words.  A
target stops at ``MOST_EPOCHS`` times its source's words; what it cannot take is shared again by weight among the others.

A source first repeats all its documents as often as its target holds them whole.  The rest is a subset-sum problem over
*counts of documents by exact length*, in the same three steps for every source, large or small: so many of each length that
all lengths are taken evenly; lengths in a seeded order until at most ``FITTED`` words remain; and those fitted by
bounded-knapsack dynamic programming over the documents still free, in a seeded order too.  Where the sum that comes out is
not provably the nearest one, the dynamic programme gets eight times the words, at last all of them, and so is exact;
``FITTED`` bounds memory and time, not the result.  Which documents of a length are taken follows a seeded hash, so reruns
agree.

Scale: lengths are counted with partial aggregation; a source's table of lengths has at most sqrt(2 x words) rows and is
fitted in one task a source.  Sources stay a distributed table: they are numbered by a range partitioning, and their shares
settle in rounds of which only sums go to the driver.  Inside a length, documents are picked over hash buckets, so that a
length which a third of all rows share is never sorted in one task.

Defined cases: null text and blanks have size 0 and are never taken; the null source is a source of its own, last; rows
equal in id, text and source are interchangeable: together they are taken as often as the plan says; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import doc_key, keyed, materialize, small_batches, table

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = 7
BUCKETS = 1024
FITTED = 20_000  # words that the dynamic programme fits at first


def size(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def _source(name: Column) -> Column:
    """Names in their order, null last, none of them null."""
    return F.coalesce(F.concat(F.lit("+"), name.cast("string")), F.lit("-"))


def targets(sizes: list[int], weights: list[float], most: float = MOST_EPOCHS) -> list[float]:
    """Share sum(sizes) by weight, none above most times its size; the excess is shared again until none is above."""
    left, out = float(sum(sizes)), [0.0] * len(sizes)
    free = [i for i in range(len(sizes))]
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def subset_sum(lengths: list[int], counts: list[int], budget: int, over: int = 0) -> list[int]:
    """How many of each length to take so that the sum comes nearest to the budget, passing it by over at most.

    Bounded knapsack: copies of a length are bundled in powers of two, and each bundle is one pass over the reachable
    sums.  A sum remembers the bundle that reached it first; the sums on the way back were reached by earlier bundles.
    """
    size = budget + over
    reached = np.zeros(size + 1, bool)
    reached[0] = True
    by = np.full(size + 1, -1, np.int32)
    bundles: list[tuple[int, int]] = []
    for k, (n, c) in enumerate(zip(lengths, counts)):
        c, power = min(c, size // n if n else 0), 1
        while c > 0 and not reached[budget]:
            take = min(power, c)
            step = take * n
            new = np.flatnonzero(reached[:-step] & ~reached[step:]) + step
            by[new] = len(bundles)
            bundles.append((k, take))
            reached[new] = True
            c, power = c - take, power * 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    s = int(sums[np.argmin(np.abs(sums - budget))])
    out = [0] * len(lengths)
    while s:
        k, take = bundles[by[s]]
        out[k] += take
        s -= take * lengths[k]
    return out


def _fit(lengths: np.ndarray, counts: np.ndarray, total: int, left: int, even: int, most: int) -> np.ndarray:
    """Documents of each length for a budget of left words: even words evenly, and about most by dynamic programming."""
    extra = np.array([int(c) * even // total for c in counts.tolist()], np.int64)
    budget = left - int((extra * lengths).sum())
    order = np.random.default_rng(SEED).permutation(len(lengths))
    for i in order.tolist():
        if budget <= most:
            break
        n = int(min(counts[i] - extra[i], (budget - most) // lengths[i]))
        extra[i] += n
        budget -= n * int(lengths[i])
    free = (counts - extra)[order]
    # The least sum past the budget is past it by less than its shortest document, which may be the longest of all; one
    # of over twice the budget is no nearer than taking nothing.
    over = min(budget, int(lengths[order][free > 0].max(initial=0)))
    extra[order] += np.array(subset_sum(lengths[order].tolist(), free.tolist(), budget, over), np.int64)
    return extra


def plan(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """(whole repeats of all documents, documents of each length that are taken once more)."""
    total = int((lengths * counts).sum())
    whole = int(target // total) if total else 0
    left = max(0, int(round(target)) - whole * total)
    extra = np.zeros(len(lengths), np.int64)
    if total and left:
        left, even, most = min(left, total), min(left, total), FITTED
        step = int(np.gcd.reduce(lengths))  # all sums are multiples of this
        off = left % step
        least = min(off, step - off) if left - off + step <= total else off
        while True:  # where taking evenly stands in the way of the nearest sum, less is taken so, at last nothing
            extra = _fit(lengths, counts, total, left, even, most)
            if abs(int((extra * lengths).sum()) - left) <= least or not even:
                break
            even, most = max(0, left - most), most * 8
    return whole, extra


def _plan_source(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("size")
    whole, extra = plan(g["size"].to_numpy(), g["n"].to_numpy(), float(g["target"].iloc[0]))
    return pd.DataFrame({"s": g["s"], "size": g["size"], "n": g["n"], "whole": np.int32(whole), "extra": extra, "source_size": g["source_size"], "target": g["target"]})


def source_targets(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """(s, source_size, target) of each source; ``targets`` over a table."""
    sums = counts.groupBy("s").agg(F.sum(F.col("size") * F.col("n")).alias("t"))
    sums = sums.repartitionByRange("s").sortWithinPartitions("s").select("s", "t", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    sums = materialize(spark, sums)
    sizes = sorted((r["part"], r["n"]) for r in sums.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a partition
    before = [(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes]
    number = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (number % len(WEIGHTS) + 1).cast("int"))
    sums = materialize(spark, sums.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part").select("s", "t", weight.alias("w")))
    most = F.lit(float(MOST_EPOCHS)) * F.col("t")
    total = sums.agg(F.sum("t")).first()[0] or 0
    share = -1.0  # words a unit of weight; it only grows, so a source that is full stays so
    while True:
        full = most < share * F.col("w")
        held, free = sums.agg(F.sum(F.when(full, F.col("t"))), F.sum(F.when(~full, F.col("w")))).first()
        new = (total - MOST_EPOCHS * (held or 0)) / free if free else share
        if new <= share:
            break
        share = new
    full = most < share * F.col("w")
    return sums.select("s", F.col("t").alias("source_size"), F.when(full, most).otherwise(share * F.col("w")).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(d, k, s, doc_id, size, source_size, target, taken, times) of every row of docs."""
    small_batches(spark)
    slim = docs.select(*doc_key(F.col("doc_id"), F.col("text")), F.col("doc_id").cast("long").alias("doc_id"), _source(F.col("source")).alias("s"), size(F.col("text")).alias("size"))
    slim = materialize(spark, slim.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(BUCKETS)).cast("int")))
    counts = materialize(spark, slim.groupBy("s", "size").agg(F.count("*").alias("n")))
    sources = source_targets(spark, counts).hint("merge")
    fitted = counts.where("size > 0").join(sources, "s").groupBy("s").applyInPandas(_plan_source, "s string, size long, n long, whole int, extra long, source_size long, target double")
    zero = counts.where("size = 0").join(sources, "s").select("s", "size", "n", F.lit(0).alias("whole"), F.lit(0).cast("long").alias("extra"), "source_size", "target")
    fitted = materialize(spark, fitted.union(zero))
    # How far the extra documents of a length reach into its hash buckets: whole buckets, then some of the next one.
    part = fitted.where("extra > 0 and extra < n").select("s", "size", "extra").hint("merge")
    upto = Window.partitionBy("s", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = slim.groupBy("s", "size", "b").agg(F.count("*").alias("c")).join(part, ["s", "size"]).withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    edge = materialize(spark, buckets.where("before < extra and before + c >= extra").select("s", "size", F.col("b").alias("edge"), (F.col("extra") - F.col("before")).alias("some")))
    info = materialize(spark, fitted.join(edge.hint("merge"), ["s", "size"], "left"))
    got = slim.join(info.hint("merge"), ["s", "size"])
    inside = Window.partitionBy("s", "size", "b").orderBy(F.xxhash64(F.lit(seed), "k", "d"), "d", "k")
    on_edge = got.where("b = edge").withColumn("r", F.row_number().over(inside)).withColumn("one", (F.col("r") <= F.col("some")).cast("int")).drop("r")
    rest = got.where("edge is null or b <> edge").withColumn("one", F.when(F.col("edge").isNull(), F.col("extra") >= F.col("n")).otherwise(F.col("b") < F.col("edge")).cast("int"))
    rest = rest.withColumn("one", F.when(F.col("extra") > 0, F.col("one")).otherwise(0))
    return rest.unionByName(on_edge).select("d", "k", "s", "doc_id", "size", "source_size", "target", ((F.col("whole") + F.col("one")) * F.col("size")).alias("taken"), (F.col("whole") + F.col("one")).alias("times"))


def mix_documents(spark: SparkSession, docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: a row for each time a document is taken."""
    wanted = mix(spark, docs, seed).where("size > 0").groupBy("d", "k", "s").agg(F.sum("times").alias("times"), F.count("*").alias("c"))
    wanted = materialize(spark, wanted.where("times > 0"))
    rows = keyed(docs).drop("text").withColumn("s", _source(F.col("row.source")))
    got = rows.join(wanted.hint("merge"), ["d", "k", "s"])
    # Equal rows share what is taken of them; only what does not go up evenly needs them numbered.
    even = got.where("times % c = 0").select("row", (F.col("times") / F.col("c")).cast("int").alias("n"))
    once = Window.partitionBy("d", "k", "s").orderBy(F.lit(0))
    odd = got.where("times % c <> 0").withColumn("i", F.row_number().over(once))
    odd = odd.select("row", (F.floor(F.col("times") / F.col("c")) + F.when(F.col("i") <= F.col("times") % F.col("c"), 1).otherwise(0)).cast("int").alias("n"))
    got = even.union(odd).where("n > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return got.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")
