"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes.

1. Equal vectors become one representative with its ``TOP + 1`` least ids: no more of them can be among the nearest, so
   nothing is lost, and a vector that a third of all rows share costs one row.
2. Codes: vectors are completed to one length (so that the largest inner product becomes the smallest angle), rotated by
   ``TABLES`` rotations learned by iterative quantization on at most ``SAMPLE`` representatives, and cut to signs.
3. The Hamming radius is calibrated, not guessed: at most ``PROBES`` representatives are searched exactly against *all*
   rows, and the radius takes ``COVER`` of their true neighbours' codes.
4. Codes are split into substrings of ``BITS`` bits, each indexed.  Within radius r some substring differs in at most
   r // substrings bits, so probing each index at that distance retrieves every code within r; the rest is verified by
   its full distance and reranked by the inner product of the original vectors in double precision.

The index is a table: a row for each substring of each representative, keyed by the substring's number and value.  Queries
are rows for each value to probe, and both meet in one shuffle on that key.  Only queries that find fewer than they should
are then compared with all rows, in blocks of bounded size.

Probing pays only where it rules most rows out, which the calibrated radius tells beforehand: the share of values that a
probe admits, summed over the substrings.  Where that is more than ``ADMITS``, the radius itself takes in a large part of
the rows, and all queries go to the blocks, in which the same index is searched.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, and neither do rows without an id; an id with several vectors stands for the least of them (repeated rows are one);
the nearest come first, ties to the smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small_batches, table

TOP = 20
EVERY = 20  # queries: ids divisible by this
SAMPLE = 4_000
PROBES = 200
COVER = 0.97
TABLES = 2
BITS = 16
ADMITS = 0.1  # share of all rows that probing may retrieve; above it, rows are compared in blocks
CANDIDATES, QUERIES = 65_536, 8_192  # rows of a block at most, about
LEAST_BLOCKS = 8
_ONES = np.bitwise_count(np.arange(1 << BITS, dtype=np.uint32)).astype(np.uint8)


@dataclass
class Codes:
    """mean, rotations and the length to which vectors are completed."""

    mean: np.ndarray
    turns: np.ndarray
    longest: float

    def of(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Signs as substrings of BITS bits: one row a vector."""
        norm = np.linalg.norm(x, axis=1)
        if query:
            y = np.hstack([x / norm[:, None], np.zeros((len(x), 1))])
        else:
            y = np.hstack([x, np.sqrt(np.maximum(self.longest**2 - norm**2, 0))[:, None]]) / self.longest
        signs = ((y - self.mean) @ self.turns) > 0
        pad = -signs.shape[1] % BITS
        return np.packbits(np.pad(signs, ((0, 0), (0, pad))), axis=1).view(np.uint16)


def learn(x: np.ndarray, longest: float, seed: int = 5, rounds: int = 30) -> Codes:
    """Iterative quantization: rotate so that the vectors lie near the corners of the cube, from TABLES random starts."""
    norm = np.linalg.norm(x, axis=1)
    y = np.hstack([x, np.sqrt(np.maximum(longest**2 - norm**2, 0))[:, None]]) / longest
    mean = y.mean(0)
    z = y - mean
    _, s, axes = np.linalg.svd(z, full_matrices=False)
    keep = min(x.shape[1], int((s > 1e-9 * max(s[0], 1e-30)).sum()) or 1)
    axes = axes[:keep].T
    rng, turns = np.random.default_rng(seed), []
    for _ in range(TABLES):
        r = np.linalg.qr(rng.standard_normal((keep, keep)))[0]
        v = z @ axes
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        turns.append(axes @ r)
    return Codes(mean, np.hstack(turns), longest)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        out += _ONES[a[:, k, None] ^ b[None, :, k]]
    return out


class MultiIndex:
    """An index for each substring of the codes of a block."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = [np.unique(codes[:, k], return_inverse=True) for k in range(codes.shape[1])]

    def within(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, distances) of every code within the radius of one code."""
        flips = radius // len(self.parts)
        near = np.zeros(len(self.codes), bool)
        for k, (values, where) in enumerate(self.parts):
            near |= (_ONES[values ^ q[k]] <= flips)[where]
        at = np.flatnonzero(near)
        d = _ONES[self.codes[at] ^ q].sum(1, dtype=np.int64)
        ok = d <= radius
        return at[ok], d[ok]

    def search(self, q: np.ndarray, radius: int, least: int) -> np.ndarray:
        """Positions within the radius, or within the first wider one that has at least so many."""
        top = self.codes.shape[1] * BITS
        while True:
            at, _ = self.within(q, radius)
            if len(at) >= min(least, len(self.codes)) or radius >= top:
                return at
            radius = min(top, radius + max(1, radius // 8))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def representatives(spark: SparkSession, vectors: DataFrame, top: int) -> tuple[DataFrame, DataFrame, int]:
    """((vec_id, v) of each id that takes part, (v, ids) of each distinct vector, dimension)."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = materialize(spark, vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if sizes is None:
        return rows, rows.select("v", F.array("vec_id").alias("ids")), 0
    rows = rows.where(F.size("v") == sizes["n"])
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    reps = materialize(spark, first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    return rows, reps, sizes["n"]


def _calibrate(spark: SparkSession, reps: DataFrame, codes: Codes, probes: np.ndarray, top: int, dim: int) -> int:
    """The radius that takes COVER of the probes' true neighbours over all representatives."""
    own = codes.of(probes, True)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            if not len(x):
                continue
            score = probes @ x.T
            n = min(top + 1, len(x))
            at = np.argpartition(-score, n - 1, axis=1)[:, :n]
            d = np.take_along_axis(hamming(own, codes.of(x, False)), at, 1)
            s = np.take_along_axis(score, at, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(probes), dtype=np.int32), n)), pa.array(s.ravel()), pa.array(d.ravel().astype(np.int32))], ["q", "s", "d"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")
    found = reps.select("v").mapInArrow(best, "q int, s double, d int")
    # The first is the probe itself.
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "d"))).where(F.col("r").between(2, top + 1))
    got = ranked.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()  # one row a distance
    small_batches(spark)
    total, seen = sum(r["n"] for r in got), 0
    for r in got:
        seen += r["n"]
        if seen >= COVER * total:
            return int(r["d"])
    return 0


def search(spark: SparkSession, vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of each row whose vec_id is divisible by every."""
    small_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows, reps, dim = representatives(spark, vectors, top)
    if not dim:
        return spark.createDataFrame([], schema)
    facts = reps.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    n, longest = facts[0], float(np.sqrt(facts[1]))
    sample = reps.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toPandas()["v"]
    x = np.array(sample.tolist(), float).reshape(-1, dim)
    codes = learn(x, longest)
    radius = _calibrate(spark, reps, codes, x[:PROBES], top, dim)
    queries = rows.where(F.col("vec_id") % every == 0)
    if admitted(radius, codes.turns.shape[1]) > ADMITS:
        return _ranked(_blocks(spark, queries, reps, codes, radius, n, dim, top), top)
    near = materialize(spark, probe(queries, reps, codes, radius, dim, top))
    # A query's own representative is among what it finds, and may be its only member: so one more than top.
    full = near.groupBy("query_id").agg(F.sum("members").alias("found")).where(F.col("found") > top).select(F.col("query_id").alias("vec_id"))
    few = materialize(spark, queries.join(full, "vec_id", "left_anti"))
    done = near.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    own = done.select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id").select("query_id", "vec_id", "score")
    return _ranked(own.unionByName(_blocks(spark, few, reps, codes, radius, n, dim, top)), top)


def admitted(radius: int, bits: int) -> float:
    """Share of all rows that probing retrieves at most, were codes evenly spread."""
    parts = -(-bits // BITS)
    return parts * sum(comb(BITS, i) for i in range(radius // parts + 1)) / 2**BITS


def _coded(frame: DataFrame, key: str, codes: Codes, query: bool, dim: int) -> DataFrame:
    """(key, code): the substrings of each vector's code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = codes.of(_matrix(batch.column("v"), dim), query).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]), pa.array(c.ravel()))], [key, "code"])

    return frame.select(key, "v").mapInArrow(run, f"{key} long, code array<int>")


def candidates(queries: DataFrame, reps: DataFrame, codes: Codes, radius: int, dim: int) -> DataFrame:
    """(query_id, rep): distinct pairs within the radius; reps: (rep, v)."""
    parts = -(-codes.turns.shape[1] // BITS)
    flips = [sum(1 << b for b in c) for n in range(radius // parts + 1) for c in combinations(range(BITS), n)]
    index = _coded(reps, "rep", codes, False, dim).select("rep", F.posexplode("code").alias("part", "value"), "code")
    asked = _coded(queries, "vec_id", codes, True, dim).select(F.col("vec_id").alias("query_id"), F.col("code").alias("own"), F.posexplode("code").alias("part", "x"))
    asked = asked.withColumn("flip", F.explode(F.array(*map(F.lit, flips)))).select("query_id", "own", "part", F.col("x").bitwiseXOR(F.col("flip")).alias("value"))
    met = asked.join(index, ["part", "value"])
    distance = F.aggregate(F.zip_with("own", "code", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    return met.where(distance <= radius).select("query_id", "rep").distinct()


def probe(queries: DataFrame, reps: DataFrame, codes: Codes, radius: int, dim: int, top: int) -> DataFrame:
    """(query_id, ids, members, score): the best representatives that probing finds for each query, ties included."""
    named = reps.select(F.col("ids")[0].alias("rep"), "ids", "v")
    pairs = candidates(queries, named, codes, radius, dim)
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    got = pairs.join(named, "rep").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").select("query_id", "ids", F.size("ids").alias("members"), score.alias("score"))
    best = got.withColumn("r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("r") <= top + 1)
    return best.drop("r")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(spark: SparkSession, queries: DataFrame, reps: DataFrame, codes: Codes, radius: int, n: int, dim: int, top: int) -> DataFrame:
    """(query_id, vec_id, score): the best of every block of representatives for each query."""
    n_c, n_q = max(LEAST_BLOCKS, -(-n // CANDIDATES)), max(1, -(-queries.count() // QUERIES))
    left = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"))
    right = reps.select("ids", "v", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), F.pmod(F.xxhash64("v"), F.lit(n_c)).cast("int").alias("cb"))

    def block(qs: pa.Table, cs: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if len(qs) and len(cs):
            q, c = _matrix(qs["v"], dim), _matrix(cs["v"], dim)
            index, probe = MultiIndex(codes.of(c, False)), codes.of(q, True)
            members = cs["ids"].to_pylist()
            least = np.array([m[0] for m in members])
            for i, own in enumerate(qs["vec_id"].to_pylist()):
                at = index.search(probe[i], radius, top + 1)
                score = (c[at] * q[i]).sum(1)
                order = np.lexsort((least[at], -score))[: top + 1] if len(at) < 4 * top else _first(score, least[at], top + 1)
                got = sorted((-float(score[o]), v) for o in order for v in members[at[o]] if v != own)[:top]
                out_q += [own] * len(got)
                out_v += [v for _, v in got]
                out_s += [-s for s, _ in got]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(block, "query_id long, vec_id long, score double")


def _first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The n best by score, then smaller id."""
    cut = -np.partition(-score, n - 1)[n - 1]
    near = np.flatnonzero(score >= cut)
    return near[np.lexsort((ids[near], -score[near]))[:n]]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
