"""SimHash near-duplicates: meet-in-the-middle ball hashing.

A fingerprint has a bit for each bit of the XXH64 (seed 42) of the document's 3-word shingles, repeats included: 1 if it
is set in over half of them.  Two fingerprints link at 2 or fewer differing bits, so they share a variant within one
flipped bit of each.  Every *distinct* fingerprint emits its 65 variants, variants meet in one shuffle, and neighbours on
a variant are verified and linked.  At most 65 distinct fingerprints can meet on one variant, so no group is large,
however many copies a document has.  Members of a variant are within 2 bits of each other, so chaining neighbours loses
no component.  Components are found by large-star and small-star rounds.

Defined cases: null and empty texts have the fingerprint zero and link like any other; fewer than three words make one
shingle of all; component_id is the least doc_id of the component (null ids do not count; null if it has no other);
rows that repeat get a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import doc_key, keyed, materialize, small_batches, table

RADIUS = 2
SEED = 42
SHINGLE = 3
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_PLACE = (np.arange(8) * 256)[None, :]


def fingerprint(raw: bytes) -> int:
    """Of a text in UTF-8."""
    words = raw.translate(_UPPER).split()  # bytes split at the six ASCII blanks only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    blank = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(blank[: n - SHINGLE] + 1).tolist()]
    ends = [*blank[SHINGLE - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("text").cast(pa.binary()).to_pylist()
        f = np.array([fingerprint(x or b"") for x in raw], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), pa.array(f, pa.int64())], ["doc_id", "k", "f"])


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, k, f): fingerprint of each row as a signed 64-bit number; k: the hash of id and text."""
    small_batches(spark)
    key = doc_key(F.col("doc_id"), F.col("text"))[1]
    return docs.select(F.col("doc_id").cast("long"), key, "text").mapInArrow(_fingerprints, "doc_id long, k long, f long")


def links(prints: DataFrame) -> DataFrame:
    """prints: distinct (f).  Returns verified (a, b), enough to connect all that link directly."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    variants = prints.select("f", F.explode(flips).alias("x")).select("f", F.col("f").bitwiseXOR(F.col("x")).alias("v"))
    near = Window.partitionBy("v").orderBy("f")
    pairs = variants.select(F.lag("f").over(near).alias("a"), F.col("f").alias("b")).where("a is not null")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def components(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, k, f) of each row, (f, root) of each distinct fingerprint)."""
    prints = materialize(spark, fingerprints(spark, docs))
    distinct = materialize(spark, prints.select("f").distinct())
    found = connected(spark, links(distinct))
    roots = distinct.join(found, distinct.f == found.node, "left").select("f", F.coalesce("root", "f").alias("root"))
    return prints, materialize(spark, roots)


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    from .components import connected_components

    return connected_components(spark, edges)


def classify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints, roots = components(spark, docs)
    least = prints.groupBy("f").agg(F.min("doc_id").alias("m")).join(roots, "f")
    ids = least.groupBy("root").agg(F.min("m").alias("component_id"))
    by_print = materialize(spark, roots.join(ids, "root").select("f", "component_id"))
    return prints.join(by_print, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the least doc_id (null last), then text hash."""
    prints, roots = components(spark, docs)
    own = prints.select(F.col("f"), *[F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "k"])
    first = own.groupBy("f").agg(F.min(F.struct("d", "k")).alias("m")).join(roots, "f")
    kept = materialize(spark, first.groupBy("root").agg(F.min("m").alias("m")).select("m.d", "m.k"))
    got = keyed(docs).drop("text").join(kept, ["d", "k"]).dropDuplicates(["d", "k"])  # rows that repeat, combined before the shuffle
    return got.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, table(spark, sf_dir, "documents"))
