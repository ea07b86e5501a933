"""Toxicity: a classifier chain of linear models over categories.

The categories are predicted one after the other; each model sees the words of the document, their beginnings and
the probabilities of the categories before it.  While training, those are out-of-fold predictions, so that a later model does not lean on
probabilities that an earlier one has fitted to the very row.  The last category is ``toxic`` itself, the labelled
column; a document is rejected if its probability reaches the threshold, which is calibrated on out-of-fold predictions so
that clean rows stay below it: the fewer the labels, the more careful it gets.

Training is bounded: ``SAMPLE`` labelled documents at most, chosen by a hash of their id.  The terms are all words and word
beginnings that tell the two labels apart by more than chance allows; terms that the very same rows hold are one column.
The table ``labels`` names no categories but toxic, so the earlier ones are found in it: the toxic rows of the sample are
clustered by their terms, and each of the ``CLUSTERS`` kinds of toxic text is a category.

Defined cases: null and empty texts have no words and the score of the intercepts; without labelled rows of both kinds
nothing is rejected (all probabilities 0); of rows that repeat an id the one with the least text trains, and of equal
texts one; repeated rows score alike; extra columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, small_batches, table, texts

SAMPLE = 10_000  # labelled documents that training takes at most
FOLDS = 4
CLEAN = 0.999  # share of clean training rows whose out-of-fold probability must lie below the threshold
LOWEST, HIGHEST = 0.2, 0.9  # bounds of the threshold
MIN_SUPPORT = 4
PREFIXES = (3, 4, 5, 6, 7, 8)
CLUSTERS = 3
CATEGORIES = (*[f"kind{i + 1}" for i in range(CLUSTERS)], "toxic")
_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> set[str]:
    """Words, and their beginnings of PREFIXES characters marked by a star: unseen words share these with known ones."""
    own = set(_WORDS.findall(text.lower()))
    return own.union(*[{w[:k] + "*" for w in own if len(w) > k} for k in PREFIXES])


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 0.03, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each solved by conjugate gradients over the entries that are not zero, so
    that many terms of few rows cost little; the last weight is the intercept."""
    n, p = len(x), x.shape[1] + 1
    row, col = np.nonzero(x)
    value = np.concatenate([x[row, col], np.ones(n)])
    row, col = np.concatenate([row, np.arange(n)]), np.concatenate([col, np.full(n, p - 1)])
    ridge = np.full(p, l2)
    ridge[-1] = 1e-3
    w = np.zeros(p)

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * v[col], minlength=n)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(col, value * r[row], minlength=p)

    for _ in range(steps):
        prob = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        q = prob * (1 - prob)
        scale = np.bincount(col, value * value * q[row], minlength=p) + ridge
        r = back(prob - y) + ridge * w
        step, z = np.zeros(p), r / scale
        d, rz = z.copy(), r @ z
        enough = 1e-14 * max(rz, 1e-300)
        for _ in range(2 * p):
            if rz <= enough:
                break
            hd = back(q * times(d)) + ridge * d
            alpha = rz / (d @ hd)
            step += alpha * d
            r -= alpha * hd
            z = r / scale
            rz, before = r @ z, rz
            d = z + rz / before * d
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    """terms: column of each term; weights: one vector a category, in the order of the chain."""

    terms: dict[str, int]
    weights: list[np.ndarray]
    threshold: float = 0.5

    def features(self, found: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(found), max(self.terms.values(), default=-1) + 1))
        for i, own in enumerate(found):
            x[i, own] = 1
        return x

    def score(self, many: list[str]) -> np.ndarray:
        """Probabilities, a column for each category."""
        known, column = self.terms.keys(), self.terms
        x = self.features([[column[w] for w in words(t) & known] for t in many])
        out = np.zeros((len(many), len(CATEGORIES)))
        if not self.weights:
            return out
        for k, w in enumerate(self.weights):
            out[:, k] = probability(x, w)
            x = np.hstack([x, out[:, k : k + 1]])
        return out


def merge_columns(terms: list[str], x: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """(column of each term, columns): terms that the same rows hold share a column."""
    columns: dict[bytes, int] = {}
    where = {t: columns.setdefault(np.packbits(x[:, i] > 0).tobytes(), len(columns)) for i, t in enumerate(terms)}
    out = np.zeros((len(x), len(columns)))
    for i, t in enumerate(terms):
        out[:, where[t]] = x[:, i]
    return where, out


def clusters(x: np.ndarray, k: int = CLUSTERS, steps: int = 30) -> np.ndarray:
    """Cluster of each row by spherical k-means; rare columns count more.  It starts from rows as far apart as can be."""
    x = x * np.log(1 + len(x) / (1 + x.sum(0)))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    centres = x[[int(np.argmax(norm))]] if len(x) else x[:0]
    while 0 < len(centres) < k:
        centres = np.vstack([centres, x[[int(np.argmin((x @ centres.T).max(1)))]]])
    own = np.zeros(len(x), int)
    for _ in range(steps if len(x) else 0):
        new = np.argmax(x @ centres.T, axis=1)
        sums = np.vstack([x[new == c].sum(0) for c in range(k)])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
        if (new == own).all():
            break
        own = new
    return own


def fit_chain(terms: dict[str, int], x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
    """x: words of each row; y: a column for each category; fold: of each row."""
    weights = []
    for k in range(y.shape[1]):
        weights.append(fit_linear(x, y[:, k]))
        out = np.zeros(len(x))
        for f in range(FOLDS):
            held = fold == f
            if held.any():
                out[held] = probability(x[held], fit_linear(x[~held], y[~held, k]))
        x = np.hstack([x, out[:, None]])
    clean = out[y[:, -1] == 0]
    return Chain(terms, weights, float(np.clip(np.quantile(clean, CLEAN), LOWEST, HIGHEST)) if len(clean) else 0.5)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, y in zip(texts(batch.column("text")), batch.column("toxic").to_pylist()):
            seen[y].update(words(text))
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[0][w] for w in names], pa.int64()), pa.array([seen[1][w] for w in names], pa.int64())], ["w", "n0", "n1"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fit on at most sample labelled documents."""
    small_batches(spark)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a top-k: bounded on every executor
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = materialize(spark, rows.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")))  # copies train once; sample rows at most
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total.get(0) or not total.get(1):
        return Chain({}, [])
    counts = rows.select("text", "toxic").mapInArrow(_term_counts, "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = materialize(spark, counts.where(F.col("n0") + F.col("n1") >= MIN_SUPPORT))
    # Likelihood ratio against the base rate; of so many words, hardly one passes by chance.
    n, rate = F.col("n0") + F.col("n1"), total[1] / (total[0] + total[1])
    ratio = 2 * sum((F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * r))).otherwise(0.0) for c, r in (("n1", rate), ("n0", 1 - rate))), F.lit(0.0))
    telling = counts.where(ratio >= 2 * np.log(max(2, counts.count())) + 4).select("w").orderBy("w")
    names = [r["w"] for r in telling.collect()]  # the sample bounds them
    terms = {w: i for i, w in enumerate(names)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[terms[w] for w in words(t) & terms.keys()] for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "x"])

    got = rows.select("doc_id", "toxic", "text").mapInArrow(features, "doc_id long, toxic int, x array<int>").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))).orderBy("doc_id").collect()
    release(spark, rows, counts)
    where, x = merge_columns(names, Chain(terms, []).features([r["x"] for r in got]))
    toxic = np.array([r["toxic"] for r in got], float)
    y = np.zeros((len(x), len(CATEGORIES)))
    y[:, -1] = toxic
    y[np.flatnonzero(toxic), clusters(x[toxic > 0])] = 1
    return fit_chain(where, x, y, np.array([r["fold"] for r in got]))


def scorer(spark: SparkSession, chain: Chain):
    """A column function: text to a struct of one probability a category.  The model is of a fixed size."""
    model = spark.sparkContext.broadcast((chain.terms, chain.weights))

    @F.pandas_udf(", ".join(f"{c} double" for c in CATEGORIES))
    def score(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(Chain(*model.value).score([t or "" for t in text]), columns=list(CATEGORIES))

    return score


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, p, rejected): each row of docs as a struct, its probabilities, and the verdict."""
    chain = train(spark, docs, labels)
    got = docs.select(F.struct("*").alias("row"), scorer(spark, chain)("text").alias("p"))
    return got.withColumn("rejected", F.col("p.toxic") >= chain.threshold)


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the toxic ones; labels trains the chain."""
    return score_documents(spark, docs, labels).where(~F.col("rejected")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the category probabilities, in thousandths, and whether it is rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score_documents(spark, docs, table(spark, sf_dir, "labels"))
    return got.select(F.col("row.doc_id").alias("doc_id"), *[F.round(F.col(f"p.{c}") * 1000).cast("int").alias(f"p_{c}") for c in CATEGORIES], "rejected")
