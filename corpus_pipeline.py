"""Corpus pipeline: toxicity, line dedup, near-dedup, mixing and BPE, one after the other.

Each stage reads what the one before has written.  Toxic documents go, later repeated runs of lines go from the texts,
one document of each near-duplicate component stays, sources are mixed to their target weights (a row for each time a
document is taken), and the mix is encoded.  The last stage returns digests of the tokens; the others documents.

Every stage takes and returns documents with whatever columns they have, whatever their names; an empty table passes
through as one.  A null text counts as empty.  Rows equal in doc_id and text are one document: they are judged and cut
alike, one of them stays after near-dedup, and before that each row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wellspring.llm import bpe, line_dedup, mixing, simhash, toxicity
from wellspring.llm.common import materialize, release, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those the chain rejects; null and empty texts stay; without labels of both kinds all stay."""
    return toxicity.drop_toxic(spark, docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with later repeats cut from their texts; null texts stay null, a text that is all repeats becomes empty."""
    return line_dedup.dedup_documents(spark, docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, that of the least doc_id (null last); empty and null texts are one component."""
    return simhash.keep_one(spark, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as the mix takes them, a row for each time; texts without words are never taken; the null source is a source."""
    return mixing.mix_documents(spark, docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; a null text has no tokens."""
    return bpe.token_digests(spark, docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

ORACLE_SQL = None  # trained models, exact merges and hashes of shingles are beyond SQL; tests/llm has brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(spark, stage(spark, docs, sf_dir))
        if i:
            release(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
