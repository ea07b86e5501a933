import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, d string, k int, f string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]); with extra columns whose names operators use inside."""

    def build(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", 1, "z") for r in rows]
        return spark.createDataFrame(rows, DOC)

    return build


@pytest.fixture(scope="session")
def label(spark):
    def build(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return build


@pytest.fixture(scope="session")
def real(spark, small):
    """Rows of the small documents table, and of its labels."""
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    return docs, {r.doc_id: r for r in labels}
