"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame, which is written as Parquet and read again for the next one. All
but the last return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitscreen.llm import jaccard_join, mixing, packing, quality_classifier, secret_scan
from pitscreen.llm.common import stored, table
from pitscreen.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a good grade is too low go."""
    return quality_classifier.select(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity of at least 0.8)."""
    return jaccard_join.one_per_component(docs, size=5, numerator=80, denominator=100)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, placed in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing", mix), ("packing", pack)]

#: The models and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, f"stage-{at}")
    return docs
