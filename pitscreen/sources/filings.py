"""Regulatory filings from parallel arrays to rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import split_list

FORMS = ("8-K", "10-K", "10-Q")
FIELDS = ("form", "filingDate", "items", "accessionNumber", "primaryDocument")


def filing_rows(blocks: DataFrame) -> DataFrame:
    """blocks(ticker, form[], filingDate[], items[], accessionNumber[], primaryDocument[]) to one row per filing.
    Arrays may be shorter than `form`; what is missing counts as empty."""
    arrays = F.arrays_zip(*FIELDS)
    df = blocks.select("ticker", F.explode(arrays).alias("_f")).where(F.col("_f.form").isin(*FORMS))
    text = lambda f: F.coalesce(F.col(f"_f.{f}"), F.lit(""))
    return df.select("ticker", F.col("_f.form").alias("form"), F.try_to_date(text("filingDate")).alias("filing_date"),
                     split_list(F.col("_f.items")).alias("items"), text("accessionNumber").alias("accession"),
                     text("primaryDocument").alias("document"))


def merge_shards(recent: DataFrame, *older: DataFrame) -> DataFrame:
    """Recent block plus older shards, one row per accession."""
    out = filing_rows(recent)
    for shard in older:
        out = out.unionByName(filing_rows(shard))
    return out.dropDuplicates(["ticker", "accession"])
