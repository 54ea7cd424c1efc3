"""Index-membership and rate files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.guards import number
from ..functions.scalars import split_list


def membership_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines `date,"T1,T2,..."` to (date, tickers array): headers and bad dates are
    skipped, tickers are trimmed, distinct and sorted, empty lists dropped."""
    parts = F.from_csv(column, "d string, t string", {"quote": '"', "mode": "PERMISSIVE"})
    df = lines.select(parts.alias("_p"))
    day = F.try_to_date(F.trim("_p.d"), "yyyy-MM-dd")
    tickers = F.array_sort(F.array_distinct(split_list(F.col("_p.t"))))
    return df.select(day.alias("date"), tickers.alias("tickers")).where(F.col("date").isNotNull() & (F.size("tickers") > 0))


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    return membership_lines(spark.read.text(path))


def exploded(membership: DataFrame) -> DataFrame:
    """(date, ticker) rows, the shape all universe operators take."""
    return membership.select("date", F.explode("tickers").alias("ticker"))


def members_by_add_date(constituents: DataFrame, as_of: Column) -> DataFrame:
    """constituents(symbol, date_added text): members added by `as_of`; an unreadable date counts as a member."""
    added = F.try_to_date(F.trim("date_added"), "yyyy-MM-dd")
    return constituents.withColumn("_d", added).where(F.col("_d").isNull() | (F.col("_d") <= as_of)).select("symbol")


CORRUPT = "_corrupt"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder of text columns named by its header; a line with too few or too many fields keeps its text in `_corrupt`."""
    reader = spark.read.option("header", True)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
    return reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).schema(schema).csv(path)


def corrupt_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a CSV file that its reader leaves out."""
    rows = _csv(spark, path)
    # Spark refuses a query of this column alone, which would parse no field
    return rows.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), F.col(rows.columns[0]).alias("first"))


def read_constituents(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, date_added) of a constituents file with the columns `Symbol` and `Date added`, among others."""
    rows = _csv(spark, path).where(F.col(CORRUPT).isNull() & F.col("Symbol").isNotNull())
    return rows.select(F.col("Symbol").alias("symbol"), F.col("Date added").alias("date_added"))


def rate_rows(raw: DataFrame) -> DataFrame:
    """(date, percent text) to (date, rate) as fractions; missing values are dropped."""
    return raw.select(F.try_to_date(F.col("date").cast("string")).alias("date"), (number("percent") / 100).alias("rate")).where(
        F.col("date").isNotNull() & F.col("rate").isNotNull())


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """(date, rate) of a rates file: its first two columns, a date and a percentage."""
    rows = _csv(spark, path).where(F.col(CORRUPT).isNull())
    return rate_rows(rows.select(F.col(rows.columns[0]).alias("date"), F.col(rows.columns[1]).alias("percent")))
