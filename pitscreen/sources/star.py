"""The library's input shapes derived from star-schema sales tables.

Every derivation is a Spark job over the whole table: an instrument is a
supplier, a bar is its shipments of one day, a filing is an order, a statement
is a supplier's year.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _price() -> Column:
    return 20 + (F.col("l_extendedprice") % 8000) / 100


def bars(spark: SparkSession, sf_dir: str, end: str | None = None, start: str | None = None) -> DataFrame:
    """bars(ticker, date, open, high, low, close, volume), unique per (ticker, date).

    The first exchange is on (ticker, date) after a map-side partial aggregate,
    so a supplier with a third of all line items is spread over its days.
    """
    li = table(spark, sf_dir, "lineitem")
    if start:
        li = li.where(F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        li = li.where(F.col("l_shipdate") < F.lit(end).cast("timestamp_ntz"))
    rows = li.select(F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"),
                     (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), _price().alias("px"),
                     F.when(F.col("l_quantity") >= 49, 2000.0).otherwise(F.col("l_quantity")).alias("qty"))
    return rows.groupBy("ticker", "date").agg(
        F.min_by("px", "seq").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", "seq").alias("close"), F.sum("qty").alias("volume"))


def benchmark(bar_rows: DataFrame) -> DataFrame:
    """Mean close per day: one row per calendar date, also the trading calendar."""
    return bar_rows.groupBy("date").agg(F.avg("close").alias("close"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """statements(ticker, suppkey, year, statement_date, filed_date, revenue, net_income, lt_debt, equity)."""
    li, ext = table(spark, sf_dir, "lineitem"), F.col("l_extendedprice")
    yearly = li.groupBy(F.col("l_suppkey").alias("suppkey"), F.year("l_shipdate").alias("year")).agg(
        F.sum(ext * (1 - F.col("l_discount"))).alias("revenue"),
        F.sum(ext * (0.05 - F.col("l_discount"))).alias("net_income"), F.sum(ext * F.col("l_tax")).alias("lt_debt"))
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), (F.col("s_acctbal") * 100).alias("equity"))
    end = F.make_date("year", F.lit(12), F.lit(31))
    return yearly.join(sup, "suppkey").select(
        F.col("suppkey").cast("string").alias("ticker"), "suppkey", "year", end.alias("statement_date"),
        F.date_add(end, (30 + F.col("suppkey") % 90).cast("int")).alias("filed_date"),
        "revenue", "net_income", "lt_debt", "equity")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts(ticker, taxonomy, concept, unit, form, fp, period_end, filed, val).

    Some companies change their revenue concept in 1998, some restate a year
    later by +1 %, some tag long-term debt differently or not at all, and
    half-year reports add rows that annual readers must skip.
    """
    s, key = statements(spark, sf_dir), F.col("suppkey")
    revenue = F.when((key % 5 == 0) & (F.col("year") >= 1998), "RevenueFromContractWithCustomerExcludingAssessedTax").otherwise("Revenues")
    debt = F.when(key % 7 == 0, "LongTermDebtNoncurrent").otherwise("LongTermDebt")

    def fact(taxonomy, concept, unit, form, fp, end, filed, val, keep=F.lit(True)):
        concept = concept if isinstance(concept, Column) else F.lit(concept)
        return F.when(keep, F.struct(
            F.lit(taxonomy).alias("taxonomy"), concept.alias("concept"), F.lit(unit).alias("unit"), F.lit(form).alias("form"),
            F.lit(fp).alias("fp"), end.alias("period_end"), filed.alias("filed"), val.alias("val")))

    end, filed, again = F.col("statement_date"), F.col("filed_date"), F.date_add("filed_date", 365)
    restates = key % 3 == 0
    half = F.make_date("year", F.lit(6), F.lit(30))
    shares = (1_000_000 * (1 + key % 17)).cast("double")
    dei = key % 4 != 0
    rows = [fact("us-gaap", revenue, "USD", "10-K", "FY", end, filed, F.col("revenue")),
            fact("us-gaap", revenue, "USD", "10-K", "FY", end, again, F.col("revenue") * 1.01, restates),
            fact("us-gaap", "NetIncomeLoss", "USD", "10-K", "FY", end, filed, F.col("net_income")),
            fact("us-gaap", debt, "USD", "10-K", "FY", end, filed, F.col("lt_debt"), key % 11 != 0),
            fact("us-gaap", "StockholdersEquity", "USD", "10-K", "FY", end, filed, F.col("equity")),
            fact("us-gaap", revenue, "USD", "10-Q", "Q2", half, F.date_add(half, 45), F.col("revenue") * 0.5),
            fact("us-gaap", "Assets", "USD", "10-K", "FY", end, filed, F.col("revenue") * 3),
            fact("dei", "EntityCommonStockSharesOutstanding", "shares", "10-K", "FY", end, filed, shares, dei),
            fact("us-gaap", "CommonStockSharesOutstanding", "shares", "10-K", "FY", end, filed, shares + 1)]
    long = s.select("ticker", F.explode(F.array_compact(F.array(*rows))).alias("_f"))
    return long.select("ticker", "_f.*")


def _suppliers(spark: SparkSession, sf_dir: str) -> Column:
    """Number of suppliers as a scalar subquery."""
    return table(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filings(ticker, form, filing_date, items, accession, doc_id): one per order."""
    o = table(spark, sf_dir, "orders")
    docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    level = F.col("o_orderpriority")
    text = lambda *c: F.array(*[F.lit(x) for x in c]) if c else F.array().cast("array<string>")
    return o.select(
        (F.col("o_custkey") % _suppliers(spark, sf_dir)).cast("string").alias("ticker"),
        F.when(F.col("o_orderstatus") == "F", "8-K").when(F.col("o_orderstatus") == "P", "10-Q").otherwise("10-K").alias("form"),
        F.col("o_orderdate").cast("date").alias("filing_date"),
        F.when(level == "1-URGENT", text("2.02", "4.02")).when(level == "2-HIGH", text("5.02"))
        .when(level == "3-MEDIUM", text("1.03")).otherwise(text()).alias("items"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("accession"), (F.col("o_orderkey") % docs).alias("doc_id"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rates(date, rate): mean discount by shipping month, dated the first."""
    return table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("date")).agg(
        F.avg("l_discount").alias("rate"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """membership(date, ticker): suppliers with a shipment in the month."""
    return table(spark, sf_dir, "lineitem").select(
        F.trunc("l_shipdate", "month").alias("date"), F.col("l_suppkey").cast("string").alias("ticker")).distinct()


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """splits(ticker, split_date, ratio): pending urgent orders as 2:1, pending high ones as 3:2."""
    f = filings(spark, sf_dir).where((F.col("form") == "10-Q") & (F.size("items") > 0) & F.element_at("items", 1).isin("2.02", "5.02"))
    return f.groupBy("ticker", F.col("filing_date").alias("split_date")).agg(
        F.max(F.when(F.element_at("items", 1) == "2.02", 2.0).otherwise(1.5)).alias("ratio"))
