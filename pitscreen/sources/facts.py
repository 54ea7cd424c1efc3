"""Filed facts and vendor statements from nested JSON to long tables."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.guards import number
from ..operators.fundamentals import CONCEPTS, SHARE_CONCEPTS

ENTRY = "struct<end:string,filed:string,val:double,form:string,fp:string,fy:int>"
COMPANY_FACTS = f"struct<facts:map<string,map<string,struct<units:map<string,array<{ENTRY}>>>>>>"
STATEMENT = "map<string,map<string,string>>"
VENDOR = f"struct<Financials:struct<Income_Statement:struct<yearly:{STATEMENT}>,Balance_Sheet:struct<yearly:{STATEMENT}>>>"

# Accepted row labels of wide statements, preferred first.
ALIASES = {
    "revenue": ["TotalRevenue", "Total Revenue", "OperatingRevenue", "Operating Revenue"],
    "net_income": ["NetIncome", "Net Income", "NetIncomeCommonStockholders", "Net Income Common Stockholders",
                   "NetIncomeFromContinuingOperationNetMinorityInterest"],
    "lt_debt": ["TotalDebt", "Total Debt", "LongTermDebt", "Long Term Debt"],
    "equity": ["StockholdersEquity", "Stockholders Equity", "CommonStockEquity", "Common Stock Equity",
               "TotalEquityGrossMinorityInterest", "Total Stockholder Equity"],
}


def company_facts(documents: DataFrame, json: str = "json") -> DataFrame:
    """documents(ticker, json) to facts(ticker, taxonomy, concept, unit, form, fp, period_end, filed, val)."""
    df = documents.select("ticker", F.from_json(json, COMPANY_FACTS).alias("_d"))
    df = df.select("ticker", F.explode("_d.facts").alias("taxonomy", "_c"))
    df = df.select("ticker", "taxonomy", F.explode("_c").alias("concept", "_u"))
    df = df.select("ticker", "taxonomy", "concept", F.explode("_u.units").alias("unit", "_e"))
    df = df.select("ticker", "taxonomy", "concept", "unit", F.explode("_e").alias("_e"))
    day = lambda c: F.try_to_date(F.col(c))
    return df.select("ticker", "taxonomy", "concept", "unit", F.col("_e.form").alias("form"), F.col("_e.fp").alias("fp"),
                     day("_e.end").alias("period_end"), day("_e.filed").alias("filed"), F.col("_e.val").alias("val"))


def gate_concepts() -> list[str]:
    return [c for names in CONCEPTS.values() for c in names] + [c for _, c in SHARE_CONCEPTS]


def prune_concepts(facts: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Only the concepts the gate and the market cap read. On facts partitioned by
    concept this prunes directories; elsewhere it reaches the scan as an IN filter."""
    return facts.where(F.col("concept").isin(list(keep or gate_concepts())))


def vendor_statements(documents: DataFrame, json: str = "json") -> DataFrame:
    """documents(ticker, json) to yearly statements(ticker, statement_date, filed_date, revenue, net_income,
    lt_debt, equity). Income and balance rows meet on their period key inside the document."""
    df = documents.select("ticker", F.from_json(json, VENDOR)["Financials"].alias("_f"))
    balance = F.coalesce(F.col("_f.Balance_Sheet.yearly"), F.create_map().cast(STATEMENT))
    df = df.select("ticker", balance.alias("_bal"), F.explode("_f.Income_Statement.yearly").alias("_key", "_inc"))
    inc = lambda k: F.try_element_at("_inc", F.lit(k))
    df = df.withColumn("_b", F.try_element_at("_bal", F.col("_key")))
    bal = lambda k: F.try_element_at("_b", F.lit(k))
    debt = F.when(bal("longTermDebt").isNotNull(), number(bal("longTermDebt"))).otherwise(number(bal("longTermDebtTotal")))
    out = df.select("ticker", F.try_to_date(F.coalesce(inc("date"), F.col("_key"))).alias("statement_date"),
                    F.try_to_date(F.coalesce(inc("filing_date"), bal("filing_date"))).alias("filed_date"),
                    number(inc("totalRevenue")).alias("revenue"), number(inc("netIncome")).alias("net_income"),
                    debt.alias("lt_debt"), number(bal("totalStockholderEquity")).alias("equity"))
    return out.where(F.col("revenue").isNotNull())


def write_by_concept(facts: DataFrame, path: str) -> None:
    """Facts in one folder per concept; rows of a concept are spread over tasks, so a common one is several files."""
    facts.hint("rebalance", "concept").write.mode("overwrite").partitionBy("concept").parquet(path)


def read_concepts(spark: SparkSession, path: str, wanted: Sequence[str] | DataFrame) -> DataFrame:
    """Stored facts of some concepts: names prune the folders while planning, a table (concept) when the job runs."""
    stored = spark.read.parquet(path)
    if isinstance(wanted, DataFrame):
        return stored.join(wanted.select("concept").distinct(), "concept", "left_semi")
    return stored.where(F.col("concept").isin(list(wanted)))


def first_alias(label: Column, value: Column, names: Sequence[str]) -> Column:
    """Aggregate: the value of the first listed label that is present and not null."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), label)
    known = (place > 0) & value.isNotNull() & ~F.isnan(value)
    return F.min_by(value, F.when(known, place))


def wide_statement(wide: DataFrame, label: str = "label", key: str = "ticker",
                   aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Rows labelled by metric with one column per statement date, to one row per (ticker, statement_date).
    Each metric takes the first alias that has a value on that date."""
    dates = [c for c in wide.columns if c not in (key, label)]
    long = wide.unpivot([key, label], dates, "_date", "_value").where(
        F.col(label).isin([n for names in aliases.values() for n in names]))
    return long.groupBy(key, F.try_to_date(F.col("_date")).alias("statement_date")).agg(
        *[first_alias(F.col(label), F.col("_value"), names).alias(m) for m, names in aliases.items()])


def symbol_dimension(symbols: DataFrame) -> DataFrame:
    """(symbol, cik) with upper-cased symbols, one row each."""
    return symbols.groupBy(F.upper("symbol").alias("symbol")).agg(F.min("cik").alias("cik"))


def with_cik(rows: DataFrame, dimension: DataFrame, symbol: str = "ticker") -> DataFrame:
    """Left look-up of the filer id. The join strategy is left to the optimizer, which knows the dimension's size."""
    dim = dimension.select(F.col("symbol").alias("_s"), "cik")
    return rows.join(dim, F.upper(F.col(symbol)) == F.col("_s"), "left").drop("_s")
