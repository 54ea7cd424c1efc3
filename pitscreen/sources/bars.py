"""Daily bars: scans, price adjustment and coverage."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.guards import number

PRICES = ("open", "high", "low", "close")


def scan_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars with start <= date < end; both bounds reach the parquet scan."""
    df = spark.read.parquet(path)
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") < F.lit(end).cast("date"))
    return df


def adjusted_bars(raw: DataFrame) -> DataFrame:
    """Scale open, high and low by adjusted/close and use the adjusted close.
    Non-numeric fields become NULL; rows without a usable close are dropped."""
    cols = {c: number(c) for c in (*PRICES, "adjusted_close", "volume")}
    df = raw.withColumns(cols).where((F.col("close") != 0) & F.col("adjusted_close").isNotNull())
    factor = F.col("adjusted_close") / F.col("close")
    scaled = {c: F.col(c) * factor for c in ("open", "high", "low")}
    return df.withColumns({**scaled, "close": F.col("adjusted_close")}).drop("adjusted_close")


def unsplit_bars(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Undo split adjustment: every price times the product of the ratios of later splits.
    Splits(ticker, split_date, ratio) are tagged into the bar stream and multiplied up from the end."""
    daily = splits.groupBy("ticker", "split_date").agg(F.product("ratio").alias("_ratio"))
    rows = bars.select("ticker", F.col("date").alias("_t"), F.lit(0).alias("_tag"),
                       F.struct(*bars.columns).alias("_row")).unionByName(
        daily.select("ticker", F.col("split_date").alias("_t"), F.lit(1).alias("_tag"), "_ratio"), allowMissingColumns=True)
    later = Window.partitionBy("ticker").orderBy(F.desc("_t"), "_tag").rowsBetween(Window.unboundedPreceding, 0)
    factor = F.coalesce(F.product("_ratio").over(later), F.lit(1.0))
    out = rows.withColumn("split_factor", factor).where(F.col("_tag") == 0).select("_row.*", "split_factor")
    return out.withColumns({c: F.col(c) * F.col("split_factor") for c in PRICES})


def calendar_of(benchmark: DataFrame) -> DataFrame:
    """The trading calendar: the dates on which the benchmark traded."""
    return benchmark.select("date").distinct()


def is_trading_day(day: Column) -> Column:
    """Weekday fallback where no calendar is at hand."""
    return F.dayofweek(day).between(2, 6)


def on_trading_days(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows whose date is a weekday that the calendar holds (one row per day, broadcast)."""
    return rows.where(is_trading_day(F.col("date"))).join(F.broadcast(calendar.select("date").distinct()), "date", "left_semi")
