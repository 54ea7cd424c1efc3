"""Day-over-day signal changes and alerts on held positions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.guards import holds
from ..functions.scalars import previous_weekday
from ..operators.asof import asof_backward, within_days


def signal_changes(today: DataFrame, previous: DataFrame) -> DataFrame:
    """Two days of (ticker, signal) to (ticker, status): NEW, CONTINUING or DROPPED buy signals."""
    buys = lambda df, name: df.where(F.col("signal") == "BUY").select("ticker").distinct().withColumn(name, F.lit(True))
    both = buys(today, "_now").join(buys(previous, "_before"), "ticker", "full_outer")
    status = (F.when(F.col("_before").isNull(), "NEW").when(F.col("_now").isNull(), "DROPPED").otherwise("CONTINUING"))
    return both.select("ticker", status.alias("status"))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def current_prices(holdings: DataFrame, screened: DataFrame, bars: DataFrame, as_of: Column, lookback: int = 10) -> DataFrame:
    """holdings + current_price: the screened price, else the last close before `as_of` within the lookback."""
    keyed = holdings.withColumn("_as_of", as_of)
    closes = bars.select("ticker", "date", F.col("close").alias("_close"), F.col("date").alias("_seen"))
    found = asof_backward(keyed, closes, ["ticker"], "_as_of", "date", ["_close", "_seen"], strict=True)
    recent = within_days(F.col("_close"), F.col("_seen"), F.col("_as_of"), lookback)
    rows = screened.select("ticker", F.col("current_price").alias("_screened"), F.lit(True).alias("_in"))
    return found.join(rows, "ticker", "left").withColumn(
        "current_price", F.when(F.col("_in"), F.col("_screened")).otherwise(recent)).drop("_as_of", "_close", "_seen", "_screened", "_in")


def portfolio_alerts(holdings: DataFrame, screened: DataFrame, bars: DataFrame, as_of: Column,
                     up_default: float = 20.0, down_default: float = 10.0) -> DataFrame:
    """Zero to two alerts per holding: a price target, and independently a buy signal on a held ticker."""
    priced = current_prices(holdings, screened, bars, as_of).where(
        F.col("entry_price").isNotNull() & F.col("current_price").isNotNull())
    usable = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(d))
    up, down = usable("alert_up_pct", up_default), usable("alert_down_pct", down_default)
    ret = (F.col("current_price") / F.col("entry_price") - 1) * 100
    buys = screened.where(F.col("signal") == "BUY").select("ticker", F.lit(True).alias("_buy"))
    rows = priced.join(buys, "ticker", "left").withColumn("return_pct", ret)
    price_alert = F.when(F.col("return_pct") >= up, "PRICE_TARGET_UP").when(F.col("return_pct") <= -down, "PRICE_TARGET_DOWN")
    kinds = F.array_compact(F.array(price_alert, F.when(holds(F.col("_buy")), "SIGNAL_ON_HELD_TICKER")))
    return rows.withColumn("alert_type", F.explode(kinds)).drop("_buy")


def weekday_changes(history: DataFrame, day: str = "date") -> DataFrame:
    """(ticker, day, status) for every stored day, against the weekday before it.

    A weekday without stored rows counts as a day without signals: then every signal is NEW, and
    what it dropped is not reported. A signal is reported as DROPPED only on days that are stored.
    """
    stored = history.select(day).distinct().withColumn("_weekday", previous_weekday(F.col(day)))
    buys = history.where(F.col("signal") == "BUY").select("ticker", day).distinct()
    before = (buys.withColumnRenamed(day, "_weekday").join(stored, "_weekday").select("ticker", day, F.lit(True).alias("_before")))
    both = buys.withColumn("_now", F.lit(True)).join(before, ["ticker", day], "full_outer")
    status = F.when(F.col("_before").isNull(), "NEW").when(F.col("_now").isNull(), "DROPPED").otherwise("CONTINUING")
    return both.select("ticker", day, status.alias("status"))


def latest_two_days(history: DataFrame, day: str = "as_of") -> DataFrame:
    """Signal status per (ticker, day) over a stored history, against the previous stored day of the calendar."""
    w = Window.partitionBy("_all").orderBy(day)
    days = history.select(day).distinct().withColumn("_all", F.lit(1)).withColumn("_next", F.lead(day).over(w)).drop("_all")
    buys = history.where(F.col("signal") == "BUY").select("ticker", day).distinct()
    before = buys.join(F.broadcast(days), day).where(F.col("_next").isNotNull()).select(
        "ticker", F.col("_next").alias(day), F.lit(True).alias("_before"))
    both = buys.withColumn("_now", F.lit(True)).join(before, ["ticker", day], "full_outer")
    status = (F.when(F.col("_before").isNull(), "NEW").when(F.col("_now").isNull(), "DROPPED").otherwise("CONTINUING"))
    return both.select("ticker", day, status.alias("status"))
