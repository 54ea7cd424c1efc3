"""Life of positions: open, remind, exit, close, report."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.scalars import business_days, expected_return, percentile_step, return_zone
from ..operators.asof import asof_backward
from ..sources.sinks import write_run

EXIT_DAYS = 252
REMIND_FROM = 222


def open_positions(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of `fresh` to append: one per (ticker, entry_date), none already recorded."""
    return fresh.dropDuplicates(["ticker", "entry_date"]).join(existing, ["ticker", "entry_date"], "left_anti")


def priced(positions: DataFrame, bars: DataFrame, as_of: Column) -> DataFrame:
    """positions + current_price: the last close at or before `as_of`."""
    closes = bars.select("ticker", "date", F.col("close").alias("current_price"))
    return asof_backward(positions.withColumn("_as_of", as_of), closes, ["ticker"], "_as_of", "date",
                         ["current_price"]).drop("_as_of")


def exit_check(positions: DataFrame, today: Column) -> DataFrame:
    """Positions(ticker, entry_date, entry_price, current_price, reminder_sent) + days_held, alert, ret.
    A missing price falls back to the entry price; a reminder is due once."""
    price = F.coalesce("current_price", "entry_price")
    held = business_days(F.col("entry_date"), today)
    alert = (F.when(held >= EXIT_DAYS, "EXIT")
             .when((held >= REMIND_FROM) & ~F.coalesce("reminder_sent", F.lit(False)), "REMINDER"))
    return positions.withColumns({"days_held": held, "alert": alert, "ret": price / F.col("entry_price") - 1})


def after_check(checked: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(still open with the reminder flag updated, newly closed)."""
    is_exit = F.coalesce(F.col("alert") == "EXIT", F.lit(False))
    still = checked.where(~is_exit).withColumn(
        "reminder_sent", F.coalesce("reminder_sent", F.lit(False)) | F.coalesce(F.col("alert") == "REMINDER", F.lit(False)))
    closed = checked.where(is_exit).select(
        "ticker", "entry_date", "entry_price", today.alias("exit_date"),
        F.coalesce("current_price", "entry_price").alias("exit_price"), F.col("ret").alias("realized_return"), "days_held")
    return still, closed


def position_status(positions: DataFrame, today: Column) -> DataFrame:
    """Days held and left, return, expected return, percentile and zone of each priced position."""
    held = business_days(F.col("entry_date"), today)
    ret = F.col("current_price") / F.col("entry_price") - 1
    df = positions.withColumns({"days_held": held, "current_return": ret})
    return df.withColumns({
        "days_remaining": F.greatest(F.lit(0), EXIT_DAYS - F.col("days_held")).cast("bigint"),
        "expected_return": expected_return(F.col("days_held")),
        "percentile": F.when(F.col("current_return").isNotNull(), percentile_step(F.col("current_return"))),
        "zone": return_zone(F.col("current_return"))})


def manual_close(positions: DataFrame, tickers: DataFrame, today: Column) -> DataFrame:
    """Closing rows for the requested tickers at the current price, else at the entry price."""
    price = F.coalesce("current_price", "entry_price")
    return positions.join(tickers.select("ticker").distinct(), "ticker", "left_semi").select(
        "ticker", "entry_date", "entry_price", today.alias("exit_date"), price.alias("exit_price"),
        (price / F.col("entry_price") - 1).alias("realized_return"),
        business_days(F.col("entry_date"), today).alias("days_held"))


def valuation(holdings: DataFrame) -> DataFrame:
    """Current return of holdings; a missing entry price is valued at the current price."""
    base = F.coalesce("entry_price", "current_price")
    return holdings.withColumns({
        "entry_price": base, "current_return": F.col("current_price") / base - 1,
        "alert_up_pct": F.coalesce("alert_up_pct", F.lit(20.0)), "alert_down_pct": F.coalesce("alert_down_pct", F.lit(10.0))})


def observed_run(path: str, screened: DataFrame, changes: DataFrame, checked: DataFrame) -> DataFrame:
    """Write the outputs of a run below `path` and return one row of its counters.

    The counters are observed while the rows pass on their way to the files, so they cost no job and no second scan;
    they are those of the successful write. The tables need a day column `as_of`.
    """
    spark = screened.sparkSession
    counted = {
        "screen": (screened, [F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("signal") == "BUY").alias("buys"), F.count_if(F.col("signal") == "VETO").alias("vetoed")]),
        "changes": (changes, [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("NEW", "CONTINUING", "DROPPED")]),
        "exits": (checked, [F.count_if(F.col("alert") == "EXIT").alias("exits"), F.count_if(F.col("alert") == "REMINDER").alias("reminders"), F.count(F.lit(1)).alias("positions")])}
    seen = {name: Observation(name) for name in counted}
    write_run(path, **{name: rows.observe(seen[name], *counters) for name, (rows, counters) in counted.items()})
    found = {k: v for o in seen.values() for k, v in o.get.items()}
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} bigint" for k in found))


def benchmark_relative(positions: DataFrame, calendar: DataFrame, accrual: DataFrame, end: str = "end_date") -> DataFrame:
    """Positions(ticker, entry_date, end_date, ret) against the benchmark and the money market over the same
    days. Calendar and accrual tables have one row per day and are looked up by as-of."""
    from ..operators.curve import span_interest
    levels = calendar.select(F.col("date").alias("_d"), F.col("close").alias("_lvl"), F.lit(1).alias("_all"))
    from ..operators.asof import asof_forward
    ends = positions.select(F.col(end).alias("_e"), F.lit(1).alias("_all")).distinct()
    starts = positions.select(F.col("entry_date").alias("_s"), F.lit(1).alias("_all")).distinct()
    last = asof_backward(ends, levels, ["_all"], "_e", "_d", ["_lvl"], strict=True).select("_e", F.col("_lvl").alias("_b1"))
    first = asof_forward(starts, levels, ["_all"], "_s", "_d", ["_lvl"]).select("_s", F.col("_lvl").alias("_b0"))
    # One row per calendar day on both sides.
    df = (positions.join(F.broadcast(first), F.col("entry_date") == F.col("_s"), "left")
          .join(F.broadcast(last), F.col(end) == F.col("_e"), "left"))
    df = df.withColumn("benchmark_return", F.when(F.col(end) <= F.col("entry_date"), 0.0).otherwise(F.col("_b1") / F.col("_b0") - 1)).drop("_s", "_e", "_b0", "_b1")
    df = span_interest(df, accrual, "entry_date", end)
    return df.withColumns({"vs_benchmark": F.col("ret") - F.col("benchmark_return"), "vs_mm": F.col("ret") - F.col("mm_return")})
