"""Statistics of daily value series: (series, date, value), one row per series and day."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import stats
from ..functions.guards import holds


def _w(series: str, ts: str = "date"):
    return Window.partitionBy(series).orderBy(ts)


def daily_returns(curve: DataFrame, series: str = "series", value: str = "value") -> DataFrame:
    before = F.lag(value).over(_w(series))
    return curve.withColumn("ret", F.try_divide(F.col(value) - before, before))


def annual_returns(curve: DataFrame, series: str = "series", value: str = "value") -> DataFrame:
    """Return of each calendar year against the previous year's last value (the first year: its first value)."""
    ends = curve.groupBy(series, F.year("date").alias("year")).agg(
        F.min_by(value, "date").alias("_open"), F.max_by(value, "date").alias("_close"))
    base = F.coalesce(F.lag("_close").over(_w(series, "year")), F.col("_open"))
    return ends.select(series, "year", (F.col("_close") / base - 1).alias("annual_return"))


def within_year_returns(curve: DataFrame, series: str = "series", value: str = "value") -> DataFrame:
    """Last over first value inside each year."""
    return curve.groupBy(series, F.year("date").alias("year")).agg(
        (F.max_by(value, "date") / F.min_by(value, "date") - 1).alias("year_return"),
        F.count(F.lit(1)).alias("days")).where(F.col("days") >= 2)


def curve_metrics(curve: DataFrame, series: str = "series", value: str = "value", ddof: int = 1,
                  periods: int = 252) -> DataFrame:
    """Total return, CAGR, deepest drawdown, Sharpe ratio and the best and worst year of each series."""
    top = F.max(value).over(_w(series).rowsBetween(Window.unboundedPreceding, 0))
    rows = daily_returns(curve, series, value).withColumn("_dd", (F.col(value) - top) / top)
    spread = F.stddev_samp("ret") if ddof else F.stddev_pop("ret")
    base = rows.groupBy(series).agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("start"), F.max("date").alias("end"),
        F.min_by(value, "date").alias("_v0"), F.max_by(value, "date").alias("final_value"),
        F.min("_dd").alias("max_drawdown"), F.avg("ret").alias("_m"), spread.alias("_s"))
    years = F.greatest(F.datediff("end", "start") / F.lit(365.25), F.lit(1.0))
    growth = F.col("final_value") / F.col("_v0")
    base = base.withColumns({
        "total_return": growth - 1, "cagr": F.pow(growth, 1 / years) - 1,
        "sharpe": F.when(F.col("_s") > 1e-10, F.col("_m") / F.col("_s") * math.sqrt(periods)).otherwise(0.0)})
    yearly = annual_returns(curve, series, value).groupBy(series).agg(
        F.max_by("year", "annual_return").alias("best_year"), F.max("annual_return").alias("best_return"),
        F.min_by("year", "annual_return").alias("worst_year"), F.min("annual_return").alias("worst_return"))
    return base.join(yearly, series).drop("_v0", "_m", "_s")


def buy_and_hold(prices: DataFrame, capital: float = 100_000.0, series: str = "series", price: str = "close") -> DataFrame:
    """A price series as the value of `capital` invested on its first day."""
    first = F.first(price).over(_w(series))
    return prices.withColumn("value", F.col(price) / first * capital)


def sharpe_moments(curve: DataFrame, series: str = "series", value: str = "value") -> DataFrame:
    """n, per-observation Sharpe (population deviation), skewness and plain kurtosis."""
    rows = daily_returns(curve, series, value).where(F.col("ret").isNotNull())
    return rows.groupBy(series).agg(
        F.count("ret").alias("n"), (F.avg("ret") / F.stddev_pop("ret")).alias("sr"),
        F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))


def deflated_sharpe(moments: DataFrame, trials: DataFrame, benchmark_sr: float = 0.0, sharpe: str = "sharpe") -> DataFrame:
    """moments(n, sr, skew, kurt) + probabilistic and deflated Sharpe ratios; trials(sharpe) per observation."""
    df = moments.withColumns({"trial_variance": trials.agg(F.var_samp(sharpe)).scalar(),
                              "trials": trials.agg(F.count(sharpe)).scalar()})
    df = df.withColumn("sr0", stats.expected_max_sharpe(F.col("trial_variance"), F.col("trials")))
    args = [F.col("n"), F.col("skew"), F.col("kurt")]
    return df.withColumns({
        "psr_zero": stats.probabilistic_sharpe(F.col("sr"), F.lit(0.0), *args),
        "psr_benchmark": stats.probabilistic_sharpe(F.col("sr"), F.lit(benchmark_sr), *args),
        "dsr": stats.probabilistic_sharpe(F.col("sr"), F.col("sr0"), *args)})


def forward_fill(calendar: DataFrame, sparse: DataFrame, value: str) -> DataFrame:
    """Latest sparse value on every calendar date (both sides: at most one row per day)."""
    from .asof import asof_backward
    probe = calendar.select("date").withColumn("_all", F.lit(1))
    build = sparse.select(F.col("date").alias("_d"), value, F.lit(1).alias("_all"))
    return asof_backward(probe, build, ["_all"], "date", "_d", [value]).drop("_all")


def aligned(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(ticker, date, close, filled): each instrument on every calendar date between its first and its last bar.

    A missing date takes the close before it, never a later one. Dates are numbered; a bar is repeated as often as the
    calendar has dates up to the instrument's next bar, so calendar and instruments are never crossed. `calendar` holds
    the date of every bar.
    """
    days = calendar.select("date").distinct()
    numbered = days.withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")))  # one row per calendar day
    placed = bars.select("ticker", "date", "close").join(F.broadcast(numbered), "date")
    upto = F.coalesce(F.lead("_at").over(Window.partitionBy("ticker").orderBy("date")) - 1, F.col("_at"))
    runs = placed.withColumn("_upto", upto).select("ticker", "close", F.col("_at").alias("_from"), F.explode(F.sequence("_at", "_upto")).alias("_at"))
    return runs.join(F.broadcast(numbered), "_at").select("ticker", "date", "close", (F.col("_at") > F.col("_from")).alias("filled"))


def money_market_index(calendar: DataFrame, rates: DataFrame) -> DataFrame:
    """Growth of idle cash over calendar gaps: product of (1 + rate)^(gap / 365)."""
    w = Window.partitionBy("_all").orderBy("date")
    rows = forward_fill(calendar, rates, "rate").withColumn("_all", F.lit(1)).withColumn(
        "_gap", F.coalesce(F.datediff("date", F.lag("date").over(w)), F.lit(0)))
    step = F.log1p(F.coalesce("rate", F.lit(0.0))) * F.col("_gap") / 365
    return rows.withColumn("mm_index", F.exp(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))).select(
        "date", "rate", "mm_index")


def daily_accrual(rates: DataFrame, bars: DataFrame) -> DataFrame:
    """(date, accrued): running sum of log(1 + rate) / 365 over every calendar day that the bars span.
    The interest of any span is the difference of two look-ups, so spans are never exploded into days."""
    days = bars.agg(F.min("date").alias("_a"), F.max("date").alias("_b")).select(F.explode(F.sequence("_a", "_b")).alias("date"))
    w = Window.partitionBy("_all").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = forward_fill(days, rates, "rate").withColumn("_all", F.lit(1))
    return filled.withColumn("accrued", F.sum(F.log1p(F.coalesce("rate", F.lit(0.0))) / 365).over(w)).select("date", "accrued")


def span_interest(spans: DataFrame, accrual: DataFrame, start: str, end: str, name: str = "mm_return") -> DataFrame:
    """Money-market return over (start, end] per row; the accrual table has one row per calendar day."""
    a = accrual.select(F.col("date").alias("_d0"), F.col("accrued").alias("_a0"))
    b = accrual.select(F.col("date").alias("_d1"), F.col("accrued").alias("_a1"))
    out = (spans.join(F.broadcast(a), F.col(start) == F.col("_d0"), "left")
           .join(F.broadcast(b), F.col(end) == F.col("_d1"), "left"))
    return out.withColumn(name, F.when(F.col(end) <= F.col(start), 0.0).otherwise(
        F.exp(F.col("_a1") - F.col("_a0")) - 1)).drop("_d0", "_a0", "_d1", "_a1")


def timing_cost(events: DataFrame, calendar: DataFrame, days: int = 30) -> DataFrame:
    """Calendar level at the event date and `days` later, with the move; both by as-of."""
    levels = calendar.select(F.col("date").alias("_d"), F.col("close").alias("level"), F.lit(1).alias("_all"))
    from .asof import asof_backward
    dates = events.select("date").distinct().withColumns({"_all": F.lit(1), "later": F.date_add("date", days)})
    now = asof_backward(dates, levels, ["_all"], "date", "_d", ["level"]).withColumnRenamed("level", "level_now")
    both = asof_backward(now, levels, ["_all"], "later", "_d", ["level"]).withColumnRenamed("level", "level_later")
    moved = both.drop("_all").withColumn("move", F.col("level_later") / F.col("level_now") - 1)
    return events.join(F.broadcast(moved), "date")  # one row per calendar day


def market_context(calendar: DataFrame, series: str = "series") -> DataFrame:
    """Total return, deepest fall, share of bull days and the dominant regime of a benchmark with a `regime` column."""
    top = F.max("close").over(_w(series).rowsBetween(Window.unboundedPreceding, 0))
    out = calendar.withColumn("_dd", F.col("close") / top - 1).groupBy(series).agg(
        (F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("total_return"),
        F.min("_dd").alias("max_drawdown"), F.avg((F.col("regime") == "bull").cast("double")).alias("pct_bull"))
    return out.withColumn("dominant", F.when(F.col("pct_bull") > 0.5, "bull").otherwise("bear"))


def years_against(yearly: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Years won and lost: yearly(series, year, annual_return) against benchmark(year, bench_return)."""
    j = yearly.join(F.broadcast(benchmark), "year")  # one row per calendar year
    won = F.col("annual_return") > F.col("bench_return")
    years = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("year")))), ",")
    return j.groupBy("series").agg(F.count_if(won).alias("years_won"), F.count(F.lit(1)).alias("years"),
                                   years(won).alias("won"), years(~won).alias("lost"))
