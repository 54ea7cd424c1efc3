"""Technical indicators: `f(df, ...) -> df + column`."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import tiers
from ..functions.guards import above, holds
from .windows import KEY, TS, by_bar, full_frame, lagged_return, rolling, trailing

RETURN_STEPS = (5, 10, 15, 20, 25, 30, 35, 40)


def sma(df: DataFrame, n: int, price: str = "close", key: str = KEY, ts: str = TS, name: str | None = None) -> DataFrame:
    return rolling(df, name or f"sma_{n}", F.avg, n, price, key, ts)


def rolling_high(df: DataFrame, n: int = 252, price: str = "close", key: str = KEY, ts: str = TS) -> DataFrame:
    return rolling(df, "high_52w", F.max, n, price, key, ts)


def drawdown(df: DataFrame, high: str = "high_52w", price: str = "close") -> DataFrame:
    fall = F.try_divide(F.col(high) - F.col(price), F.col(high))
    return df.withColumn("drawdown_52w", F.when(fall.isNotNull(), F.greatest(F.lit(0.0), fall)))


def bar_return(df: DataFrame, k: int, price: str = "close", key: str = KEY, ts: str = TS) -> DataFrame:
    return df.withColumn(f"ret_{k}", lagged_return(price, k, key, ts))


def true_range(df: DataFrame, key: str = KEY, ts: str = TS) -> DataFrame:
    before = F.lag("close").over(by_bar(key, ts))
    return df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before),
                                                  F.abs(F.col("low") - before)))


def atr(df: DataFrame, n: int = 14, key: str = KEY, ts: str = TS) -> DataFrame:
    """Simple (not smoothed) mean of the true range."""
    return rolling(true_range(df, key, ts), f"atr_{n}", F.avg, n, "true_range", key, ts).drop("true_range")


def volume_ratio(df: DataFrame, short: int = 10, long: int = 90, volume: str = "volume", key: str = KEY,
                 ts: str = TS) -> DataFrame:
    v = F.col(volume)
    return df.withColumn("vol_ratio", F.try_divide(full_frame(F.avg, v, short, trailing(short, key, ts)),
                                                   full_frame(F.avg, v, long, trailing(long, key, ts))))


def sma_slope(df: DataFrame, sma_col: str = "sma_200", back: int = 20, key: str = KEY, ts: str = TS) -> DataFrame:
    """TRUE / FALSE against the average `back` bars ago, NULL during warm-up. Equal averages do not rise, whatever their rounding."""
    return df.withColumn("sma_rising", above(F.col(sma_col), F.lag(sma_col, back).over(by_bar(key, ts))))


def crossed_above(df: DataFrame, sma_col: str = "sma_50", price: str = "close", key: str = KEY, ts: str = TS) -> DataFrame:
    w = by_bar(key, ts)
    now, avg = F.col(price), F.col(sma_col)
    return df.withColumn("crossed_up", holds(~above(F.lag(now).over(w), F.lag(avg).over(w)) & above(now, avg)))


def _scan_levels(decay: float) -> int:
    # Beyond this many bars the weight of older values is below 1e-30.
    reach = math.log(1e-30) / math.log(decay) if decay > 0 else 1
    return max(1, math.ceil(math.log(max(reach, 2), 4)))


def ema(df: DataFrame, alpha: float, prices: dict[str, str], key: str = KEY, ts: str = TS) -> DataFrame:
    """Exponential averages seeded with the first value, JVM-side.

    The average is a geometrically weighted sum of the bars before it. A sum
    over 4 times as many bars is four shorter sums, taken at fixed lags, so
    log4(reach) windows over the same sorted partition replace a row-by-row
    recursion. `prices` maps output names to input columns, which must share
    their leading nulls and have none after the first value.
    """
    w, decay, names = by_bar(key, ts), 1 - alpha, list(prices)
    first = F.col(prices[names[0]])
    df = df.withColumn("_seen", F.count(first).over(w))
    df = df.withColumns({f"_s{i}": F.coalesce(F.when(F.col("_seen") == 1, F.col(prices[n])).otherwise(alpha * F.col(prices[n])), F.lit(0.0))
                         for i, n in enumerate(names)})
    span = 1
    for _ in range(_scan_levels(decay)):
        df = df.withColumns({f"_s{i}": F.col(f"_s{i}") + sum(
            decay ** (span * k) * F.coalesce(F.lag(f"_s{i}", span * k).over(w), F.lit(0.0)) for k in (1, 2, 3))
            for i in range(len(names))})
        span *= 4
    df = df.withColumns({n: F.when(F.col("_seen") > 0, F.col(f"_s{i}")) for i, n in enumerate(names)})
    return df.drop("_seen", *[f"_s{i}" for i in range(len(names))])


def ema_grouped(df: DataFrame, alpha: float, price: str = "close", name: str = "ema", key: str = KEY,
                ts: str = TS) -> DataFrame:
    """The same average as a grouped-map function: one group is one ticker's
    calendar-bounded history. Use it when gaps inside the series must decay."""
    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        pdf[name] = pdf[price].ewm(alpha=alpha, adjust=False).mean()
        return pdf

    kept = df.select(key, ts, price)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", `{name}` double"
    return kept.groupBy(key).applyInPandas(smooth, schema)


def rsi(df: DataFrame, n: int = 14, price: str = "close", key: str = KEY, ts: str = TS) -> DataFrame:
    """Wilder's index; flat prices give 50, a missing average loss counts as 1e-10."""
    change = F.col(price) - F.lag(price).over(by_bar(key, ts))
    df = df.withColumn("_chg", change)
    df = df.withColumns({"_up": F.greatest(F.col("_chg"), F.when(F.col("_chg").isNotNull(), 0.0)),
                         "_dn": F.greatest(-F.col("_chg"), F.when(F.col("_chg").isNotNull(), 0.0))})
    df = ema(df, 1.0 / n, {"_au": "_up", "_ad": "_dn"}, key, ts)
    strength = F.col("_au") / F.when(F.col("_ad") == 0, 1e-10).otherwise(F.col("_ad"))
    value = F.when((F.col("_au") == 0) & (F.col("_ad") == 0), 50.0).otherwise(100 - 100 / (1 + strength))
    return df.withColumn(f"rsi_{n}", value).drop("_chg", "_up", "_dn", "_au", "_ad")


def _shared(df: DataFrame, extra: dict, key: str, ts: str) -> DataFrame:
    """First projection: everything that only needs raw columns, in one window pass."""
    close, volume = F.col("close"), F.col("volume")
    before = F.lag(close).over(by_bar(key, ts))
    first = {
        "sma_50": full_frame(F.avg, close, 50, trailing(50, key, ts)),
        "vol_ratio": F.try_divide(full_frame(F.avg, volume, 10, trailing(10, key, ts)),
                                  full_frame(F.avg, volume, 90, trailing(90, key, ts))),
        "true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before),
                                 F.abs(F.col("low") - before)),
        **extra,
    }
    df = df.withColumns(first)
    second = {"atr_14": full_frame(F.avg, F.col("true_range"), 14, trailing(14, key, ts))}
    df = crossed_above(df.withColumns(second), key=key, ts=ts)
    return df.drop("true_range")


def recovery_scores(bars: DataFrame, dip=tiers.dip_score, key: str = KEY, ts: str = TS,
                    with_rsi: bool = False) -> DataFrame:
    """Bars + high, drawdown and the recovery scores. `dip` may be any Column -> Column scorer."""
    steps = {f"ret_{k}": lagged_return("close", k, key, ts) for k in RETURN_STEPS}
    df = _shared(bars, {"high_52w": full_frame(F.max, F.col("close"), 252, trailing(252, key, ts)), **steps}, key, ts)
    df = drawdown(df)
    recent = [F.col(f"ret_{k}") for k in RETURN_STEPS[:4]]
    prior = [F.col(f"ret_{k}") for k in RETURN_STEPS[4:]]
    df = df.withColumns({
        "dip_score": dip(F.col("drawdown_52w")),
        "recovery_score": tiers.reversal_score(recent, prior),
        "momentum_score": tiers.momentum_score(recent, F.col("crossed_up")),
        "volume_score": tiers.volume_score(F.col("vol_ratio")),
    })
    df = df.withColumn("composite_score", tiers.weighted_sum(
        {k: F.col(f"{k}_score") for k in tiers.RECOVERY_WEIGHTS}, tiers.RECOVERY_WEIGHTS))
    df = df.drop("crossed_up", *steps)
    return rsi(df, key=key, ts=ts) if with_rsi else df


def entry_scores(bars: DataFrame, key: str = KEY, ts: str = TS) -> DataFrame:
    """Bars + averages, RSI, ATR and the entry scores with their label."""
    steps = {f"ret_{k}": lagged_return("close", k, key, ts) for k in RETURN_STEPS[:4]}
    df = _shared(bars, {"sma_200": full_frame(F.avg, F.col("close"), 200, trailing(200, key, ts)), **steps}, key, ts)
    df = rsi(sma_slope(df, key=key, ts=ts), key=key, ts=ts)
    close = F.col("close")
    df = df.withColumns({
        "trend_score": tiers.trend_score(close, F.col("sma_50"), F.col("sma_200"), F.col("sma_rising"),
                                         ~F.col("sma_rising")),
        "momentum_score": tiers.momentum_score([F.col(s) for s in steps], F.col("crossed_up")),
        "volume_score": tiers.volume_score(F.col("vol_ratio")),
        "rsi_score": tiers.rsi_score(F.col("rsi_14")),
    })
    df = df.withColumn("composite_score", tiers.weighted_sum(
        {k: F.col(f"{k}_score") for k in tiers.ENTRY_WEIGHTS}, tiers.ENTRY_WEIGHTS))
    df = df.withColumn("signal", tiers.entry_signal(F.col("composite_score")))
    return df.drop("crossed_up", "sma_rising", *steps)
