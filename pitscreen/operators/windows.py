"""Row-position windows over one instrument.

Bars are unique per (ticker, date), so a ticker's group is bounded by the
calendar (about 25,000 rows for a century of trading days) no matter how many
raw records fed it. All windows here share one partitioning and ordering, so a
plan that chains them has one exchange and one sort.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

KEY, TS = "ticker", "date"


def by_bar(key: str = KEY, ts: str = TS) -> WindowSpec:
    return Window.partitionBy(key).orderBy(ts)


def trailing(n: int, key: str = KEY, ts: str = TS) -> WindowSpec:
    return by_bar(key, ts).rowsBetween(-(n - 1), 0)


def ahead(first: int, last: int, key: str = KEY, ts: str = TS) -> WindowSpec:
    return by_bar(key, ts).rowsBetween(first, last)


def full_frame(agg: Callable[[Column], Column], col: Column, n: int, frame: WindowSpec) -> Column:
    """An aggregate that is NULL until the frame holds n non-null values."""
    return F.when(F.count(col).over(frame) == n, agg(col).over(frame))


def rolling(df: DataFrame, name: str, agg: Callable[[Column], Column], n: int, price: str = "close",
            key: str = KEY, ts: str = TS) -> DataFrame:
    return df.withColumn(name, full_frame(agg, F.col(price), n, trailing(n, key, ts)))


def lagged_return(price: str, k: int, key: str = KEY, ts: str = TS) -> Column:
    close = F.col(price)
    return F.try_divide(close, F.lag(close, k).over(by_bar(key, ts))) - 1


def bar_index(key: str = KEY, ts: str = TS) -> Column:
    return F.row_number().over(by_bar(key, ts)).cast("bigint")


def has_history(df: DataFrame, n: int, key: str = KEY) -> DataFrame:
    """Keep instruments with at least n bars."""
    rows = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("_bars", rows).where(F.col("_bars") >= n).drop("_bars")
