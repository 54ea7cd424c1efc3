"""Incremental versions of the daily jobs, keyed by ticker.

State per ticker is a handful of values. A micro-batch normally brings one row
per ticker; a replay brings at most its calendar-bounded history. Signal changes
and thinned crossings act on rows only: bars of a ticker come in order of their
dates, a row dated at or before the last one taken in is late and ignored, and
tickers do not wait for each other. The life of positions runs on event time:
a timer per ticker fires when the watermark passes the first day due, whether
or not the ticker still trades. Deliveries use the watermark as well.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.guards import holds
from ..plans.positions import EXIT_DAYS, REMIND_FROM

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE_SCHEMA = "ticker string, date date, status string"
LIFE_SCHEMA = "ticker string, entry_date date, date date, alert string, days_held bigint, ret double"
ENTRY_SCHEMA = "ticker string, date date, pos bigint"
DAY_MS = 86_400_000


def _ordered(rows: Iterator[pd.DataFrame], after=None) -> pd.DataFrame:
    """Rows by date, the first of a date only, those at or before `after` left out."""
    df = pd.concat(list(rows)).sort_values("date", kind="stable").drop_duplicates("date")
    return df if after is None else df[df["date"] > after]


def _days(values: Sequence) -> np.ndarray:
    return np.array(list(values), "datetime64[D]")


class _Keyed(StatefulProcessor):
    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("s", self.schema)

    def close(self) -> None:
        pass


class SignalChanges(_Keyed):
    """NEW / CONTINUING / DROPPED against the ticker's previous row; dates already seen are ignored."""
    schema = "signal string, date date"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last_signal, last_date = self.state.get() if self.state.exists() else (None, None)
        df = _ordered(rows, last_date)
        now = (df["signal"] == "BUY").to_numpy()
        before = np.concatenate([[last_signal == "BUY"], now[:-1]]) if len(df) else now
        status = np.select([now & before, now, before], ["CONTINUING", "NEW", "DROPPED"], "")
        if len(df):
            self.state.update((df["signal"].iloc[-1], df["date"].iloc[-1]))
        out = pd.DataFrame({"ticker": key[0], "date": df["date"].to_numpy(), "status": status})
        yield out[out["status"] != ""]


def due_days(entries: np.ndarray, held: int) -> np.ndarray:
    """The first weekday on which each position has been held for `held` weekdays."""
    return np.busday_offset(entries, held, roll="forward")


#: Alerts ahead and closes kept, as they lie in the state: days since 1970-01-01.
ALERT = np.dtype([("due", "i4"), ("entry", "i4"), ("held", "i4"), ("price", "f8")])
CLOSE = np.dtype([("day", "i4"), ("close", "f8")])


class PositionLifecycle(_Keyed):
    """Input rows (ticker, day, close, opened). A reminder on the weekday a position has been held for 222 weekdays, an
    exit at 252, each once the watermark reaches the day, at the last close up to that day. The row that opens a position
    has a close, so there is always one; a null close is no price.

    A ticker has one timer, at the first day due: when it fires, all that the watermark has reached is told at once, and
    the next day due is set. A timer that an earlier day has overtaken finds nothing due.

    State: alerts ahead, and the closes that they may still ask for: all after the watermark, and one before the
    earliest day due. Rows may come in any order within the watermark's delay; of rows for one day the first counts.
    """
    schema = "alerts binary, closes binary"

    def _load(self) -> tuple[np.ndarray, np.ndarray]:
        alerts, closes = self.state.get() or (b"", b"")
        return np.frombuffer(alerts, ALERT), np.frombuffer(closes, CLOSE)

    def _store(self, alerts: np.ndarray, closes: np.ndarray, watermark: int, timer: int | None) -> None:
        """`timer`: the day for which a timer is set."""
        due = int(alerts["due"].min()) if len(alerts) else None
        start = np.searchsorted(closes["day"], watermark if due is None else min(due, watermark), side="right") - 1
        self.state.update((alerts.tobytes(), closes[max(0, int(start)):].tobytes()))
        if due is not None and due != timer:
            self.handle.registerTimer(due * DAY_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        alerts, closes = self._load()
        timer = int(alerts["due"].min()) if len(alerts) else None
        df = pd.concat(list(rows))
        day, first = np.unique(df["day"].to_numpy("i4"), return_index=True)
        price, opened = df["close"].to_numpy(float)[first], df["opened"].to_numpy(bool)[first]
        fresh = ~np.isnan(price) & ~np.isin(day, closes["day"])
        added = np.zeros(int(fresh.sum()), CLOSE)
        added["day"], added["close"] = day[fresh], price[fresh]
        parts, entry = [alerts], added[opened[fresh]]
        for held in (REMIND_FROM, EXIT_DAYS):
            part = np.zeros(len(entry), ALERT)
            part["due"] = due_days(entry["day"].astype("datetime64[D]"), held).astype("i4")
            part["entry"], part["held"], part["price"] = entry["day"], held, entry["close"]
            parts.append(part)
        closes = np.concatenate([closes, added])
        # an expired timer of this batch runs after its rows: it still needs what lies before the new watermark; days after it
        # are kept wherever the first one due lies, or a row that comes again would count as new
        self._store(np.concatenate(parts), closes[np.argsort(closes["day"], kind="stable")], timerValues.getCurrentWatermarkInMs() // DAY_MS, timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        alerts, closes = self._load()
        watermark = timerValues.getCurrentWatermarkInMs() // DAY_MS
        now = alerts["due"] <= watermark
        if not now.any():
            return
        told = alerts[now]
        last = np.searchsorted(closes["day"], told["due"], side="right") - 1
        price = np.where(last < 0, told["price"], closes["close"][np.maximum(last, 0)]) if len(closes) else told["price"]
        self._store(alerts[~now], closes, watermark, None)
        dates = lambda days: days.astype("datetime64[D]").tolist()
        yield pd.DataFrame({"ticker": key[0], "entry_date": dates(told["entry"]), "date": dates(told["due"]),
                            "alert": np.where(told["held"] == EXIT_DAYS, "EXIT", "REMINDER"), "days_held": told["held"].astype("i8"),
                            "ret": price / told["price"] - 1})


class ThinnedCrossings(_Keyed):
    """Crossings into the buy state, thinned to one per `gap` bars. Input rows (ticker, date, in_buy)."""
    schema = "was boolean, pos bigint, kept bigint, date date"

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was, pos, kept, last = self.state.get() if self.state.exists() else (False, 0, None, None)
        df = _ordered(rows, last)
        now = df["in_buy"].fillna(False).to_numpy(bool)
        crossed = np.flatnonzero(now & ~np.concatenate([[was], now[:-1]])) if len(df) else np.zeros(0, int)
        places, taken, at = crossed + pos + 1, [], 0
        while at < len(places):                      # one step per kept crossing
            at = at if kept is None else int(np.searchsorted(places, kept + self.gap))
            if at < len(places):
                kept = int(places[at])
                taken.append(at)
                at += 1
        if len(df):
            self.state.update((bool(now[-1]), pos + len(df), kept, df["date"].iloc[-1]))
        yield pd.DataFrame({"ticker": key[0], "date": df["date"].to_numpy()[crossed[taken]], "pos": places[taken]})


class LatestDeliveries(_Keyed):
    """Rows that are newer than what was delivered for their day before. Input rows (ticker, date, fetched, ...).

    State: the last `fetched` of each day after the watermark; earlier days are final, the engine drops their rows.
    """
    schema = "days array<date>, fetched array<bigint>"

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        days, seen = self.state.get() if self.state.exists() else ([], [])
        known = pd.Series(seen, index=list(days), dtype="int64")
        df = pd.concat(list(rows)).sort_values(["date", "fetched"], kind="stable").drop_duplicates("date", keep="last")
        newer = df[df["fetched"].to_numpy() > known.reindex(df["date"]).fillna(np.iinfo(np.int64).min).to_numpy()]
        known = pd.concat([known.drop(newer["date"], errors="ignore"), newer.set_index("date")["fetched"]])
        open_days = _days(known.index) > np.datetime64(timerValues.getCurrentWatermarkInMs() // DAY_MS, "D")
        known = known[open_days]
        self.state.update((list(known.index), [int(v) for v in known]))
        yield newer[self.columns]


def _stateful(df: DataFrame, processor: StatefulProcessor, schema, time_mode: str = "None", output_mode: str = "Append") -> DataFrame:
    return df.groupBy("ticker").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode=output_mode, timeMode=time_mode)


def _timed(stream: DataFrame, day: str, delay: str) -> DataFrame:
    return stream.withColumn("_ts", F.col(day).cast("timestamp")).withWatermark("_ts", delay)


def signal_changes(stream: DataFrame) -> DataFrame:
    """stream(ticker, date, signal) -> (ticker, date, status)."""
    return _stateful(stream.select("ticker", "date", "signal"), SignalChanges(), CHANGE_SCHEMA)


def position_lifecycle(stream: DataFrame, delay: str = "5 days") -> DataFrame:
    """stream(ticker, date, close, opened) -> reminders and exits that fell due `delay` before the latest row of any ticker."""
    rows = stream.select("ticker", "date", "close", holds(F.col("opened")).alias("opened"))
    timed = _timed(rows, "date", delay).select("ticker", F.unix_date("date").alias("day"), "close", "opened", "_ts")
    return _stateful(timed, PositionLifecycle(), LIFE_SCHEMA, "EventTime")


def thinned_crossings(stream: DataFrame, gap: int = 252) -> DataFrame:
    """stream(ticker, date, in_buy) -> kept entries."""
    return _stateful(stream.select("ticker", "date", "in_buy"), ThinnedCrossings(gap), ENTRY_SCHEMA)


def first_deliveries(stream: DataFrame, keys: list[str], day: str = "date", delay: str = "10 days") -> DataFrame:
    """One row per key: later deliveries inside the watermark are dropped (the first one wins)."""
    return _timed(stream, day, delay).dropDuplicatesWithinWatermark(keys).drop("_ts")


def latest_deliveries(stream: DataFrame, delay: str = "60 days") -> DataFrame:
    """stream(ticker, date, fetched, ...) -> each row that replaces what was delivered before for its (ticker, date).

    Of several rows the one with the greatest `fetched` wins, an equal one is a replay and gives nothing. Rows dated
    `delay` or more before the latest row of earlier batches are late and dropped: their days are final. To be merged
    by key, see `sinks.merge_by_key`.
    """
    return _stateful(_timed(stream, "date", delay), LatestDeliveries(stream.columns), stream.schema, "EventTime", "Update")
