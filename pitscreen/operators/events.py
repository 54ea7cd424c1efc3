"""Event-study outcomes per bar or per signal."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.guards import holds
from ..functions.tiers import recovery_signal
from .asof import asof_probes, interval_join
from .windows import KEY, TS, ahead, bar_index, by_bar

HOLD_BARS = 252
HORIZONS = (21, 63, 126, 252)
TRADE = ("entry_date", "entry_price", "exit_date", "exit_price", "status", "bars_held", "trade_return")


def forward_return(h: int, price: str = "close", key: str = KEY, ts: str = TS) -> Column:
    """Return h bars ahead; NULL past the end or from a zero price."""
    return F.try_divide(F.lead(price, h).over(by_bar(key, ts)), F.col(price)) - 1


def forward_returns(df: DataFrame, horizons: Sequence[int] = HORIZONS, price: str = "close", key: str = KEY,
                    ts: str = TS) -> DataFrame:
    return df.withColumns({f"fwd_{h}": forward_return(h, price, key, ts) for h in horizons})


def next_open(df: DataFrame, key: str = KEY, ts: str = TS) -> DataFrame:
    """Fill at the next bar's open; a non-positive open is no fill."""
    w = by_bar(key, ts)
    price = F.lead("open").over(w)
    return df.withColumns({"fill_price": F.when(price > 0, price), "fill_date": F.lead(ts).over(w)})


def fixed_hold_trades(bars: DataFrame, hold: int = HOLD_BARS, fill: str = "next_open", key: str = KEY,
                      ts: str = TS) -> DataFrame:
    """Outcome of a trade opened on every bar: exit at the close `hold` bars after the
    entry bar, or at the last bar (OPEN). Filter the signals afterwards; everything
    here is one window pass. fill = "next_open" or "same_close"."""
    w = by_bar(key, ts)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one pass; a frame from each row on would be quadratic
    shift = hold + 1 if fill == "next_open" else hold
    out = bars.withColumns({
        "_open1": F.lead("open").over(w), "_date1": F.lead(ts).over(w),
        "_exit": F.lead("close", shift).over(w), "_exit_date": F.lead(ts, shift).over(w),
        "_last": F.last("close").over(whole), "_last_date": F.last(ts).over(whole),
        "_left": F.count(F.lit(1)).over(whole) - F.row_number().over(w)})
    entry, entry_date = ((F.col("_open1"), F.col("_date1")) if fill == "next_open" else (F.col("close"), F.col(ts)))
    taken = F.least(F.col("_left"), F.lit(shift)) - (1 if fill == "next_open" else 0)
    return out.withColumns({
        "entry_date": entry_date, "entry_price": F.when(entry > 0, entry),
        "exit_date": F.coalesce("_exit_date", "_last_date"), "exit_price": F.coalesce("_exit", "_last"),
        "status": F.when(F.col("_exit").isNotNull(), "CLOSED").otherwise("OPEN"), "bars_held": taken,
    }).withColumn("trade_return", F.try_divide(F.col("exit_price"), F.col("entry_price")) - 1).drop(
        "_open1", "_date1", "_exit", "_exit_date", "_last", "_last_date", "_left")


def adverse_excursion(df: DataFrame, horizon: int = HOLD_BARS, require_full: bool = False, price: str = "close",
                      name: str = "mae", key: str = KEY, ts: str = TS) -> DataFrame:
    """Worst close of the next `horizon` bars against this one."""
    frame = ahead(1, horizon, key, ts)
    low = F.min(price).over(frame)
    if require_full:
        low = F.when(F.count(price).over(frame) == horizon, low)
    return df.withColumn(name, F.when(F.col(price) > 0, low / F.col(price) - 1))


def touch_flags(df: DataFrame, mae: str = "mae", levels: Sequence[int] = (10, 15, 20)) -> DataFrame:
    return df.withColumns({f"touched_{n}": holds(F.col(mae) <= -n / 100.0) for n in levels})


def forward_drawdown(df: DataFrame, horizon: int = HOLD_BARS, price: str = "close", name: str = "max_dd",
                     key: str = KEY, ts: str = TS) -> DataFrame:
    """Deepest peak-to-trough fall over the next `horizon` bars, this one included.

    The fall over two adjacent blocks is the worst of each block's fall and the
    second block's low against the first one's high. Blocks of 1, 2, 4, ... bars
    are merged that way, so the cost grows with log2(horizon) and no per-row
    array of the whole horizon is ever built.
    """
    w = by_bar(key, ts)

    def block(level: int) -> list[str]:
        return [f"_hi{level}", f"_lo{level}", f"_dd{level}"]

    def later(level: int, shift: int) -> list[Column]:
        return [F.lead(c, shift).over(w) for c in block(level)]

    def merged(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
        cross = F.try_divide(b[1] - a[0], a[0])
        return [F.greatest(a[0], b[0]), F.least(a[1], b[1]), F.least(a[2], b[2], cross)]

    levels = [i for i in range(horizon.bit_length()) if horizon >> i & 1]
    df = df.withColumns(dict(zip(block(0), [F.col(price), F.col(price), F.lit(0.0)])))
    for level in range(max(levels)):
        ahead_cols = [f"_n{i}" for i in range(3)]
        df = df.withColumns(dict(zip(ahead_cols, later(level, 1 << level))))
        pair = merged([F.col(c) for c in block(level)], [F.col(c) for c in ahead_cols])
        df = df.withColumns(dict(zip(block(level + 1), pair))).drop(*ahead_cols)
    shift, parts = 0, {}
    for level in reversed(levels):
        for i, c in enumerate(later(level, shift) if shift else [F.col(c) for c in block(level)]):
            parts[f"_q{level}_{i}"] = c
        shift += 1 << level
    df = df.withColumns(parts)
    total = None
    for level in reversed(levels):
        nxt = [F.col(f"_q{level}_{i}") for i in range(3)]
        if total is None:
            total = nxt
        else:
            df = df.withColumns(dict(zip(["_thi", "_tlo", "_tdd"], merged(total, nxt))))
            total = [F.col("_thi"), F.col("_tlo"), F.col("_tdd")]
    has_two = F.lead(price, 1).over(w).isNotNull()
    df = df.withColumn(name, F.when(has_two, total[2]))
    return df.drop("_thi", "_tlo", "_tdd", *parts, *[c for lv in range(max(levels) + 1) for c in block(lv)])


def near_local_low(df: DataFrame, span: int = 30, pct: float = 0.15, price: str = "close", key: str = KEY,
                   ts: str = TS) -> DataFrame:
    """Close within the lowest share of the surrounding bars (frames are cut at the ends)."""
    frame = ahead(-span, span, key, ts)
    return df.withColumn("near_min", F.col(price) <= F.percentile(price, F.lit(pct)).over(frame))


def crossings(df: DataFrame, in_buy: Column, key: str = KEY, ts: str = TS) -> DataFrame:
    """Bars where the buy state switches on; a missing state counts as off."""
    df = df.withColumn("_buy", holds(in_buy))
    before = F.coalesce(F.lag("_buy").over(by_bar(key, ts)), F.lit(False))
    return df.withColumn("crossed", F.col("_buy") & ~before).drop("_buy")


def suppress_within(entries: DataFrame, gap: int = HOLD_BARS, position: str = "pos", key: str = KEY) -> DataFrame:
    """Greedy thinning: drop entries fewer than `gap` bars after the last kept one.

    The entries of a ticker (calendar-bounded, usually tens; pass narrow rows) are gathered and folded once, in one
    exchange by ticker; nothing is joined back.
    """
    row = F.struct(F.col(position).cast("bigint").alias("_p"), F.struct(*entries.columns).alias("_row"))
    gathered = entries.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    nothing = F.filter("_all", lambda x: F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        take = acc["last"].isNull() | (x["_p"] - acc["last"] >= gap) | (x["_p"] == acc["last"])   # rows of a kept bar stay together
        return F.struct(F.when(take, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
                        F.when(take, x["_p"]).otherwise(acc["last"]).alias("last"))

    start = F.struct(nothing.alias("kept"), F.lit(None).cast("bigint").alias("last"))
    kept = gathered.select(F.explode(F.aggregate("_all", start, step, lambda acc: acc["kept"])).alias("_k"))
    return kept.select("_k._row.*")


def hash_sample(ticker: Column, day: Column, seed: int = 42, one_in: int = 10) -> Column:
    """A reproducible one-in-n baseline sample that does not depend on row order."""
    digest = F.md5(F.concat_ws("|", ticker, F.date_format(day, "yyyy-MM-dd"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % one_in == 0


def slope_regime(calendar: DataFrame, price: str = "close", ts: str = TS, n: int = 200, back: int = 20,
                 name: str = "regime") -> DataFrame:
    """bull / bear by the slope of the long average; warm-up counts as bear."""
    w = Window.partitionBy("_series").orderBy(ts)  # one row per calendar day
    avg = F.when(F.count(price).over(w.rowsBetween(-(n - 1), 0)) == n, F.avg(price).over(w.rowsBetween(-(n - 1), 0)))
    df = calendar.withColumn("_series", F.lit(1)).withColumn("_sma", avg)
    rising = holds(F.col("_sma") > F.lag("_sma", back).over(w))
    return df.withColumn(name, F.when(rising, "bull").otherwise("bear")).drop("_series", "_sma")


def level_regime(calendar: DataFrame, price: str = "close", ts: str = TS, n: int = 200,
                 name: str = "above_ma") -> DataFrame:
    """TRUE when the close is at or above its long average; warm-up counts as below."""
    w = Window.partitionBy("_series").orderBy(ts).rowsBetween(-(n - 1), 0)
    df = calendar.withColumn("_series", F.lit(1))
    avg = F.when(F.count(price).over(w) == n, F.avg(price).over(w))
    return df.withColumn(name, holds(F.col(price) >= avg)).drop("_series")


def label_by_date(df: DataFrame, calendar: DataFrame, column: str, default: str = "unknown", ts: str = TS) -> DataFrame:
    """Attach a per-date label. The calendar side holds one row per day, so it is always small enough to broadcast."""
    days = calendar.select(F.col(ts).alias("_d"), F.col(column).alias("_label"))
    return df.join(F.broadcast(days), F.col(ts) == F.col("_d"), "left").withColumn(
        column, F.coalesce("_label", F.lit(default))).drop("_d", "_label")


def daily_top(candidates: DataFrame, k: int, score: str = "composite_score", ts: str = TS) -> DataFrame:
    """The k best candidates of every day. The limit runs before the shuffle."""
    w = Window.partitionBy(ts).orderBy(F.desc(score), KEY)
    return candidates.withColumn("day_rank", F.row_number().over(w).cast("bigint")).where(F.col("day_rank") <= k)


def new_signal_counts(signals: DataFrame, calendar: DataFrame, in_buy: Column) -> DataFrame:
    """Tickers in the buy set of a trading day that were not in the set of the previous trading day."""
    w = Window.partitionBy("_all").orderBy("date")
    days = calendar.select("date").withColumn("_all", F.lit(1)).withColumn("_prev", F.lag("date").over(w)).drop("_all")
    buys = signals.where(holds(in_buy)).select("ticker", "date")
    dated = buys.join(F.broadcast(days), "date")
    last_buy = F.lag("date").over(by_bar())
    fresh = dated.withColumn("_new", holds(last_buy == F.col("_prev")) == F.lit(False))
    return fresh.groupBy("date").agg(F.count_if("_new").alias("new_signals"), F.count(F.lit(1)).alias("buys"))


def cohort_index(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """Equal-weight mean daily return of all open positions, compounded over dates.

    A position is open on the bars after its entry date up to its exit date.
    Counting +1 / -1 marks along each ticker gives the number of open positions
    per bar, so positions are never paired with bars.
    """
    marks = (trades.select("ticker", F.col("entry_date").alias("date"), F.lit(1).alias("m"))
             .unionByName(trades.select("ticker", F.col("exit_date").alias("date"), F.lit(-1).alias("m")))
             .groupBy("ticker", "date").agg(F.sum("m").alias("_m")))
    rows = bars.select("ticker", "date", "close").join(marks, ["ticker", "date"], "left")
    w = by_bar()
    rows = rows.withColumns({"_open": F.sum(F.coalesce("_m", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                             "_r": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1})
    daily = rows.where((F.col("_open") > 0) & F.col("_r").isNotNull()).groupBy("date").agg(
        (F.sum(F.col("_open") * F.col("_r")) / F.sum("_open")).alias("mean_return"), F.sum("_open").alias("positions"))
    run = Window.partitionBy("_all").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("_all", F.lit(1)).withColumn(
        "index", F.exp(F.sum(F.log1p("mean_return")).over(run))).drop("_all")


def window_returns(requests: DataFrame, bars: DataFrame, windows: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """First-to-last close return of the bars in [start, end) for each named window of a request; NULL with fewer than
    two bars. The edge bars of all windows come from one pass over the bars, which are never paired with requests.
    Equal requests come back as one."""
    edges = bars.select("ticker", "date", "close")
    probes = {}
    for name, (start, end) in windows.items():
        probes |= {f"_first_{name}": (start, "from"), f"_last_{name}": (end, "before")}
    met = asof_probes(requests, edges.withColumn("_day", F.col("date")), ["ticker"], "date", ["_day", "close"], probes)
    returns = {}
    for name in windows:
        first, last = F.col(f"_first_{name}"), F.col(f"_last_{name}")
        returns[name] = F.when(last["_day"] > first["_day"], F.try_divide(last["close"] - first["close"], first["close"]))
    return met.withColumns(returns).drop(*probes)


def window_return(requests: DataFrame, bars: DataFrame, start: Column, end: Column, name: str) -> DataFrame:
    """`window_returns` of one window."""
    return window_returns(requests, bars, {name: (start, end)})


def first_bar_after(positions: DataFrame, bars: DataFrame, held: int) -> DataFrame:
    """positions(ticker, entry_date, ...) with date and close of the first bar on which they have been held for `held`
    weekdays; positions that never get there are left out."""
    from ..functions.scalars import business_days
    # the first weekday held long enough lies within a week of this day, and no bar before it can qualify
    early = F.date_add("entry_date", held * 7 // 5 - 3)
    due = F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.date_add(early, i)),
                               lambda d: business_days(F.col("entry_date"), d) >= held))
    closes = bars.select("ticker", F.col("date").alias("_date"), F.col("date"), "close")
    met = asof_probes(positions, closes, ["ticker"], "_date", ["date", "close"], {"_due": (due, "from")})
    return met.where(F.col("_due").isNotNull()).select(*positions.columns, "_due.date", "_due.close")


def case_windows(cases: DataFrame, scored: DataFrame, days: int = 20, buy: float = 0.60) -> DataFrame:
    """cases(ticker, case_date, gate) + best composite and first BUY date within +-days calendar days, its offset,
    and of the last bar up to the case date: drawdown, composite, signal and 63-bar return.

    A bar is a BUY only where the gate of the case is true. The window is an interval join, so a case meets the
    bars of two time blocks of its ticker, not the ticker's whole history.
    """
    base = scored.select("ticker", "date", "composite_score", "drawdown_52w", forward_return(63).alias("fwd_63"))
    keyed = cases.withColumn("_until", F.date_add("case_date", days))
    joined = interval_join(keyed, base, ["ticker"], "_until", "date", 2 * days)
    is_buy = holds(F.col("gate")) & (F.col("composite_score") >= buy)
    on_day = F.when(F.col("date") <= F.col("case_date"), F.col("date"))
    out = joined.groupBy("ticker", "case_date", "gate").agg(
        F.max("composite_score").alias("max_window_score"), F.min(F.when(is_buy, F.col("date"))).alias("first_buy"),
        *[F.max_by(c, on_day).alias(n) for c, n in (("drawdown_52w", "case_drawdown"), ("composite_score", "case_score"), ("fwd_63", "fwd_63"))])
    return out.withColumns({"offset_days": F.datediff("first_buy", "case_date").cast("bigint"),
                            "case_signal": recovery_signal(F.col("case_score"), F.col("gate"), below="WATCH")})


def cases_pass(windows: DataFrame, need: int = 3) -> DataFrame:
    """One row: how many cases had a BUY in their window, and whether that is enough."""
    return windows.agg(F.count(F.lit(1)).alias("cases"), F.count("first_buy").alias("with_buy")).withColumn("pass_cases", F.col("with_buy") >= need)


def best_per_ticker(candidates: DataFrame, top: int = 20) -> DataFrame:
    """One candidate per ticker (near a low first, then the larger 63-bar return), best `top` overall."""
    w = Window.partitionBy("ticker").orderBy(F.desc("near_min"), F.desc("fwd_63"), "date")
    one = candidates.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
    return one.orderBy(F.desc("fwd_63"), "ticker").limit(top)
