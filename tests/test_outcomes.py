import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitscreen.operators import events as ev, exits
from pitscreen.operators.windows import bar_index


@pytest.mark.parametrize("horizon", [2, 63, 252])
def test_forward_drawdown_matches_brute_force(make_bars, horizon):
    x = np.random.default_rng(1).uniform(10, 90, 330)
    got = ev.forward_drawdown(make_bars({"A": x}), horizon).orderBy("date").toPandas().max_dd.to_numpy()
    for i in range(len(x)):
        w = x[i:i + horizon]
        if len(w) < 2:
            assert np.isnan(got[i])
        else:
            top = np.maximum.accumulate(w)
            assert got[i] == pytest.approx(((w - top) / top).min(), rel=1e-12)


def test_greedy_suppression(spark):
    df = spark.createDataFrame([("A", p) for p in (1, 5, 100, 253, 254, 300, 506)] + [("B", 7)], "ticker string, pos bigint")
    kept = sorted(tuple(r) for r in ev.suppress_within(df, 252).select("ticker", "pos").collect())
    assert kept == [("A", 1), ("A", 253), ("A", 506), ("B", 7)]


def test_window_return_needs_two_bars(spark, make_bars):
    bars = make_bars({"A": [10.0, 11, 12, 13, 14]})  # 2016-01-01, 04, 05, 06, 07
    req = spark.createDataFrame([("A", dt.date(2016, 1, 2), dt.date(2016, 1, 7)), ("A", dt.date(2016, 1, 2), dt.date(2016, 1, 5)),
                                 ("B", dt.date(2016, 1, 2), dt.date(2016, 1, 7))], "ticker string, s date, e date")
    got = [r.r for r in ev.window_return(req, bars, F.col("s"), F.col("e"), "r").orderBy("ticker", F.desc("e")).collect()]
    assert got[0] == pytest.approx(13 / 11 - 1) and got[1] is None and got[2] is None


def test_fixed_hold_closes_or_stays_open(make_bars):
    out = ev.fixed_hold_trades(make_bars({"A": np.arange(1.0, 9.0)}), 3).orderBy("date").collect()
    assert (out[0].entry_price, out[0].exit_price, out[0].status, out[0].bars_held) == (2.0, 5.0, "CLOSED", 3)
    assert (out[5].entry_price, out[5].exit_price, out[5].status, out[5].bars_held) == (7.0, 8.0, "OPEN", 1)
    assert out[7].entry_price is None


def test_cohort_index_counts_open_positions(spark, make_bars):
    bars = make_bars({"A": [10.0, 11, 12.1], "B": [10.0, 10, 20]})
    days = [r.date for r in bars.where("ticker = 'A'").orderBy("date").collect()]
    trades = spark.createDataFrame([("A", days[0], days[2]), ("A", days[1], days[2]), ("B", days[0], days[1])], "ticker string, entry_date date, exit_date date")
    got = ev.cohort_index(bars, trades).orderBy("date").collect()
    assert got[0].mean_return == pytest.approx(0.05) and got[0].positions == 2
    assert got[1].mean_return == pytest.approx(0.10) and got[1].positions == 2
    assert got[1]["index"] == pytest.approx(1.05 * 1.10)


def brute(path, rule):
    fam, a, b = rule
    last = len(path) - 1
    if fam == "F2":
        hit = [i for i, x in enumerate(path) if x <= 1 - a]
        return hit[0] if hit else last
    if fam == "F3":
        arm = next((i for i, x in enumerate(path) if x >= 1 + a), None)
        if arm is None:
            return last
        top = np.maximum.accumulate(path)
        return next((i for i in range(arm, len(path)) if path[i] <= top[i] * (1 - b)), last)
    if fam == "F5":
        t = next((i for i, x in enumerate(path) if x >= 1 + a), 10 ** 6)
        s = next((i for i, x in enumerate(path) if x <= 1 - b), 10 ** 6)
        return min(t, s, last)


def test_exit_grid_matches_brute_force(make_bars):
    rng = np.random.default_rng(11)
    series = {f"T{k}": 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 260))) for k in range(6)}
    bars = make_bars(series).withColumn("pos", bar_index())
    arrays = exits.path_arrays(bars.where("pos in (1, 4)"), bars, 252)
    out = {(r.ticker, r.entry_date, r.variant): r for r in exits.exit_outcomes(arrays).collect()}
    assert len(out) == 6 * 2 * 29
    rules = {f"Stop {s}%": ("F2", s / 100, 0) for s in (25, 40)} | {f"Arm+{a}% Tr{b}%": ("F3", a / 100, b / 100) for a in (10, 20) for b in (8, 15)} | {
        "Tgt+20% E30%": ("F5", 0.2, 0.3)}
    dates = [r.date for r in bars.where("ticker = 'T0'").orderBy("date").collect()]
    for t, x in series.items():
        for p in (0, 3):
            path = x[p + 1:p + 253] / x[p]
            for name, rule in rules.items():
                i = brute(path, rule)
                got = out[(t, dates[p], name)]
                assert got.hold == i + 1 and got.ret == pytest.approx(path[i] - 1) and got.worst == pytest.approx(path[:i + 1].min())
