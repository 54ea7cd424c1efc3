"""Steps that grew faster than their input, and rows that came twice: plans without exchanges, and results against plain Python."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitscreen.functions import guards, tiers
from pitscreen.operators import asof, events, exits, indicators as ind
from pitscreen.operators.windows import bar_index
from pitscreen.plans import event_study as es
from pitscreen.session import clustered
from pitscreen.streaming import runner, state


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def weekdays(first, n):
    return np.busday_offset(np.datetime64(first), np.arange(n), roll="forward").astype(object).tolist()


def walk(n, seed, drift=0.0):
    rnd, out = random.Random(seed), [50.0]
    for _ in range(n - 1):
        out.append(max(1.0, out[-1] * (1 + drift + rnd.uniform(-0.04, 0.04))))
    return out


@pytest.fixture
def stored(make_bars):
    return clustered(make_bars({"A": walk(700, 1), "B": walk(300, 2)}).withColumn("pos", bar_index()))


def test_paths_of_stored_bars_are_cut_without_an_exchange(stored):
    arrays = exits.path_arrays(stored.where("pos % 7 = 1"), stored, 252)
    assert "Exchange hashpartitioning" not in plan_of(arrays) and "Exchange SinglePartition" not in plan_of(arrays)
    close = {(r.ticker, r.pos): r.close for r in stored.collect()}
    dates = {(r.ticker, r.date): r.pos for r in stored.collect()}
    got = {(r.ticker, dates[r.ticker, r.entry_date]): r for r in arrays.collect()}
    assert set(got) == {(t, p) for t, p in close if p % 7 == 1 and (t, p + 252) in close}
    for (t, p), r in got.items():
        assert r.entry_price == close[t, p] and [b.c for b in r.ahead] == [close[t, p + d] for d in range(1, 253)]


def test_extremes_inside_arrays_need_no_sort_by_day(stored):
    for horizon in (1, 16, 17, 252):
        arrays = exits.path_arrays(stored.where("pos % 40 = 3"), stored, horizon, full_only=False)
        assert not re.search(r"Sort \[[^\]]*(day|entry_date)#", plan_of(exits.array_extremes(arrays)))
        key = ("ticker", "entry_date", "day", "run_min", "run_max")
        want = exits.running_extremes(exits.long_paths(arrays)).select(*key).collect()
        assert sorted(map(tuple, exits.array_extremes(arrays).select(*key).collect())) == sorted(map(tuple, want))


def test_one_family_is_that_part_of_the_grid(stored):
    arrays = exits.path_arrays(stored.where("pos % 60 = 5"), stored, 252)
    every = exits.exit_outcomes(arrays)
    for family in ("F1", "F3", "F5"):
        want = sorted(map(str, every.where(F.col("family") == family).collect()))
        assert want and sorted(map(str, exits.exit_outcomes(arrays, families=[family]).collect())) == want


def test_a_position_of_the_last_days_that_is_delivered_again_opens_once(spark):
    days = weekdays("2020-01-01", 400)
    rows = [("A", d, 100.0 + i, i in (146, 148)) for i, d in enumerate(days)]
    make = lambda some: spark.createDataFrame(some, "ticker string, date date, close double, opened boolean")
    parts = [make(rows[:150]), make(rows[140:])]                   # the entries of days 146 and 148 come twice, inside the watermark
    got = sorted((r.entry_date, r.alert) for r in runner.run_to_files(parts, lambda s: state.position_lifecycle(s, "5 days"), "twice").collect())
    assert got == sorted((days[i], alert) for i in (146, 148) for alert, held in (("REMINDER", 222), ("EXIT", 252)) if i + held < len(days) - 4)


def test_hold_outcomes_take_one_frame_per_ticker(make_bars):
    bars = make_bars({"A": walk(40, 3), "B": walk(9, 4)})
    for fill, shift in (("next_open", 8), ("same_close", 7)):
        trades = events.fixed_hold_trades(bars, 7, fill)
        assert "currentrow$(), unboundedfollowing$()" not in plan_of(trades)          # a frame that starts anew at each row
        rows = {}
        for r in trades.orderBy("date").collect():
            rows.setdefault(r.ticker, []).append(r)
        for ticker, series in rows.items():
            for i, r in enumerate(series):
                end = min(i + shift, len(series) - 1)
                assert r.exit_price == series[end].close and r.exit_date == series[end].date
                assert r.bars_held == end - i - (fill == "next_open") and r.status == ("CLOSED" if i + shift < len(series) else "OPEN")


def test_averages_that_differ_by_rounding_are_equal(spark):
    """Closes whose long averages agree exactly: 200 days of a pattern with period 20, then the same terms in another order."""
    terms = [20.0001 + 3.7 * i for i in range(20)]
    closes = terms * 10 + list(reversed(terms)) * 3
    days = weekdays("2016-01-01", len(closes))
    bars = spark.createDataFrame([("A", d, c) for d, c in zip(days, closes)], "ticker string, date date, close double")
    rows = ind.sma_slope(ind.sma(bars, 200)).orderBy("date").collect()
    even = [i for i in range(219, len(closes)) if (i + 1) % 20 == 0]
    assert even and all(rows[i].sma_200 == pytest.approx(rows[i - 20].sma_200, rel=1e-13) for i in even)
    assert [rows[i].sma_rising for i in even] == [False] * len(even)
    noisy = spark.createDataFrame([(0.1 + 0.2, 0.3), (0.3, 0.1 + 0.2), (0.3001, 0.3), (0.3, 0.3001), (None, 0.3)], "a double, b double")
    assert [r.x for r in noisy.select(guards.above(F.col("a"), F.col("b")).alias("x")).collect()] == [False, False, True, False, None]
    trend = noisy.select(tiers.trend_score(F.col("a"), F.col("b"), F.col("b"), F.lit(True), F.lit(False)).alias("x"))
    assert [r.x for r in trend.collect()] == [0.0, 0.0, 1.0, 0.0, None]


def test_probes_of_both_sides_share_one_sort(spark):
    rnd = random.Random(5)
    right = spark.createDataFrame([(k, t, float(t)) for k in "AB" for t in sorted(rnd.sample(range(60), 25))] + [("C", 1, None)], "k string, t int, v double")
    left = spark.createDataFrame([(k, t) for k in "ABCD" for t in range(-2, 63)], "k string, at int")
    met = asof.asof_probes(left, right, ["k"], "t", ["t", "v"], {"b": (F.col("at"), "before"), "u": (F.col("at"), "upto"), "f": (F.col("at"), "from")})
    assert "_t#" in plan_of(met) and not re.search(r"Sort \[[^\]]*_t#\d+ DESC", plan_of(met))
    have = {}
    for r in right.collect():
        have.setdefault(r.k, []).append(r.t)
    rows = met.collect()
    assert len(rows) == 4 * 65
    for r in rows:
        times = have.get(r.k, [])
        want = (max((t for t in times if t < r["at"]), default=None), max((t for t in times if t <= r["at"]), default=None), min((t for t in times if t >= r["at"]), default=None))
        assert tuple(x and x.t for x in (r.b, r.u, r.f)) == want


def test_deliveries_and_jobs_score_the_bars_once(spark, monkeypatch):
    """The plans behind the writes read stored scores: none of them holds the 252-bar window of a second scoring."""
    from pitscreen.catalog import QUERIES, inputs, jobs, streams
    seen = []
    monkeypatch.setattr(streams.runner, "run_to_files", lambda parts, *a: seen.extend(parts) or parts[0])
    monkeypatch.setattr(jobs.pos, "observed_run", lambda path, screened, changes, checked: seen.extend([changes, checked]) or changes)
    monkeypatch.setattr(inputs.sinks, "write_run", lambda path, tasks, **outputs: seen.extend(outputs.values()))
    for name in ("str_01_signal_changes", "job_11_run_summary"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    with pytest.raises(Exception):                                 # nothing was written, so nothing can be read back
        QUERIES["snk_02_daily_outputs"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 10 and not any("lineitem" in plan_of(df) for df in seen)
