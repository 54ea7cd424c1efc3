"""Timers and upserts of the streams, tables kept on disk, file sources, and the one-pass operators against plain Python."""
import datetime as dt
import math
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitscreen.operators import asof, curve, events, exits, ranking, universe as uni
from pitscreen.operators.windows import bar_index
from pitscreen.plans import event_study as es, positions as pos
from pitscreen.session import scratch_path
from pitscreen.sources import facts as src_facts, filings as src_filings, membership as src_members, sinks
from pitscreen.streaming import runner, state

D = dt.date.fromisoformat


def weekdays(first, n):
    return np.busday_offset(np.datetime64(first), np.arange(n), roll="forward").astype(object).tolist()


def test_positions_fall_due_without_new_bars(spark):
    """GONE stops trading after 100 bars, ON goes on; the calendar moves on with ON alone."""
    days = weekdays("2020-01-01", 320)
    rows = [("ON", d, 100.0 + i, i == 3) for i, d in enumerate(days)] + [("GONE", d, 50.0 + i, i in (0, 99)) for i, d in enumerate(days[:100])]
    rows += [("GONE", days[100], None, False)]                     # no price that day
    make = lambda some: spark.createDataFrame(some, "ticker string, date date, close double, opened boolean")
    first, second = [r for r in rows if r[1] < days[150]], [r for r in rows if r[1] >= days[140]]   # ten days come twice
    got = {(r.ticker, r.entry_date, r.alert): r for r in runner.run_to_files([make(first), make(second)], lambda s: state.position_lifecycle(s, "3 days"), "t").collect()}
    want = {}
    for ticker, at in (("ON", 3), ("GONE", 0), ("GONE", 99)):
        for alert, held in (("REMINDER", 222), ("EXIT", 252)):
            if at + held < len(days) - 3:
                last = at + held if ticker == "ON" else min(at + held, 99)
                base = 100.0 if ticker == "ON" else 50.0
                want[ticker, days[at], alert] = (days[at + held], held, (base + last) / (base + at) - 1)
    assert set(got) == set(want) and ("GONE", days[0], "EXIT") in want
    for key, (day, held, ret) in want.items():
        assert got[key].date == day and got[key].days_held == held and got[key].ret == pytest.approx(ret)


def test_due_days_agree_with_weekday_counts():
    entries = np.arange(np.datetime64("2023-12-25"), np.datetime64("2024-01-10"))
    for held in (1, 5, 222):
        for e, d in zip(entries, state.due_days(entries, held)):
            assert np.is_busday(d) and np.busday_count(e, d) >= held
            before = np.busday_offset(d, -1)
            assert np.busday_count(e, before) < held


def test_refetched_rows_replace_earlier_ones(spark):
    make = lambda rows: spark.createDataFrame([(t, D(d), D(d).replace(day=1), f, v) for t, d, f, v in rows], "ticker string, date date, month date, fetched bigint, close double")
    first = make([("A", "2024-01-02", 1, 1.0), ("A", "2024-03-01", 1, 2.0), ("B", "2024-03-04", 1, 3.0), ("A", "2024-03-01", 0, 9.0)])
    again = make([("A", "2024-01-02", 2, 10.0), ("A", "2024-03-01", 2, 20.0), ("A", "2024-03-05", 2, 4.0), ("B", "2024-02-28", 2, 5.0)])
    path = scratch_path(spark, "latest")
    late = "10 days"                                               # 2024-01-02 is final when the second delivery comes
    run = lambda ds: runner.run_to_table(ds, lambda s: state.latest_deliveries(s, late), path, "latest", ["ticker", "date"], "month")
    run([first, again, again, first])
    got = sorted((r.ticker, str(r.date), r.fetched, r.close) for r in spark.read.schema(first.schema).parquet(path).collect())
    assert got == [("A", "2024-01-02", 1, 1.0), ("A", "2024-03-01", 2, 20.0), ("A", "2024-03-05", 2, 4.0), ("B", "2024-02-28", 2, 5.0), ("B", "2024-03-04", 1, 3.0)]


def files(path):
    return {str(p) for p in Path(path.removeprefix("file:")).rglob("*.parquet")}


def test_a_refresh_rewrites_recent_months_only(spark):
    path = scratch_path(spark, "grid")
    asks = spark.createDataFrame([(t, D(f"2024-{m:02d}-01")) for m in range(1, 9) for t in "AB"], "ticker string, as_of date")
    with_cap = lambda value: lambda r: r.withColumn("mcap", F.lit(value))
    today = F.lit("2024-09-01").cast("date")                       # 120 days before: 2024-05-04
    sinks.refresh_stored_grid(spark, path, asks.where("as_of < '2024-08-01'"), today, with_cap(1.0))
    before = files(path)
    sinks.refresh_stored_grid(spark, path, asks, today, with_cap(2.0))
    after = files(path)
    months = lambda names: {n.split("month=")[1][:7] for n in names}
    assert months(before & after) == {f"2024-{m:02d}" for m in range(1, 6)} and months(after - before) == {"2024-06", "2024-07", "2024-08"}
    got = spark.read.parquet(path)
    assert got.count() == 16 and {str(r.as_of): r.mcap for r in got.collect()} == {f"2024-{m:02d}-01": 1.0 if m < 6 else 2.0 for m in range(1, 9)}


def test_observed_counters_come_with_the_files(spark):
    day = D("2024-01-05")
    screen = spark.createDataFrame([(day, t, s) for t, s in (("A", "BUY"), ("B", "VETO"), ("C", "SKIP"))], "as_of date, ticker string, signal string")
    diff = spark.createDataFrame([(day, "A", "NEW"), (day, "D", "DROPPED")], "as_of date, ticker string, status string")
    held = spark.createDataFrame([(day, "A", "EXIT"), (day, "B", None)], "as_of date, ticker string, alert string")
    path = scratch_path(spark, "run")
    got = pos.observed_run(path, screen, diff, held).first().asDict()
    assert got == {"scanned": 3, "buys": 1, "vetoed": 1, "new": 1, "continuing": 0, "dropped": 1, "exits": 1, "reminders": 0, "positions": 2}
    assert [spark.read.parquet(f"{path}/{name}").count() for name in ("screen", "changes", "exits")] == [3, 2, 2]


def test_unread_concepts_are_pruned(spark):
    path = scratch_path(spark, "facts")
    facts = spark.createDataFrame([("A", c, float(i)) for i, c in enumerate(("Revenues", "Assets", "NetIncomeLoss", "Revenues"))], "ticker string, concept string, val double")
    src_facts.write_by_concept(facts, path)
    some = src_facts.read_concepts(spark, path, ["Revenues"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(concept" in plan or "PartitionFilters: [concept" in plan
    read = {r[0] for r in some.select(F.input_file_name()).collect()}
    assert some.count() == 2 and len(files(path)) == 3 and len(read) == 1 and "concept=Revenues" in read.pop()
    wanted = spark.createDataFrame([("Assets",)], "concept string")
    assert [r.val for r in src_facts.read_concepts(spark, path, wanted).collect()] == [1.0]


def test_file_sources_leave_malformed_lines_out(spark, tmp_path):
    (tmp_path / "m.csv").write_text('date,tickers\n2024-01-01,"B, A,B"\nno date,"C"\n\n2024-02-01,""\n')
    assert [(str(r.date), r.tickers) for r in src_members.read_membership(spark, str(tmp_path / "m.csv")).collect()] == [("2024-01-01", ["A", "B"])]
    (tmp_path / "c.csv").write_text("Symbol,Sector,Date added\nA,x,2020-01-01\nlonely\nB,y,unknown\nC,z,2024-01-01,surplus\n")
    got = src_members.members_by_add_date(src_members.read_constituents(spark, str(tmp_path / "c.csv")), F.lit("2021-01-01").cast("date"))
    assert sorted(r.symbol for r in got.collect()) == ["A", "B"]
    assert {r.line for r in src_members.corrupt_lines(spark, str(tmp_path / "c.csv")).collect()} == {"lonely", "C,z,2024-01-01,surplus"}
    (tmp_path / "r.csv").write_text("DATE,RATE\n2024-01-01,5.0\n2024-01-02,.\n2024-01-03\n")
    assert [(str(r.date), r.rate) for r in src_members.read_rates(spark, str(tmp_path / "r.csv")).collect()] == [("2024-01-01", 0.05)]


def test_shards_repeat_filings_once(spark):
    block = lambda *acc: [("A", ["8-K"] * len(acc), ["2024-01-02"] * len(acc), ["1.03"] * len(acc), list(acc), ["m.htm"] * len(acc))]
    schema = "ticker string, " + ", ".join(f"{f} array<string>" for f in src_filings.FIELDS)
    got = src_filings.merge_shards(spark.createDataFrame(block("1", "2"), schema), spark.createDataFrame(block("2", "3"), schema))
    assert sorted(r.accession for r in got.collect()) == ["1", "2", "3"]


def test_alignment_fills_gaps_forward_only(spark):
    rng = random.Random(4)
    days = [D("2024-01-01") + dt.timedelta(days=i) for i in range(60)]
    rows = [(t, d, rng.random()) for t in "ABC" for d in days if rng.random() < 0.4] + [("ONE", days[7], 1.0)]
    rows = [r for r in rows if not (r[0] == "B" and r[1] < days[20])]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    calendar, want = sorted({r[1] for r in rows}), {}
    for t in {r[0] for r in rows}:
        mine = {d: c for x, d, c in rows if x == t}
        last = None
        for d in calendar:
            if min(mine) <= d <= max(mine):
                last = mine.get(d, last)
                want[t, d] = (last, d not in mine)
    assert {(r.ticker, r.date): (r.close, r.filled) for r in curve.aligned(bars, bars).collect()} == want


def test_probes_answer_every_side_in_one_pass(spark):
    rng = random.Random(6)
    bars = [(t, D("2024-01-01") + dt.timedelta(days=d), float(d)) for t in "AB" for d in sorted(rng.sample(range(100), 30))]
    asks = [(t, D("2024-01-01") + dt.timedelta(days=d)) for t in "ABC" for d in range(-3, 104)]
    left = spark.createDataFrame(asks, "ticker string, day date")
    right = spark.createDataFrame(bars, "ticker string, date date, x double")
    got = asof.asof_probes(left, right, ["ticker"], "date", ["x"], {"b": (F.col("day"), "before"), "u": (F.col("day"), "upto"), "f": (F.col("day"), "from"), "l": (F.date_add("day", 5), "from")})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    seen = got.collect()
    assert len(seen) == len(asks)
    for r in seen:
        mine = [(d, x) for t, d, x in bars if t == r.ticker]
        pick = lambda some: some[0][1] if some else None
        value = lambda s: s.x if s else None
        assert value(r.b) == pick([m for m in mine if m[0] < r.day][::-1]) and value(r.u) == pick([m for m in mine if m[0] <= r.day][::-1])
        assert value(r.f) == pick([m for m in mine if m[0] >= r.day]) and value(r.l) == pick([m for m in mine if m[0] >= r.day + dt.timedelta(days=5)])


def test_selection_also_adds_up_rows_without_a_value(spark):
    rng = np.random.default_rng(5)
    rows = [("g", float(v) if i % 5 else None, float(i)) for i, v in enumerate(rng.normal(0, 3, 2000))] + [("none", None, 1.0), ("none", None, 2.0), ("one", 4.0, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = {r.k: r for r in ranking.quantile_summary(df, ["k"], "v", {"p1": 0.01, "m": 0.5, "p999": 0.999}, {"n": F.lit(1), "s": F.col("w")}).collect()}
    for k, part in defaultdict(list, {k: [r for r in rows if r[0] == k] for k in ("g", "none", "one")}).items():
        values = [v for _, v, _ in part if v is not None]
        want = np.percentile(values, [1, 50, 99.9]).tolist() if values else [None] * 3
        assert got[k].n == len(part) and (got[k].s or 0) == pytest.approx(sum(w or 0 for _, _, w in part))
        assert [got[k].p1, got[k].m, got[k].p999] == (pytest.approx(want) if values else want)


def test_paths_run_through_blocks(spark, make_bars):
    rng = np.random.default_rng(3)
    prices = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 700)))
    bars = make_bars({"A": prices, "B": prices[:300]}).withColumn("pos", bar_index())
    arrays = exits.path_arrays(bars.where("pos in (1, 49, 50, 99, 251, 640)"), bars, horizon=120, full_only=False, block=50)
    got = {(r.ticker, r.entry_price): r for r in arrays.collect()}
    for t, n in (("A", 700), ("B", 300)):
        for p in (1, 49, 50, 99, 251, 640):
            if p <= n:
                r = got[t, prices[p - 1]]
                assert [b.c for b in r.ahead] == pytest.approx(prices[p:min(n, p + 120)].tolist())


def test_folded_exits_match_a_loop(spark):
    rng = np.random.default_rng(9)
    day0 = D("2020-01-06")
    rows = []
    for k in range(12):
        path = 100 * np.exp(np.cumsum(rng.normal(-0.001 * (k % 3), 0.03, 600)))
        rows.append((f"T{k}", day0, 100.0, [(day0 + dt.timedelta(days=i + 1), float(c), None, None if i % 9 == 0 else float(rng.random() * 0.6 + 0.34 * (k % 2))) for i, c in enumerate(path)]))
    arrays = spark.createDataFrame(rows, "ticker string, entry_date date, entry_price double, ahead array<struct<d: date, c: double, a: double, s: double>>")
    got = {(r.ticker, r["mode"]): (r.reason, r.day, r.ret) for r in exits.folded_exits(arrays).collect()}
    reasons = set()
    for t, e, p, path in rows:
        for mode in ("price", "threshold_or_252d", "threshold_only"):
            top, why = 1.0, "open"
            for i, (d, c, _, s) in enumerate(path):
                x, held = c / p, int(np.busday_count(e, d))
                top = max(top, x)
                decayed = s is not None and s < 0.35
                if mode == "price":
                    why = "take_profit" if x - 1 >= 0.3 else "stop_loss" if x - 1 <= -0.4 else "trailing_stop" if x / top - 1 <= -0.5 else "252d" if held >= 252 else "open"
                elif mode == "threshold_or_252d":
                    why = "252d" if held >= 252 else "threshold" if decayed else "open"
                else:
                    why = "504d_cap" if held >= 504 else "threshold" if decayed else "open"
                if why != "open":
                    break
            reasons.add(why)
            assert got[t, mode][:2] == (why, i + 1) and got[t, mode][2] == pytest.approx(c / p - 1)
    assert {"threshold", "take_profit"} <= reasons


def test_audit_verdict_needs_enough_closed_trades(spark):
    make = lambda n, r: spark.createDataFrame([("T", D("2024-01-01") + dt.timedelta(days=i), "CLOSED", r) for i in range(n)] + [("O", D("2024-05-01"), "OPEN", 9.0)], "ticker string, date date, status string, trade_return double")
    verdict = lambda n, r: {x.verdict for x in es.audit_report(make(n, r)).collect()}
    assert verdict(4, 0.9) == {"TOO FEW"} and verdict(5, 0.3) == {"SUPPORTS"} and verdict(5, 0.2) == {"CONTRADICTS"}


def test_membership_before_the_first_snapshot_is_unknown(spark):
    m = spark.createDataFrame([(D("2024-01-10"), t) for t in "AB"] + [(D("2024-01-20"), "A")], "date date, ticker string")
    days = spark.createDataFrame([(D(f"2024-01-{d}"),) for d in ("05", "10", "15", "25")], "date date")
    assert {str(r.date): r.members for r in uni.members_per_day(m, days).collect()} == {"2024-01-05": None, "2024-01-10": 2, "2024-01-15": 2, "2024-01-25": 1}


def test_first_bar_after_counts_weekdays(spark):
    days = [d for d in weekdays("2024-01-01", 60) if d.day % 3]
    bars = spark.createDataFrame([("A", d, float(i)) for i, d in enumerate(days)], "ticker string, date date, close double")
    asks = spark.createDataFrame([("A", d) for d in days], "ticker string, entry_date date")
    got = {r.entry_date: r.date for r in events.first_bar_after(asks, bars, 22).collect()}
    want = {}
    for e in days:
        later = [d for d in days if np.busday_count(e, d) >= 22]
        if later:
            want[e] = later[0]
    assert got == want and math.isfinite(len(want))
