import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitscreen.functions import guards, scalars as fn, stats
from pitscreen.operators import curve, universe as uni, veto
from pitscreen.plans import alerts, positions as pos
from pitscreen.sources import bars as src_bars, membership as src_members

D = dt.date.fromisoformat
FILING = "ticker string, form string, filing_date date, items array<string>, accession string, doc_id bigint"


def test_veto_window_and_reason(spark):
    filings = spark.createDataFrame([("GOOD", "10-K", D("2023-01-02"), [], "a", 1), ("BAD", "8-K", D("2023-03-17"), ["9.01", "1.03"], "b", 2),
                                     ("TURN", "8-K", D("2023-03-17"), ["5.02"], "c", 3)], FILING)
    asks = [("BAD", "2023-03-20"), ("BAD", "2023-06-20"), ("BAD", "2023-03-01"), ("TURN", "2023-03-20"), ("NONE", "2023-03-20"), ("GOOD", "2023-03-20")]
    got = {(r.ticker, str(r.date)): r for r in veto.veto(spark.createDataFrame([(t, D(d)) for t, d in asks], "ticker string, date date"), filings).collect()}
    assert got["BAD", "2023-03-20"].reason == "8-K Item 1.03 filed 2023-03-17: Bankruptcy or Receivership"
    assert [k for k, r in got.items() if r.blocked] == [("BAD", "2023-03-20")]
    assert got["NONE", "2023-03-20"].reason.startswith("unverifiable")


def test_going_concern_reads_only_the_latest_report(spark):
    filings = spark.createDataFrame([("A", "10-K", D("2023-01-02"), [], "a", 1), ("A", "10-Q", D("2023-04-02"), [], "b", 2)], FILING)
    docs = spark.createDataFrame([(1, "raise SUBSTANTIAL doubt about ... Going Concern"), (2, "prepared as a going concern")], "doc_id bigint, text string")
    ask = spark.createDataFrame([("A", D("2023-02-01")), ("A", D("2023-05-01"))], "ticker string, date date")
    got = {str(r.date): r for r in veto.veto(ask, filings, flags=veto.flag_documents(docs)).collect()}
    assert got["2023-02-01"].blocked and "going-concern" in got["2023-02-01"].reason and not got["2023-05-01"].blocked


def test_vetoed_buys_leave_the_buy_list(spark):
    rows = spark.createDataFrame([("GOOD", D("2023-03-20"), "BUY"), ("BAD", D("2023-03-20"), "BUY"), ("BAD2", D("2023-03-20"), "SKIP")], "ticker string, date date, signal string")
    filings = spark.createDataFrame([(t, "8-K", D("2023-03-17"), ["4.02"], "b", 2) for t in ("BAD", "BAD2")], FILING)
    assert {r.ticker: r.signal for r in veto.veto_buys(rows, filings).collect()} == {"GOOD": "BUY", "BAD": "VETO", "BAD2": "SKIP"}


def test_one_day_veto_equals_the_timed_one(spark):
    """Random filings with several a day, later ones, items without distress and null dates."""
    rng = np.random.default_rng(5)
    base, items = D("2023-01-01"), [["1.03"], ["9.01", "4.02"], ["5.02"], [], None]
    rows = [(f"T{rng.integers(25)}", ["8-K", "10-K", "10-Q"][rng.integers(3)], None if rng.random() < 0.05 else base + dt.timedelta(int(rng.integers(200))),
             items[rng.integers(5)], f"{rng.integers(10**6):07d}", int(rng.integers(8))) for _ in range(400)]
    filings = spark.createDataFrame(rows, FILING)
    flags = spark.createDataFrame([(i, i % 2 == 0) for i in range(7)], "doc_id bigint, concern boolean")
    day = D("2023-05-20")
    ask = spark.createDataFrame([(f"T{i}", day) for i in range(30)], "ticker string, date date")
    for options in ({}, {"flags": flags}, {"flags": flags, "lookback": 20}):
        want = veto.veto(ask, filings, **options).select("ticker", "blocked", "reason").orderBy("ticker").collect()
        got = veto.veto_on(ask, filings, F.lit(day), **options).select("ticker", "blocked", "reason").orderBy("ticker").collect()
        assert got == want and any(r.blocked for r in got)
    empty = veto.veto_on(ask, filings.limit(0), F.lit(day), flags=flags).collect()
    assert len(empty) == 30 and not any(r.blocked for r in empty)


def test_deflated_sharpe_reproduces_published_figures(spark):
    year = math.sqrt(252)
    row = spark.createDataFrame([(1759, 0.816 / year, 0.905, 16.03, 0.0537 / 252, 21)], "n bigint, sr double, skew double, kurt double, v double, trials bigint")
    c = {x: F.col(x) for x in row.columns}
    row = row.withColumn("sr0", stats.expected_max_sharpe(c["v"], c["trials"]))
    psr = lambda target: stats.probabilistic_sharpe(c["sr"], target, c["n"], c["skew"], c["kurt"])
    got = row.select((F.col("sr0") * year).alias("sr0"), psr(F.col("sr0")).alias("dsr"), psr(F.lit(0.76 / year)).alias("bench"), psr(F.lit(0.0)).alias("zero")).first()
    assert got.sr0 == pytest.approx(0.445, abs=2e-3) and got.dsr == pytest.approx(0.841, abs=3e-3)
    assert got.bench == pytest.approx(0.560, abs=3e-3) and got.zero == pytest.approx(0.986, abs=3e-3)


def test_business_days_match_numpy(spark):
    base = np.datetime64("2019-12-25")
    pairs = [(str(base + a), str(base + b)) for a in range(0, 20) for b in range(-10, 40, 3)]
    df = spark.createDataFrame([(D(a), D(b)) for a, b in pairs], "a date, b date").withColumn("n", fn.business_days(F.col("a"), F.col("b")))
    for r in df.collect():
        want = np.busday_count(r.a, r.b) if r.b >= r.a else -np.busday_count(r.b, r.a)
        assert r.n == want


def test_exit_and_reminder_rules(spark):
    today = D("2024-06-28")
    entry = lambda n: (np.busday_offset(today, -n).astype(dt.date))
    rows = [("A", entry(252), 100.0, 120.0, True), ("B", entry(222), 100.0, None, False), ("C", entry(230), 100.0, 90.0, True), ("D", entry(221), 100.0, 90.0, False)]
    df = spark.createDataFrame(rows, "ticker string, entry_date date, entry_price double, current_price double, reminder_sent boolean")
    got = {r.ticker: r for r in pos.exit_check(df, F.lit(today)).collect()}
    assert {t: r.alert for t, r in got.items()} == {"A": "EXIT", "B": "REMINDER", "C": None, "D": None}
    assert got["A"].ret == pytest.approx(0.2) and got["B"].ret == 0.0


def test_portfolio_alerts_can_fire_twice(spark):
    hold = spark.createDataFrame([("UP", 100.0, None, None), ("DN", 100.0, None, 5.0), ("OLD", 100.0, None, None)],
                                 "ticker string, entry_price double, alert_up_pct double, alert_down_pct double")
    seen = spark.createDataFrame([("UP", 130.0, "BUY"), ("DN", 94.0, "WATCH")], "ticker string, current_price double, signal string")
    bars = spark.createDataFrame([("OLD", D("2024-01-02"), 300.0)], "ticker string, date date, close double")
    got = sorted((r.ticker, r.alert_type) for r in alerts.portfolio_alerts(hold, seen, bars, F.lit(D("2024-06-28"))).collect())
    assert got == [("DN", "PRICE_TARGET_DOWN"), ("UP", "PRICE_TARGET_UP"), ("UP", "SIGNAL_ON_HELD_TICKER")]


def test_adjusted_bars(spark):
    raw = spark.createDataFrame([("A", D("2024-01-02"), "98", "102", "97", "100", "50", "10"), ("A", D("2024-01-03"), "1", "1", "1", "0", "1", "1"),
                                 ("A", D("2024-01-04"), "1", "1", "1", "x", "1", "1")],
                                "ticker string, date date, open string, high string, low string, close string, adjusted_close string, volume string")
    (row,) = src_bars.adjusted_bars(raw).collect()
    assert (row.open, row.high, row.low, row.close) == (49.0, 51.0, 48.5, 50.0)


def test_membership_lines_and_lookup(spark):
    lines = spark.createDataFrame([("date,tickers",), ('2020-01-01,"B, A,A"',), ('not-a-date,"Z"',), ("2020-02-01,C",), ('2020-03-01," , "',)], "value string")
    parsed = src_members.membership_lines(lines)
    assert sorted((str(r.date), r.tickers) for r in parsed.collect()) == [("2020-01-01", ["A", "B"]), ("2020-02-01", ["C"])]
    long = src_members.exploded(parsed)
    assert sorted(r.ticker for r in uni.members_on(long, F.lit(D("2020-01-31"))).collect()) == ["A", "B"]
    with pytest.raises(Exception, match="precedes"):
        uni.members_on(long, F.lit(D("2019-01-31"))).collect()


def test_number_parsing(spark):
    df = spark.createDataFrame([("1.5",), ("None",), ("NaN",), (None,)], "s string").select(guards.number("s").alias("x"))
    assert [r.x for r in df.collect()] == [1.5, None, None, None]


def test_money_market_and_curve(spark):
    rates = spark.createDataFrame([(D("2024-01-01"), 0.05)], "date date, rate double")
    calendar = spark.createDataFrame([(D("2024-01-01"),), (D("2025-12-31"),)], "date date")
    acc = curve.daily_accrual(rates, calendar)
    spans = spark.createDataFrame([(D("2024-01-10"), D("2025-01-09")), (D("2024-01-10"), D("2024-01-10"))], "s date, e date")
    got = [r.mm_return for r in curve.span_interest(spans, acc, "s", "e").orderBy(F.desc("e")).collect()]
    assert got[0] == pytest.approx(1.05 ** (365 / 365) - 1, abs=1e-9) and got[1] == 0.0
    vals = [("x", D("2023-06-01"), 100.0), ("x", D("2023-12-29"), 120.0), ("x", D("2024-03-01"), 90.0), ("x", D("2024-12-30"), 150.0)]
    m = curve.curve_metrics(spark.createDataFrame(vals, "series string, date date, value double")).first()
    assert m.total_return == pytest.approx(0.5) and m.max_drawdown == pytest.approx(-0.25) and m.best_year == 2024 and m.best_return == pytest.approx(0.25)


def test_null_inputs_stay_null(spark):
    from pyspark.sql import functions as F

    from pitscreen.functions import scalars, tiers
    none = spark.range(1).select(F.lit(None).cast("double").alias("x"))
    got = none.select(scalars.expected_return(F.col("x")), scalars.percentile_step(F.col("x")), tiers.size_weight(F.col("x"))).first()
    assert list(got) == [None, None, None]
    some = spark.range(1).select(*[scalars.expected_return(F.lit(d)) for d in (0, 21, 42, 252, 400)], *[scalars.percentile_step(F.lit(r)) for r in (-0.5, 0.0, 9.0)]).first()
    assert [round(v, 4) for v in some[:5]] == [0.0, 0.02, 0.042, 0.492, 0.492] and list(some[5:]) == [5, 45, 99]


def test_changes_against_the_previous_weekday(spark):
    import datetime as dt

    from pitscreen.plans import alerts
    d = lambda n: dt.date(2024, 3, n)  # noqa: E731  the 1st is a Friday
    rows = [("A", d(1), "BUY"), ("B", d(1), "BUY"), ("A", d(4), "BUY"), ("C", d(4), "WATCH"), ("A", d(6), "BUY")]
    got = {(r.ticker, r.date.day): r.status for r in alerts.weekday_changes(spark.createDataFrame(rows, "ticker string, date date, signal string")).collect()}
    assert got == {("A", 1): "NEW", ("B", 1): "NEW", ("A", 4): "CONTINUING", ("B", 4): "DROPPED", ("A", 6): "NEW"}
