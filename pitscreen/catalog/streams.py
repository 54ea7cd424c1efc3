"""Streaming jobs run to completion over replayed deliveries, against their batch definition in SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tiers
from ..functions.guards import holds
from ..operators import events as ev, indicators as ind
from ..operators.windows import has_history
from ..plans import event_study as es
from ..session import clustered, scratch_path
from ..sources import star
from ..streaming import runner, state
from .base import query
from .ctes import W, busday

CUT = "1999-06-30"


def _halves(df, day="date", overlap=0):
    """Two deliveries; the second may repeat the last days of the first."""
    cut = F.lit(CUT).cast("date")
    return [df.where(F.col(day) <= cut), df.where(F.col(day) > F.date_sub(cut, overlap))]


def _scored(spark, sf):
    """Scored bars, stored once: every delivery is cut from them."""
    rows = ind.recovery_scores(has_history(star.bars(spark, sf), 252))
    return clustered(rows.select("ticker", "date", "close", "composite_score"))


@query("str_01_signal_changes", f"""
SELECT ticker, date, CASE WHEN b AND was THEN 'CONTINUING' WHEN b THEN 'NEW' ELSE 'DROPPED' END AS status FROM (
 SELECT *, coalesce(lag(b) OVER ({W}), FALSE) AS was FROM (SELECT ticker, date, coalesce(composite_score >= CAST(0.6 AS DOUBLE), FALSE) AS b FROM scored)) WHERE b OR was""")
def _(spark, sf):
    rows = _scored(spark, sf).select("ticker", "date", tiers.recovery_signal(F.col("composite_score"), F.lit(True)).alias("signal"))
    return runner.run_to_files(_halves(rows, overlap=20), state.signal_changes, "changes")


#: Deliveries in which the bars of every tenth ticker stop early; its positions still fall due.
STOPPED = "(SELECT * FROM scored WHERE NOT (CAST(ticker AS BIGINT) % 10 = 3 AND date > DATE '1998-01-01'))"
DUE = f"""(SELECT e.ticker, e.date AS entry_date, e.close AS entry_price, d.alert, d.held,
  (SELECT min(x) FROM (SELECT CAST(unnest(generate_series(e.date + CAST(d.held * 7 // 5 - 3 AS INTEGER), e.date + CAST(d.held * 7 // 5 + 6 AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS x)
   WHERE isodow(x) <= 5 AND {busday('e.date', 'x')} >= d.held) AS due
  FROM (SELECT c.* FROM crossed c JOIN {STOPPED} USING (ticker, date)) e, (VALUES ('REMINDER', 222), ('EXIT', 252)) d(alert, held))"""


@query("str_02_position_lifecycle", f"""
SELECT d.ticker, d.entry_date, d.due AS date, d.alert, d.held AS days_held, b.close / d.entry_price - 1 AS ret
FROM {DUE} d ASOF JOIN {STOPPED} b ON b.ticker = d.ticker AND b.date <= d.due WHERE d.due <= (SELECT max(date) - 5 FROM {STOPPED})""", d="ret", i="days_held")
def _(spark, sf):
    rows = ev.crossings(_scored(spark, sf), F.col("composite_score") >= 0.60).select("ticker", "date", "close", F.col("crossed").alias("opened"))
    rows = rows.where(~((F.col("ticker").cast("bigint") % 10 == 3) & (F.col("date") > "1998-01-01")))
    return runner.run_to_files(_halves(rows, overlap=20), state.position_lifecycle, "life")


@query("str_03_thinned_crossings", "SELECT c.ticker, c.date, c.pos FROM crossed c JOIN kept k USING (ticker, pos)", i="pos")
def _(spark, sf):
    rows = _scored(spark, sf).select("ticker", "date", holds(F.col("composite_score") >= 0.60).alias("in_buy"))
    return runner.run_to_files(_halves(rows, overlap=20), lambda s: state.thinned_crossings(s, 63), "kept")


@query("str_04_first_deliveries", "SELECT ticker, filing_date AS date, accession FROM filings")
def _(spark, sf):
    rows = star.filings(spark, sf).select("ticker", F.col("filing_date").alias("date"), "accession")
    first, second = _halves(rows, overlap=30)
    return runner.run_to_files([first.unionByName(first), second], lambda s: state.first_deliveries(s, ["accession"], delay="60 days"), "unique")


#: The second delivery fetches the last 90 days again at changed prices; 60 days before the first one's end, days are final.
FIRST_END = f"(SELECT max(date) FROM bars WHERE date <= DATE '{CUT}')"


@query("str_04_latest_deliveries", f"""
SELECT ticker, date, CASE WHEN date > {FIRST_END} - 60 THEN close * CAST(1.5 AS DOUBLE) ELSE close END AS close, CASE WHEN date > {FIRST_END} - 60 THEN 2 ELSE 1 END AS fetched FROM bars""",
       d="close", i="fetched")
def _(spark, sf):
    bars = star.bars(spark, sf).select("ticker", "date", "close", F.trunc("date", "month").alias("month"))
    first, second = _halves(bars, overlap=90)
    first, second = first.withColumn("fetched", F.lit(1).cast("long")), second.withColumn("fetched", F.lit(2).cast("long")).withColumn("close", F.col("close") * 1.5)
    path = scratch_path(spark, "latest")
    runner.run_to_table([first, second, second, first], lambda s: state.latest_deliveries(s, "60 days"), path, "latest", ["ticker", "date"], "month")
    return spark.read.schema(first.schema).parquet(path).select("ticker", "date", "close", "fetched")


@query("str_05_daily_sink", "SELECT CAST(date_trunc('month', date) AS DATE) AS as_of, count(*) AS n, sum(composite_score) AS total FROM scored WHERE composite_score IS NOT NULL GROUP BY 1", d="total", i="n")
def _(spark, sf):
    rows = _scored(spark, sf).where(F.col("composite_score").isNotNull()).select("ticker", "date", "composite_score", F.trunc("date", "month").alias("as_of"))
    path = scratch_path(spark, "daily")
    cut = F.lit("1999-06-01").cast("date")
    first, second = rows.where(F.col("as_of") <= cut), rows.where(F.col("as_of") >= cut)
    runner.run_daily_sink([first, second, second], path, "daily")
    return spark.read.parquet(path).groupBy("as_of").agg(F.count(F.lit(1)).alias("n"), F.sum("composite_score").alias("total"))
