"""Daily jobs, positions, scalar functions, orderings and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards, scalars as fn, tiers
from ..operators import events as ev, indicators as ind, universe as uni, veto
from ..operators.fundamentals import snapshots_asof
from ..operators.windows import has_history
from ..plans import alerts, event_study as es, positions as pos, screener
from ..session import clustered, scratch_path
from ..sources import bars as src_bars, star
from .base import query
from .inputs import LABEL
from .ctes import W, asof as asof_sql, busday, caps, gate

AS_OF = "2000-12-29"


def _day(s):
    return F.lit(s).cast("date")


REQ = f"(SELECT DISTINCT ticker, DATE '{AS_OF}' AS as_of FROM members WHERE date = (SELECT max(date) FROM members WHERE date <= DATE '{AS_OF}'))"
SCREEN = f"""
SELECT u.as_of, l.ticker, l.close AS current_price, coalesce(l.high_52w, l.close) AS high_52w, coalesce(l.drawdown_52w, 0) AS drawdown_pct, l.dip_score, l.momentum_score, l.volume_score, l.composite_score, g.gate,
 CASE WHEN l.composite_score IS NULL THEN 'INSUFFICIENT_DATA' WHEN NOT coalesce(g.gate, FALSE) THEN 'SKIP' WHEN l.composite_score >= CAST(0.6 AS DOUBLE) THEN CASE WHEN v.ticker IS NOT NULL OR coalesce(r.concern, FALSE) THEN 'VETO' ELSE 'BUY' END ELSE 'WATCH' END AS signal,
 CASE WHEN l.composite_score >= CAST(0.6 AS DOUBLE) AND g.gate AND v.ticker IS NOT NULL THEN '8-K Item ' || v.item || ' filed ' || strftime(v.filing_date, '%Y-%m-%d') || ': ' || {LABEL.replace('item', 'v.item')}
      WHEN l.composite_score >= CAST(0.6 AS DOUBLE) AND g.gate AND r.concern THEN r.form || ' filed ' || strftime(r.filing_date, '%Y-%m-%d') || ': going-concern doubt (substantial doubt / going concern)' END AS veto_reason
FROM (SELECT * FROM ({caps(REQ)}) WHERE mcap > 0 QUALIFY row_number() OVER (ORDER BY mcap DESC, ticker) <= 60) u
JOIN (SELECT * FROM scored_all WHERE date < DATE '{AS_OF}' AND pos >= 252 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1) l ON l.ticker = u.ticker
LEFT JOIN (SELECT ticker, {gate()} AS gate FROM ({asof_sql(REQ)})) g ON g.ticker = u.ticker
LEFT JOIN (SELECT ticker, filing_date, item FROM distress WHERE filing_date BETWEEN DATE '{AS_OF}' - 90 AND DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, accession) = 1) v ON v.ticker = u.ticker
LEFT JOIN (SELECT q.*, contains(lower(d.text), 'the') AND contains(lower(d.text), 'and') AS concern FROM (SELECT * FROM filings WHERE form IN ('10-K', '10-Q') AND filing_date <= DATE '{AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, accession) = 1) q LEFT JOIN documents d ON d.doc_id = q.doc_id) r ON r.ticker = u.ticker"""
SCREEN_D = "current_price high_52w drawdown_pct dip_score momentum_score volume_score composite_score"


def _screen(spark, sf):
    b = star.bars(spark, sf)
    flags = veto.flag_documents(star.table(spark, sf, "documents"), ("the", "and"))
    return screener.screen(b, star.facts(spark, sf), star.filings(spark, sf), star.membership(spark, sf), _day(AS_OF), n=60, flags=flags)


@query("job_01_daily_screen", SCREEN, d=SCREEN_D)
def _(spark, sf):
    return _screen(spark, sf)


@query("job_02_ranking", f"SELECT ticker, composite_score, signal FROM ({SCREEN}) ORDER BY composite_score DESC NULLS LAST, ticker", d="composite_score")
def _(spark, sf):
    return screener.ranking(_screen(spark, sf)).select("ticker", "composite_score", "signal")


@query("job_03_signal_partition", f"SELECT signal, count(*) AS n FROM ({SCREEN}) WHERE signal IN ('BUY', 'VETO') GROUP BY 1", i="n")
def _(spark, sf):
    buys, vetoed = screener.split_signals(_screen(spark, sf))
    return buys.unionByName(vetoed).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


STATE = "SELECT ticker, date, 'BUY' AS signal FROM scored WHERE composite_score >= CAST(0.6 AS DOUBLE)"


def _scored(spark, sf):
    return ind.recovery_scores(has_history(star.bars(spark, sf), 252)).select("ticker", "date", "close", "composite_score")


def _history(rows):
    gate = F.lit(True)
    return rows.select("ticker", F.trunc("date", "month").alias("as_of"), "date", tiers.recovery_signal(F.col("composite_score"), gate).alias("signal"))


@query("job_04_signal_changes", """
WITH s AS (SELECT DISTINCT ticker, CAST(date_trunc('month', date) AS DATE) AS as_of FROM scored WHERE composite_score >= CAST(0.6 AS DOUBLE)), d AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS as_of FROM scored),
n AS (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS nxt FROM d), p AS (SELECT s.ticker, n.nxt AS as_of FROM s JOIN n USING (as_of) WHERE n.nxt IS NOT NULL)
SELECT coalesce(s.ticker, p.ticker) AS ticker, coalesce(s.as_of, p.as_of) AS as_of, CASE WHEN p.ticker IS NULL THEN 'NEW' WHEN s.ticker IS NULL THEN 'DROPPED' ELSE 'CONTINUING' END AS status FROM s FULL JOIN p ON p.ticker = s.ticker AND p.as_of = s.as_of""")
def _(spark, sf):
    return alerts.latest_two_days(_history(clustered(_scored(spark, sf))))


DAILY_DIFF = """
WITH s AS (SELECT DISTINCT ticker, date FROM scored WHERE composite_score >= CAST(0.6 AS DOUBLE)), d AS (SELECT DISTINCT date FROM scored),
n AS (SELECT date, date - CASE isodow(date) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS before FROM d),
p AS (SELECT s.ticker, n.date FROM n JOIN s ON s.date = n.before)
SELECT coalesce(s.ticker, p.ticker) AS ticker, coalesce(s.date, p.date) AS date, CASE WHEN p.ticker IS NULL THEN 'NEW' WHEN s.ticker IS NULL THEN 'DROPPED' ELSE 'CONTINUING' END AS status FROM s FULL JOIN p ON p.ticker = s.ticker AND p.date = s.date"""


@query("job_04_two_day_diff", DAILY_DIFF)
def _(spark, sf):
    return alerts.weekday_changes(_history(clustered(_scored(spark, sf))))


def _holdings(spark, sf):
    """The latest crossing of every ticker before the as-of date, some without an entry price or limits."""
    c = es.score_crossings(star.bars(spark, sf)).where(F.col("date") < AS_OF)
    h = c.groupBy("ticker").agg(F.max_by(F.struct("date", "close", "composite_score", "drawdown_52w"), "date").alias("e"))
    key = F.col("ticker").cast("bigint")
    return h.select("ticker", F.col("e.date").alias("entry_date"), F.when(key % 10 != 0, F.col("e.close")).alias("entry_price"),
                    F.when(key % 3 == 0, 15.0).alias("alert_up_pct"), F.when(key % 4 == 0, 5.0).alias("alert_down_pct"), F.lit(False).alias("reminder_sent"))


HOLD = f"""(SELECT ticker, date AS entry_date, CASE WHEN CAST(ticker AS BIGINT) % 10 <> 0 THEN close END AS entry_price, CASE WHEN CAST(ticker AS BIGINT) % 3 = 0 THEN 15 END AS alert_up_pct,
 CASE WHEN CAST(ticker AS BIGINT) % 4 = 0 THEN 5 END AS alert_down_pct FROM crossed WHERE date < DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)"""
PRICED = f"""(SELECT h.*, CASE WHEN s.ticker IS NOT NULL THEN s.current_price WHEN date_diff('day', b.date, DATE '{AS_OF}') <= 10 THEN b.close END AS current_price, s.signal FROM (SELECT *, DATE '{AS_OF}' AS q FROM {HOLD}) h
 ASOF LEFT JOIN bars b ON b.ticker = h.ticker AND b.date < h.q LEFT JOIN ({SCREEN}) s ON s.ticker = h.ticker)"""


@query("job_05_portfolio_alerts", f"""
WITH p AS (SELECT *, (current_price / entry_price - 1) * 100 AS return_pct FROM {PRICED} WHERE entry_price IS NOT NULL AND current_price IS NOT NULL)
SELECT ticker, return_pct, CASE WHEN return_pct >= coalesce(alert_up_pct, 20) THEN 'PRICE_TARGET_UP' ELSE 'PRICE_TARGET_DOWN' END AS alert_type FROM p WHERE return_pct >= coalesce(alert_up_pct, 20) OR return_pct <= -coalesce(alert_down_pct, 10)
UNION ALL SELECT ticker, return_pct, 'SIGNAL_ON_HELD_TICKER' FROM p WHERE signal = 'BUY'""", d="return_pct")
def _(spark, sf):
    return alerts.portfolio_alerts(_holdings(spark, sf), _screen(spark, sf), star.bars(spark, sf), _day(AS_OF)).select("ticker", "return_pct", "alert_type")


@query("joi_13_price_fallback", f"SELECT ticker, current_price FROM {PRICED}", d="current_price")
def _(spark, sf):
    return alerts.current_prices(_holdings(spark, sf), _screen(spark, sf), star.bars(spark, sf), _day(AS_OF)).select("ticker", "current_price")


@query("job_06_position_open", "SELECT ticker, date AS entry_date FROM crossed WHERE date >= DATE '2000-01-01'")
def _(spark, sf):
    rows = es.score_crossings(star.bars(spark, sf)).select("ticker", F.col("date").alias("entry_date"))
    known = rows.where(F.col("entry_date") < "2000-01-01")
    return pos.open_positions(known, rows.unionByName(rows))


POS = "(SELECT c.ticker, c.date AS entry_date, c.close AS entry_price, b.close AS current_price FROM (SELECT *, DATE '{0}' AS q FROM crossed WHERE date < DATE '{0}') c ASOF LEFT JOIN bars b ON b.ticker = c.ticker AND b.date <= c.q)".format(AS_OF)


def _positions(spark, sf, scored=None):
    """Every crossing before the as-of date at the last price. `scored` may give the scored bars, which hold all bars of a ticker that crosses."""
    b = star.bars(spark, sf) if scored is None else scored
    c = es.score_crossings(b) if scored is None else ev.crossings(scored, F.col("composite_score") >= tiers.RECOVERY_BUY).where("crossed")
    p = c.where(F.col("date") < AS_OF).select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_price"), (F.col("ticker").cast("bigint") % 5 == 0).alias("reminder_sent"))
    return pos.priced(p, b, _day(AS_OF))


HELD = busday("entry_date", f"DATE '{AS_OF}'")


@query("job_07_exit_check", f"""
SELECT ticker, entry_date, {HELD} AS days_held, CASE WHEN {HELD} >= 252 THEN 'EXIT' WHEN {HELD} >= 222 AND CAST(ticker AS BIGINT) % 5 <> 0 THEN 'REMINDER' END AS alert, current_price / entry_price - 1 AS ret FROM {POS}""", d="ret", i="days_held")
def _(spark, sf):
    return pos.exit_check(_positions(spark, sf), _day(AS_OF)).select("ticker", "entry_date", "days_held", "alert", "ret")


@query("job_07_after_check", f"""
SELECT CASE WHEN {HELD} >= 252 THEN 'closed' ELSE 'open' END AS state, CASE WHEN {HELD} < 252 THEN CAST(ticker AS BIGINT) % 5 = 0 OR {HELD} >= 222 END AS reminder_sent, count(*) AS n FROM {POS} GROUP BY 1, 2""", i="n")
def _(spark, sf):
    still, closed = pos.after_check(pos.exit_check(_positions(spark, sf), _day(AS_OF)), _day(AS_OF))
    rows = still.select(F.lit("open").alias("state"), "reminder_sent").unionByName(
        closed.select(F.lit("closed").alias("state"), F.lit(None).cast("boolean").alias("reminder_sent")))
    return rows.groupBy("state", "reminder_sent").agg(F.count(F.lit(1)).alias("n"))


EXPECT = f"""CAST(CASE WHEN {{0}} BETWEEN 0 AND 21 THEN 0 + {{0}} / CAST(21 AS DOUBLE) * CAST(0.02 AS DOUBLE) WHEN {{0}} BETWEEN 21 AND 63 THEN CAST(0.02 AS DOUBLE) + ({{0}} - 21) / CAST(42 AS DOUBLE) * CAST(0.044 AS DOUBLE)
 WHEN {{0}} BETWEEN 63 AND 252 THEN CAST(0.064 AS DOUBLE) + ({{0}} - 63) / CAST(189 AS DOUBLE) * CAST(0.428 AS DOUBLE) ELSE 0.492 END AS DOUBLE)"""
STEP = "CASE WHEN {0} <= CAST(-0.45 AS DOUBLE) THEN 5 WHEN {0} <= CAST(-0.25 AS DOUBLE) THEN 15 WHEN {0} <= CAST(-0.15 AS DOUBLE) THEN 25 WHEN {0} <= CAST(-0.10 AS DOUBLE) THEN 35 WHEN {0} <= 0 THEN 45 WHEN {0} <= CAST(0.2 AS DOUBLE) THEN 60 WHEN {0} <= CAST(0.4 AS DOUBLE) THEN 75 WHEN {0} <= CAST(0.7 AS DOUBLE) THEN 90 ELSE 99 END"
ZONE = "CASE WHEN {0} < CAST(-0.2 AS DOUBLE) THEN 'deep_loss' WHEN {0} < 0 THEN 'loss' WHEN {0} < CAST(0.2 AS DOUBLE) THEN 'gain' WHEN {0} >= CAST(0.2 AS DOUBLE) THEN 'strong_gain' END"


@query("job_08_position_status", f"""
SELECT ticker, entry_date, h AS days_held, greatest(0, 252 - h) AS days_remaining, r AS current_return, {EXPECT.format('h')} AS expected_return, {STEP.format('r')} AS percentile, {ZONE.format('r')} AS zone
FROM (SELECT *, {HELD} AS h, current_price / entry_price - 1 AS r FROM {POS})""", d="current_return expected_return", i="days_held days_remaining percentile")
def _(spark, sf):
    return pos.position_status(_positions(spark, sf), _day(AS_OF)).select("ticker", "entry_date", "days_held", "days_remaining", "current_return", "expected_return", "percentile", "zone")


@query("job_09_manual_close", f"""
SELECT ticker, entry_date, current_price AS exit_price, current_price / entry_price - 1 AS realized_return, {HELD} AS days_held FROM {POS} WHERE ticker IN (SELECT ticker FROM distress WHERE filing_date >= DATE '2000-12-01')""", d="exit_price realized_return", i="days_held")
def _(spark, sf):
    from ..operators.veto import distress_events
    closing = distress_events(star.filings(spark, sf)).where(F.col("filing_date") >= "2000-12-01")
    return pos.manual_close(_positions(spark, sf), closing, _day(AS_OF)).select("ticker", "entry_date", "exit_price", "realized_return", "days_held")


@query("job_10_valuation", f"""
SELECT h.ticker, coalesce(h.entry_price, b.close) AS entry_price, b.close / coalesce(h.entry_price, b.close) - 1 AS current_return, coalesce(h.alert_up_pct, 20) AS alert_up_pct FROM (SELECT *, DATE '{AS_OF}' AS q FROM {HOLD}) h
ASOF LEFT JOIN bars b ON b.ticker = h.ticker AND b.date <= h.q""", d="entry_price current_return alert_up_pct")
def _(spark, sf):
    return pos.valuation(pos.priced(_holdings(spark, sf), star.bars(spark, sf), _day(AS_OF))).select("ticker", "entry_price", "current_return", "alert_up_pct")


@query("job_11_run_summary", f"""
WITH s AS ({SCREEN}), x AS (SELECT {HELD} AS h, ticker FROM {POS}), c AS (SELECT * FROM ({DAILY_DIFF}) WHERE date = DATE '{AS_OF}') SELECT (SELECT count(*) FROM s) AS scanned, (SELECT count(*) FROM s WHERE signal = 'BUY') AS buys, (SELECT count(*) FROM s WHERE signal = 'VETO') AS vetoed,
 (SELECT count(*) FROM x WHERE h >= 252) AS exits, (SELECT count(*) FROM x WHERE h >= 222 AND h < 252 AND CAST(ticker AS BIGINT) % 5 <> 0) AS reminders, (SELECT count(*) FROM x) AS positions, (SELECT count(*) FROM c WHERE status = 'NEW') AS new, (SELECT count(*) FROM c WHERE status = 'CONTINUING') AS continuing, (SELECT count(*) FROM c WHERE status = 'DROPPED') AS dropped""",
       i="scanned buys vetoed exits reminders positions new continuing dropped")
def _(spark, sf):
    scored = clustered(_scored(spark, sf))     # changes and positions read the same scores
    changes = alerts.weekday_changes(_history(scored)).where(F.col("date") == _day(AS_OF)).withColumnRenamed("date", "as_of")
    checked = pos.exit_check(_positions(spark, sf, scored), _day(AS_OF)).withColumn("as_of", _day(AS_OF))
    return pos.observed_run(scratch_path(spark, "run"), _screen(spark, sf), changes, checked)


# ---------------------------------------------------------------- orderings, set operations


@query("srt_01_total_order", "SELECT ticker, date, composite_score FROM crossed ORDER BY date, ticker", d="composite_score")
def _(spark, sf):
    return es.score_crossings(star.bars(spark, sf)).select("ticker", "date", "composite_score").orderBy("date", "ticker")


@query("srt_02_top_k", "SELECT ticker, date, volume FROM bars ORDER BY volume DESC, ticker, date LIMIT 50", d="volume")
def _(spark, sf):
    return star.bars(spark, sf).select("ticker", "date", "volume").orderBy(F.desc("volume"), "ticker", "date").limit(50)


@query("srt_03_arg_max", "SELECT ticker, arg_max(date, (close, date)) AS best_day, arg_min(date, (close, date)) AS worst_day FROM bars GROUP BY 1")
def _(spark, sf):
    k = F.struct("close", "date")
    return star.bars(spark, sf).groupBy("ticker").agg(F.max_by("date", k).alias("best_day"), F.min_by("date", k).alias("worst_day"))


@query("set_01_union", "SELECT ticker FROM members WHERE date < DATE '1998-01-01' UNION SELECT ticker FROM members WHERE date >= DATE '1998-01-01'")
def _(spark, sf):
    m = star.membership(spark, sf)
    return m.where(F.col("date") < "1998-01-01").select("ticker").union(m.where(F.col("date") >= "1998-01-01").select("ticker")).distinct()


def _half_buys(spark, sf):
    """Tickers with a buy signal after, and up to, the middle of the history."""
    h = _history(clustered(_scored(spark, sf))).where(F.col("signal") == "BUY")
    return h.where(F.col("date") >= "1999-01-01").select("ticker"), h.where(F.col("date") < "1999-01-01").select("ticker")


_BUYS = "SELECT ticker FROM scored WHERE composite_score >= CAST(0.6 AS DOUBLE) AND date {0} DATE '1999-01-01'"


@query("set_02_difference", f"{_BUYS.format('>=')} EXCEPT {_BUYS.format('<')}")
def _(spark, sf):
    now, before = _half_buys(spark, sf)
    return now.subtract(before)


@query("set_02_intersection", f"{_BUYS.format('>=')} INTERSECT {_BUYS.format('<')}")
def _(spark, sf):
    now, before = _half_buys(spark, sf)
    return now.intersect(before)


# ---------------------------------------------------------------- scalar functions


@query("fn_01_market_symbol", "SELECT s_suppkey, replace(upper(trim(' sup.' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '' END)), '.', '-') || '.US' AS symbol FROM supplier")
def _(spark, sf):
    s = star.table(spark, sf, "supplier")
    text = F.concat(F.lit(" sup."), "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, ".us").otherwise(""))
    return s.select("s_suppkey", fn.market_symbol(text).alias("symbol"))


@query("fn_02_safe_identifier", "SELECT p_partkey, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9_-]', '', 'g') AS name FROM part")
def _(spark, sf):
    return star.table(spark, sf, "part").select("p_partkey", fn.safe_identifier(F.concat("p_name", F.lit("/"), "p_brand")).alias("name"))


@query("fn_03_safe_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice WHEN o_orderkey % 4 = 1 THEN NULL WHEN o_orderkey % 4 = 2 THEN NULL END AS value FROM orders", d="value")
def _(spark, sf):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.col("o_totalprice").cast("string")).when(k == 1, "NaN").when(k == 2, "None")
    return star.table(spark, sf, "orders").select("o_orderkey", guards.number(text).alias("value"))


@query("fn_04_split_list", "SELECT o_orderkey, array_to_string(list_filter(list_transform(string_split(o_orderpriority || ' , ,' || o_orderstatus, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM orders")
def _(spark, sf):
    o = star.table(spark, sf, "orders")
    return o.select("o_orderkey", F.array_join(fn.split_list(F.concat("o_orderpriority", F.lit(" , ,"), "o_orderstatus")), "|").alias("parts"))


@query("fn_05_business_days", f"""
SELECT o_orderkey, CAST((SELECT 0) AS BIGINT) + {busday('CAST(o_orderdate AS DATE)', "DATE '1999-03-14'")} AS days FROM orders""", i="days")
def _(spark, sf):
    return star.table(spark, sf, "orders").select("o_orderkey", fn.business_days(F.col("o_orderdate").cast("date"), _day("1999-03-14")).alias("days"))


@query("fn_06_previous_weekday", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) - CASE dayofweek(o_orderdate) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS previous FROM orders")
def _(spark, sf):
    d = star.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return d.select("day", fn.previous_weekday(F.col("day")).alias("previous"))


@query("fn_07_expected_return", f"SELECT d, {EXPECT.format('d')} AS value FROM (SELECT DISTINCT o_orderkey % 400 AS d FROM orders)", d="value")
def _(spark, sf):
    d = star.table(spark, sf, "orders").select((F.col("o_orderkey") % 400).alias("d")).distinct()
    return d.select("d", fn.expected_return(F.col("d")).alias("value"))


RET5 = "(SELECT ticker, date, ret_5 AS r FROM ind WHERE ret_5 IS NOT NULL)"


@query("fn_08_percentile_step", f"SELECT ticker, date, {STEP.format('r')} AS pct FROM {RET5}", i="pct")
def _(spark, sf):
    df = ind.bar_return(star.bars(spark, sf), 5).where(F.col("ret_5").isNotNull())
    return df.select("ticker", "date", fn.percentile_step(F.col("ret_5")).alias("pct"))


@query("fn_09_return_zone", f"SELECT {ZONE.format('r')} AS zone, count(*) AS n FROM {RET5} GROUP BY 1", i="n")
def _(spark, sf):
    df = ind.bar_return(star.bars(spark, sf), 5).where(F.col("ret_5").isNotNull())
    return df.groupBy(fn.return_zone(F.col("ret_5")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_10_date_keys", """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, year(o_orderdate) AS year, CAST(o_orderdate AS DATE) + 30 AS later, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR AS DATE) AS next_year FROM orders""", i="year")
def _(spark, sf):
    d = star.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    c = F.col("day")
    return d.select("day", fn.month_key(c).alias("month"), F.year(c).alias("year"), F.date_add(c, 30).alias("later"), F.add_months(c, 12).alias("next_year"))


@query("fn_11_as_fraction", "SELECT l_orderkey, l_linenumber, CASE WHEN q > 1 THEN q / CAST(100 AS DOUBLE) ELSE q END AS fraction FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_discount END AS q FROM lineitem)", d="fraction")
def _(spark, sf):
    li = star.table(spark, sf, "lineitem")
    q = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(F.col("l_discount"))
    return li.select("l_orderkey", "l_linenumber", fn.as_fraction(q).alias("fraction"))


@query("fn_12_rounding", "SELECT o_orderkey, round(o_totalprice / 7, 2) AS value FROM orders", d="value")
def _(spark, sf):
    return star.table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 7, 2).alias("value"))


@query("fn_13_distress_reason", """
SELECT accession, '8-K Item ' || item || ' filed ' || strftime(filing_date, '%Y-%m-%d') || ': ' || CASE item WHEN '1.03' THEN 'Bankruptcy or Receivership' ELSE 'Non-Reliance on Previously Issued Financial Statements (restatement)' END AS reason FROM distress""")
def _(spark, sf):
    from ..operators.veto import distress_events, distress_reason
    return distress_events(star.filings(spark, sf)).select("accession", distress_reason(F.col("item"), F.col("filing_date")).alias("reason"))


@query("fn_14_cagr", """
SELECT ticker, pow(arg_max(close, date) / arg_min(close, date), 1 / greatest(date_diff('day', min(date), max(date)) / CAST(365.25 AS DOUBLE), 1)) - 1 AS cagr FROM bars GROUP BY 1""", d="cagr")
def _(spark, sf):
    g = star.bars(spark, sf).groupBy("ticker").agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("r"), F.datediff(F.max("date"), F.min("date")).alias("d"))
    return g.select("ticker", fn.cagr(F.col("r"), F.col("d")).alias("cagr"))


@query("fn_15_trading_days", "SELECT DISTINCT filing_date AS date FROM filings WHERE dayofweek(filing_date) BETWEEN 1 AND 5 AND filing_date IN (SELECT date FROM bench)")
def _(spark, sf):
    days = star.filings(spark, sf).select(F.col("filing_date").alias("date")).distinct()
    return src_bars.on_trading_days(days, src_bars.calendar_of(star.benchmark(star.bars(spark, sf))))
