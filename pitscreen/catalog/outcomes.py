"""Event-study outcomes and exit rules."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev, exits, indicators as ind, universe as uni
from ..operators.windows import bar_index, has_history
from ..plans import event_study as es
from ..sources import star
from .base import query
from .ctes import SAMPLED, W, asof, busday, gate

KEEP = ["ticker", "date"]


@query("evt_01_forward_return", f"""
SELECT ticker, date, {', '.join(f'lead(close, {h}) OVER ({W}) / nullif(close, 0) - 1 AS fwd_{h}' for h in (21, 63, 126, 252))} FROM bars""", d="fwd_21 fwd_63 fwd_126 fwd_252")
def _(spark, sf):
    return ev.forward_returns(star.bars(spark, sf)).select(*KEEP, *[f"fwd_{h}" for h in ev.HORIZONS])


@query("evt_02_window_return", """
SELECT m.ticker, m.as_of, CASE WHEN count(b.date) >= 2 THEN (arg_max(b.close, b.date) - arg_min(b.close, b.date)) / arg_min(b.close, b.date) END AS ret
FROM month_universe m LEFT JOIN bars b ON b.ticker = m.ticker AND b.date >= m.as_of - 182 AND b.date < m.as_of - 2 GROUP BY 1, 2""", d="ret")
def _(spark, sf):
    b = star.bars(spark, sf)
    req = uni.monthly_universe(star.membership(spark, sf), star.benchmark(b)).select("ticker", "as_of")
    return ev.window_return(req, b, F.date_sub("as_of", 182), F.date_sub("as_of", 2), "ret")


@query("evt_03_next_open", f"SELECT ticker, date, lead(open) OVER ({W}) AS fill_price, lead(date) OVER ({W}) AS fill_date FROM bars", d="fill_price")
def _(spark, sf):
    return ev.next_open(star.bars(spark, sf)).select(*KEEP, "fill_price", "fill_date")


TRADE = ["entry_date", "entry_price", "exit_date", "exit_price", "status", "bars_held", "trade_return"]


@query("evt_04_fixed_hold", f"SELECT ticker, date, {', '.join(TRADE)} FROM trades", d="entry_price exit_price trade_return", i="bars_held")
def _(spark, sf):
    return ev.fixed_hold_trades(has_history(star.bars(spark, sf), 252), 63).select(*KEEP, *TRADE).withColumn(
        "bars_held", F.col("bars_held"))


@query("evt_05_adverse_excursion", f"""
SELECT ticker, date, min(close) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 252 FOLLOWING) / close - 1 AS mae,
       CASE WHEN count(*) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 252 FOLLOWING) = 252 THEN min(close) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 252 FOLLOWING) / close - 1 END AS mae_full FROM bars""", d="mae mae_full")
def _(spark, sf):
    df = ev.adverse_excursion(star.bars(spark, sf))
    return ev.adverse_excursion(df, require_full=True, name="mae_full").select(*KEEP, "mae", "mae_full")


@query("evt_06_touch_flags", """
SELECT ticker, date, coalesce(mae <= CAST(-0.10 AS DOUBLE), FALSE) AS touched_10, coalesce(mae <= CAST(-0.15 AS DOUBLE), FALSE) AS touched_15, coalesce(mae <= CAST(-0.20 AS DOUBLE), FALSE) AS touched_20 FROM outcomes""")
def _(spark, sf):
    df = ev.touch_flags(ev.adverse_excursion(has_history(star.bars(spark, sf), 252), 63))
    return df.select(*KEEP, "touched_10", "touched_15", "touched_20")


@query("evt_07_forward_drawdown", "SELECT i.ticker, i.date, f.max_dd FROM ind i LEFT JOIN fdd f USING (ticker, pos)", d="max_dd")
def _(spark, sf):
    return ev.forward_drawdown(star.bars(spark, sf), 63).select(*KEEP, "max_dd")


def _entries(spark, sf):
    return es.score_crossings(star.bars(spark, sf)).select("ticker", "date", "pos")


def _arrays(spark, sf):
    return es.crossing_paths(star.bars(spark, sf))


def _paths(spark, sf):
    return exits.long_paths(_arrays(spark, sf))


@query("evt_08_barrier_capture", """
SELECT ticker, entry_date, coalesce(min(CASE WHEN day <= 126 AND close >= entry_price * CAST(1.1 AS DOUBLE) THEN day END) < coalesce(min(CASE WHEN day <= 126 AND close <= entry_price * CAST(0.9 AS DOUBLE) THEN day END), 9999), FALSE) AS captured
FROM paths GROUP BY 1, 2""")
def _(spark, sf):
    return exits.barrier_capture(_paths(spark, sf))


@query("evt_09_atr_trailing_stop", """
SELECT ticker, entry_date, coalesce(arg_min(ratio, day) FILTER (WHERE close < stop), arg_max(ratio, day)) - 1 AS atr_ret,
       coalesce(min(day) FILTER (WHERE close < stop), max(day)) AS atr_hold, count(*) FILTER (WHERE close < stop) > 0 AS stopped
FROM (SELECT *, coalesce(last_value(lvl IGNORE NULLS) OVER (PARTITION BY ticker, entry_date ORDER BY day), entry_price - 3 * entry_atr) AS stop FROM (
  SELECT *, CASE WHEN close > greatest(entry_price, coalesce(max(close) OVER (PARTITION BY ticker, entry_date ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), entry_price))
                 AND atr IS NOT NULL THEN close - 3 * atr END AS lvl FROM paths)) GROUP BY 1, 2""", d="atr_ret", i="atr_hold")
def _(spark, sf):
    return exits.atr_trailing_exit(_paths(spark, sf))


@query("evt_10_forward_path", "SELECT ticker, entry_date, day, date, ratio FROM paths", d="ratio", i="day")
def _(spark, sf):
    return _paths(spark, sf).select("ticker", "entry_date", "day", "date", "ratio")


@query("evt_11_running_extremes", "SELECT ticker, entry_date, day, run_min, run_max FROM paths", d="run_min run_max", i="day")
def _(spark, sf):
    return exits.array_extremes(_arrays(spark, sf))


@query("evt_12_local_minimum", f"""
SELECT ticker, date, close <= quantile_cont(close, CAST(0.15 AS DOUBLE)) OVER ({W} ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS near_min FROM bars""")
def _(spark, sf):
    return ev.near_local_low(star.bars(spark, sf)).select(*KEEP, "near_min")


CASES = "(SELECT ticker, arg_min(date, (close, date)) AS as_of FROM bars GROUP BY 1)"
CASE_WINDOWS = f"""
SELECT *, date_diff('day', case_date, first_buy) AS offset_days, CASE WHEN case_score IS NULL THEN 'INSUFFICIENT_DATA' WHEN NOT coalesce(gate, FALSE) THEN 'SKIP' WHEN case_score >= CAST(0.6 AS DOUBLE) THEN 'BUY' ELSE 'WATCH' END AS case_signal FROM (
 SELECT c.ticker, c.as_of AS case_date, g.gate, max(s.composite_score) AS max_window_score, min(s.date) FILTER (WHERE coalesce(g.gate, FALSE) AND s.composite_score >= CAST(0.6 AS DOUBLE)) AS first_buy,
  arg_max_null(s.drawdown_52w, s.date) FILTER (WHERE s.date <= c.as_of) AS case_drawdown, arg_max_null(s.composite_score, s.date) FILTER (WHERE s.date <= c.as_of) AS case_score, arg_max_null(s.fwd_63, s.date) FILTER (WHERE s.date <= c.as_of) AS fwd_63
 FROM {CASES} c LEFT JOIN (SELECT ticker, {gate()} AS gate FROM ({asof(CASES)})) g ON g.ticker = c.ticker
 JOIN (SELECT *, lead(close, 63) OVER ({W}) / close - 1 AS fwd_63 FROM scored_all) s ON s.ticker = c.ticker AND abs(date_diff('day', c.as_of, s.date)) <= 20 GROUP BY 1, 2, 3)"""


def _cases(spark, sf):
    b = star.bars(spark, sf)
    lows = b.groupBy("ticker").agg(F.min_by("date", F.struct("close", "date")).alias("date"))
    cases = es.entry_gates(lows, star.facts(spark, sf)).withColumnRenamed("date", "case_date")
    return ev.case_windows(cases, ind.recovery_scores(b))


@query("evt_13_case_windows", CASE_WINDOWS, d="max_window_score case_drawdown case_score fwd_63", i="offset_days")
def _(spark, sf):
    return _cases(spark, sf)


@query("agg_02_case_criterion", f"SELECT count(*) AS cases, count(first_buy) AS with_buy, count(first_buy) >= 3 AS pass_cases FROM ({CASE_WINDOWS})", i="cases with_buy")
def _(spark, sf):
    return ev.cases_pass(_cases(spark, sf))


@query("evt_14_best_candidates", f"""
SELECT ticker, date, fwd_63, near_min FROM (SELECT * FROM (
  SELECT o.*, close <= quantile_cont(close, CAST(0.15 AS DOUBLE)) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS near_min FROM outcomes o)
  WHERE composite_score >= CAST(0.6 AS DOUBLE) AND dip_score = 1 AND gate AND fwd_63 > 0
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY near_min DESC, fwd_63 DESC, date) = 1) ORDER BY fwd_63 DESC, ticker LIMIT 20""", d="fwd_63")
def _(spark, sf):
    b = star.bars(spark, sf)
    rows = ev.near_local_low(ev.forward_returns(ind.recovery_scores(has_history(b, 252)), [63]))
    rows = es.with_yearly_gate(rows, es.yearly_gates(b, star.facts(spark, sf)))
    good = rows.where((F.col("composite_score") >= 0.60) & (F.col("dip_score") == 1) & F.col("gate") & (F.col("fwd_63") > 0))
    return ev.best_per_ticker(good).select(*KEEP, "fwd_63", "near_min")


@query("evt_15_crossings", "SELECT ticker, date, composite_score FROM gcrossed", d="composite_score")
def _(spark, sf):
    return es.buy_crossings(star.bars(spark, sf), star.facts(spark, sf)).select(*KEEP, "composite_score")


@query("evt_16_min_gap", "SELECT c.ticker, c.date FROM crossed c JOIN kept k USING (ticker, pos)")
def _(spark, sf):
    return ev.suppress_within(_entries(spark, sf), 63).select(*KEEP)


@query("evt_17_hash_sample", f"SELECT ticker, date FROM bars WHERE {SAMPLED}")
def _(spark, sf):
    return star.bars(spark, sf).where(ev.hash_sample(F.col("ticker"), F.col("date"))).select(*KEEP)


@query("evt_18_slope_regime", "SELECT date, regime FROM regimes")
def _(spark, sf):
    return ev.slope_regime(star.benchmark(star.bars(spark, sf))).select("date", "regime")


@query("evt_19_level_regime", "SELECT date, above_ma FROM regimes")
def _(spark, sf):
    return ev.level_regime(star.benchmark(star.bars(spark, sf))).select("date", "above_ma")


@query("evt_20_daily_top", "SELECT ticker, date, r AS day_rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(composite_score, 9) DESC, ticker) AS r FROM scored WHERE composite_score >= CAST(0.6 AS DOUBLE)) WHERE r <= 3", i="day_rank")
def _(spark, sf):
    rows = ind.recovery_scores(has_history(star.bars(spark, sf), 252)).where(F.col("composite_score") >= 0.60)
    return ev.daily_top(rows.withColumn("composite_score", F.round("composite_score", 9)), 3).select(*KEEP, "day_rank")


@query("evt_21_new_signals", """
SELECT s.date, count(*) FILTER (WHERE p.ticker IS NULL) AS new_signals, count(*) AS buys FROM (SELECT ticker, date FROM scored WHERE composite_score >= CAST(0.6 AS DOUBLE)) s
JOIN (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM bench) d USING (date)
LEFT JOIN (SELECT ticker, date FROM scored WHERE composite_score >= CAST(0.6 AS DOUBLE)) p ON p.ticker = s.ticker AND p.date = d.prev GROUP BY 1""", i="new_signals buys")
def _(spark, sf):
    b = star.bars(spark, sf)
    rows = ind.recovery_scores(has_history(b, 252))
    return ev.new_signal_counts(rows, star.benchmark(b), F.col("composite_score") >= 0.60)


@query("evt_22_cohort_index", f"""
SELECT date, mean_return, positions, sum(ln(1 + mean_return)) OVER (ORDER BY date) AS log_index FROM (
  SELECT b.date, avg(b.r) AS mean_return, count(*) AS positions FROM (SELECT *, close / lag(close) OVER ({W}) - 1 AS r FROM bars) b
  JOIN (SELECT t.ticker, t.date AS d0, t.exit63 AS d1 FROM (
     SELECT ticker, date, pos, coalesce(lead(date, 63) OVER ({W}), last_value(date) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS exit63 FROM scored) t JOIN crossed c USING (ticker, date)) p
    ON p.ticker = b.ticker AND b.date > p.d0 AND b.date <= p.d1 WHERE b.r IS NOT NULL GROUP BY 1)""", d="mean_return log_index", i="positions")
def _(spark, sf):
    b = star.bars(spark, sf)
    taken = es.crossing_trades(b, 63).select("ticker", F.col("same_close_entry_date").alias("entry_date"), F.col("same_close_exit_date").alias("exit_date"))
    index = ev.cohort_index(b, taken)
    return index.select("date", "mean_return", "positions", F.log("index").alias("log_index"))


# ---------------------------------------------------------------- exit rules

HIT = "min(day) FILTER (WHERE {0})"


def _variant(family, name, hits, end):
    """SQL for one rule: first-hit day per condition, then the earliest (ties to the first listed), else the end day."""
    days = ", ".join(f"{HIT.format(c)} AS h{j}" for j, (_, c) in enumerate(hits)) or "NULL AS h0"
    first = "least(" + ", ".join(f"coalesce(h{j}, 9999)" for j in range(max(1, len(hits)))) + ")"
    place = f"CASE WHEN {first} < 9999 THEN {first} ELSE {end} END"
    route = "CASE " + " ".join(f"WHEN h{j} = {first} THEN '{label}'" for j, (label, _) in enumerate(hits)) + " ELSE 'time' END" if hits else "'time'"
    return (f"SELECT '{family}' AS family, '{name}' AS variant, ticker, entry_date, {place} AS hold, {route} AS route FROM "
            f"(SELECT ticker, entry_date, {days} FROM paths GROUP BY 1, 2)")


def _grid_sql():
    r, x = "ratio", "CAST({:.2f} AS DOUBLE)"
    out = [_variant("F1", f"Hold {h}d", [], h) for h in exits.TIME_EXITS]
    out += [_variant("F2", f"Stop {s}%", [("stop", f"{r} <= {x.format(1 - s / 100)}")], 252) for s in exits.HARD_STOPS]
    out += [_variant("F3", f"Arm+{a}% Tr{b}%", [("trail", f"run_max >= {x.format(1 + a / 100)} AND {r} <= run_max * (1 - {x.format(b / 100)})")], 252)
            for a in exits.ARM_LEVELS for b in exits.TRAILS]
    out += [_variant("F4", f"H{h}d E{e}%", [("stop", f"day <= {h} AND {r} <= {x.format(1 - e / 100)}")], h)
            for h in exits.HYBRID_HORIZONS for e in exits.EMERGENCY]
    out += [_variant("F5", f"Tgt+{g}% E{e}%", [("target", f"{r} >= {x.format(1 + g / 100)}"), ("stop", f"{r} <= {x.format(1 - e / 100)}")], 252)
            for g in exits.TARGETS for e in exits.EMERGENCY]
    return " UNION ALL ".join(out)


OUT_SQL = f"""SELECT g.*, p.ratio - 1 AS ret, p.run_min AS worst, f.ratio - 1 AS final_ret, f.run_max AS final_max FROM ({_grid_sql()}) g
JOIN paths p ON p.ticker = g.ticker AND p.entry_date = g.entry_date AND p.day = g.hold JOIN paths f ON f.ticker = g.ticker AND f.entry_date = g.entry_date AND f.day = 252"""


def _family(name, fam):
    @query(name, f"SELECT ticker, entry_date, variant, ret, worst, hold, route FROM ({OUT_SQL}) WHERE family = '{fam}'", d="ret worst", i="hold")
    def _(spark, sf):
        out = exits.exit_outcomes(_arrays(spark, sf), families=[fam])
        return out.select("ticker", "entry_date", "variant", "ret", "worst", "hold", "route")


for _n, _f in (("ext_01_time", "F1"), ("ext_02_hard_stop", "F2"), ("ext_03_trailing", "F3"), ("ext_04_hybrid", "F4"), ("ext_05_target_stop", "F5")):
    _family(_n, _f)

METRIC_SQL = f"""SELECT family, variant, count(*) AS n, avg(ret) AS mean, stddev_pop(ret) AS std, avg(CAST(ret > 0 AS INT)) AS pct_pos, avg(CAST(worst <= CAST(0.8 AS DOUBLE) AS INT)) AS pct_hit20,
 avg(CAST(ret < 0 AS INT)) AS pct_exit_loss, avg(hold) AS avg_hold, quantile_cont(ret, CAST(0.1 AS DOUBLE)) AS p10, quantile_cont(ret, CAST(0.5 AS DOUBLE)) AS median, quantile_cont(ret, CAST(0.9 AS DOUBLE)) AS p90,
 avg(ret) - CAST(0.223 AS DOUBLE) AS spread, avg(ret) / CAST(0.344 AS DOUBLE) AS capture,
 avg(ret) / CAST(0.344 AS DOUBLE) * (1 - avg(CAST(worst <= CAST(0.8 AS DOUBLE) AS INT))) * (1 - avg(CAST(ret < 0 AS INT))) AS ux, avg(ret) - CAST(0.223 AS DOUBLE) >= CAST(0.08 AS DOUBLE) AS eligible
FROM ({OUT_SQL}) GROUP BY 1, 2"""
METRIC_D = "mean std pct_pos pct_hit20 pct_exit_loss avg_hold p10 median p90 spread capture ux"


@query("ext_06_variant_metrics", METRIC_SQL, d=METRIC_D, i="n")
def _(spark, sf):
    return exits.variant_metrics(exits.exit_outcomes(_arrays(spark, sf)))


@query("ext_07_route_means", f"""
SELECT family, variant, count(*) AS n, avg(ret) FILTER (WHERE route = 'stop') AS mean_stop, avg(ret) FILTER (WHERE route = 'target') AS mean_target, avg(ret) FILTER (WHERE route = 'time') AS mean_time,
 avg(ret) FILTER (WHERE route = 'trail') AS mean_trail, avg(ret) FILTER (WHERE family = 'F3' AND NOT armed) AS mean_never_armed,
 count(*) FILTER (WHERE family = 'F3' AND armed) / CAST(count(*) AS DOUBLE) AS pct_armed, count(*) FILTER (WHERE route = 'stop') / CAST(count(*) AS DOUBLE) AS pct_stopped,
 count(*) FILTER (WHERE route = 'stop' AND final_ret > 0) / nullif(CAST(count(*) FILTER (WHERE final_ret > 0) AS DOUBLE), 0) AS pct_winners_stopped
FROM (SELECT *, CASE WHEN family = 'F3' THEN final_max >= 1 + CAST(regexp_extract(variant, 'Arm.(\\d+)%', 1) AS INT) / CAST(100 AS DOUBLE) END AS armed FROM ({OUT_SQL})) GROUP BY 1, 2""",
       d="mean_stop mean_target mean_time mean_trail mean_never_armed pct_armed pct_stopped pct_winners_stopped", i="n")
def _(spark, sf):
    return exits.route_means(exits.exit_outcomes(_arrays(spark, sf)))


RANK_SQL = f"""WITH m AS ({METRIC_SQL.replace('CAST(0.223 AS DOUBLE)', 'CAST(-0.15 AS DOUBLE)')})
SELECT role, rank, family, variant, mean, ux, spread, pct_hit20 FROM (
 SELECT 'top_ux' AS role, row_number() OVER (ORDER BY round(ux, 9) DESC, variant) AS rank, * FROM m WHERE eligible
 UNION ALL SELECT 'best_of_family', row_number() OVER (PARTITION BY family ORDER BY round(ux, 9) DESC, variant), * FROM m WHERE eligible
 UNION ALL SELECT 'max_return', row_number() OVER (ORDER BY round(mean, 9) DESC, variant), * FROM m
 UNION ALL SELECT 'safest', row_number() OVER (ORDER BY round(pct_hit20, 9), variant), * FROM m WHERE eligible
 UNION ALL SELECT 'ineligible', row_number() OVER (ORDER BY round(spread, 9) DESC, variant), * FROM m WHERE NOT eligible)
WHERE (role = 'top_ux' AND rank <= 5) OR (role IN ('best_of_family', 'max_return', 'safest') AND rank = 1) OR role = 'ineligible'"""


@query("ext_08_ranking", RANK_SQL, d="mean ux spread pct_hit20", i="rank")
def _(spark, sf):
    metrics = exits.variant_metrics(exits.exit_outcomes(_arrays(spark, sf)), random_mean=-0.15)
    return exits.rank_variants(metrics)


#: Paths of up to 756 bars, not necessarily full: they reach beyond 504 weekdays also where bars fall on every calendar day.
FAR = """(SELECT e.ticker, e.date AS entry_date, b.pos - e.pos AS day, b.date, b.close / e.close AS ratio, b.composite_score,
  greatest(1, max(b.close / e.close) OVER (PARTITION BY e.ticker, e.date ORDER BY b.pos)) AS top
  FROM crossed e JOIN scored b ON b.ticker = e.ticker AND b.pos BETWEEN e.pos + 1 AND e.pos + 756)"""
HELD = busday("entry_date", "date")
MODES = {"price": f"""CASE WHEN ratio - 1 >= CAST(0.3 AS DOUBLE) THEN 'take_profit' WHEN ratio - 1 <= CAST(-0.4 AS DOUBLE) THEN 'stop_loss'
  WHEN ratio / top - 1 <= CAST(-0.5 AS DOUBLE) THEN 'trailing_stop' WHEN {HELD} >= 252 THEN '252d' END""",
         "threshold_or_252d": f"CASE WHEN {HELD} >= 252 THEN '252d' WHEN composite_score < CAST(0.35 AS DOUBLE) THEN 'threshold' END",
         "threshold_only": f"CASE WHEN {HELD} >= 504 THEN '504d_cap' WHEN composite_score < CAST(0.05 AS DOUBLE) THEN 'threshold' END"}
TRIG_SQL = " UNION ALL ".join(f"""SELECT ticker, entry_date, '{mode}' AS mode, coalesce(arg_min(reason, day) FILTER (WHERE reason IS NOT NULL), 'open') AS reason,
 coalesce(min(day) FILTER (WHERE reason IS NOT NULL), max(day)) AS day, coalesce(arg_min(ratio, day) FILTER (WHERE reason IS NOT NULL), arg_max(ratio, day)) - 1 AS ret
FROM (SELECT *, {rules} AS reason FROM {FAR}) GROUP BY 1, 2""" for mode, rules in MODES.items())


def _triggered(spark, sf):
    arrays = es.crossing_paths(star.bars(spark, sf), horizon=3 * ev.HOLD_BARS, full_only=False)
    # a low threshold, so that some trades reach the cap of the mode without a hold
    modes = exits.exit_modes() | {"threshold_only": exits.exit_modes(score_below=0.05)["threshold_only"]}
    return exits.folded_exits(arrays, modes)


@query("ext_09_triggers", TRIG_SQL, d="ret", i="day")
def _(spark, sf):
    return _triggered(spark, sf)


@query("ext_10_reason_shares", f"SELECT mode, reason, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY mode) AS DOUBLE) AS share FROM ({TRIG_SQL}) GROUP BY 1, 2", d="share", i="n")
def _(spark, sf):
    return exits.reason_shares(_triggered(spark, sf), ["mode"])
