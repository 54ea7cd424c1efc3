"""Summary tables: buckets, ablations, regimes, sensitivity, cross-sections, curves and audits."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats, tiers
from ..operators import cross_section as xs, curve, events as ev, exits, indicators as ind, studies as st
from ..operators import universe as uni
from ..operators.fundamentals import lookahead_violations, snapshots_asof, year_end_requests
from ..operators.windows import has_history
from ..plans import event_study as es, positions as pos
from ..sources import star
from .base import query
from .ctes import CTES, W, asof as asof_sql
from .inputs import _month_caps, _month_requests

HZ = (21, 63)


def _study(spark, sf, drawdown=True):
    return es.study_rows(star.bars(spark, sf), star.facts(spark, sf), HZ, 63, drawdown=drawdown)


@query("agg_01_bucket_stats", """
SELECT bucket, count(*) AS n, avg(fwd_21) AS mean_21, avg(fwd_63) AS mean_63, avg(CAST(fwd_63 > 0 AS INT)) AS pct_positive, avg(max_dd) AS mean_max_dd, quantile_cont(fwd_63, CAST(0.5 AS DOUBLE)) AS median
FROM buckets GROUP BY 1""", d="mean_21 mean_63 pct_positive mean_max_dd median", i="n")
def _(spark, sf):
    return st.bucket_report(st.with_buckets(_study(spark, sf)), HZ, 63)


@query("agg_02_spread_criteria", """
SELECT *, high_mean - random_mean AS spread, high_pct - random_pct AS gap, high_mean - random_mean > CAST(0.03 AS DOUBLE) AS pass_spread, high_pct - random_pct > CAST(0.05 AS DOUBLE) AS pass_gap FROM (
 SELECT avg(fwd_63) FILTER (WHERE bucket = 'HIGH') AS high_mean, avg(CAST(fwd_63 > 0 AS INT)) FILTER (WHERE bucket = 'HIGH') AS high_pct,
        avg(fwd_63) FILTER (WHERE bucket = 'RANDOM') AS random_mean, avg(CAST(fwd_63 > 0 AS INT)) FILTER (WHERE bucket = 'RANDOM') AS random_pct FROM buckets)""",
       d="high_mean high_pct random_mean random_pct spread gap")
def _(spark, sf):
    return st.spread_criteria(st.bucket_stats(st.with_buckets(_study(spark, sf)), HZ, 63), 63)


ABL = """
SELECT d.disabled, avg(fwd_63) FILTER (WHERE c >= CAST(0.6 AS DOUBLE)) AS high_mean, avg(fwd_63) FILTER (WHERE c < CAST(0.35 AS DOUBLE)) AS low_mean, count(*) FILTER (WHERE c >= CAST(0.6 AS DOUBLE)) AS high_n, count(*) FILTER (WHERE c < CAST(0.35 AS DOUBLE)) AS low_n FROM (
  SELECT d.disabled, fwd_63, CAST(0.5 AS DOUBLE) * CASE WHEN d.disabled = 'dip' THEN 0.5 ELSE dip_score END + CAST(0.3 AS DOUBLE) * CASE WHEN d.disabled = 'momentum' THEN 0.5 ELSE momentum_score END
         + CAST(0.2 AS DOUBLE) * CASE WHEN d.disabled = 'volume' THEN 0.5 ELSE volume_score END AS c
  FROM outcomes, (VALUES ('none'), ('dip'), ('momentum'), ('volume')) d(disabled) WHERE gate AND fwd_63 IS NOT NULL) d GROUP BY d.disabled"""


@query("agg_03_ablation", ABL, d="high_mean low_mean", i="high_n low_n")
def _(spark, sf):
    return st.ablation(_study(spark, sf, False), tiers.RECOVERY_WEIGHTS, "fwd_63", 0.60, 0.35)


@query("agg_04_regime_breakdown", "SELECT regime, count(*) AS n, avg(fwd_63) AS mean, avg(CAST(fwd_63 > 0 AS INT)) AS pct_positive FROM high WHERE regime IN ('bull', 'bear') GROUP BY 1",
       d="mean pct_positive", i="n")
def _(spark, sf):
    return st.regime_breakdown(es.high_rows(_study(spark, sf, False)), "fwd_63")


@query("agg_05_regime_capture", """
SELECT a.*, a.mean - b.mean AS gap_to_random FROM (SELECT bucket, CASE WHEN grouping(regime) = 1 THEN 'all' ELSE regime END AS regime, count(*) AS n, avg(fwd_63) AS mean FROM buckets WHERE regime IN ('bull', 'bear') GROUP BY GROUPING SETS ((bucket, regime), (bucket))) a
LEFT JOIN (SELECT CASE WHEN grouping(regime) = 1 THEN 'all' ELSE regime END AS regime, avg(fwd_63) AS mean FROM buckets WHERE bucket = 'RANDOM' AND regime IN ('bull', 'bear') GROUP BY GROUPING SETS ((regime), ())) b ON a.regime = b.regime""",
       d="mean gap_to_random", i="n")
def _(spark, sf):
    return st.regime_capture(st.with_buckets(_study(spark, sf, False)), "fwd_63")


@query("agg_06_drawdown_quantiles", """
SELECT quantile_cont(mae, CAST(0.1 AS DOUBLE)) AS p10, quantile_cont(mae, CAST(0.5 AS DOUBLE)) AS p50, quantile_cont(mae, CAST(0.75 AS DOUBLE)) AS p75, quantile_cont(mae, CAST(0.9 AS DOUBLE)) AS p90 FROM high""", d="p10 p50 p75 p90")
def _(spark, sf):
    return st.drawdown_quantiles(es.high_rows(_study(spark, sf, False)))


@query("agg_06_touch_groups", """
SELECT l.level, coalesce(mae <= -l.level / CAST(100 AS DOUBLE), FALSE) AS touched, count(*) AS n, avg(fwd_63) AS mean, count(*) / CAST(sum(count(*)) OVER (PARTITION BY l.level) AS DOUBLE) AS pct
FROM high, (VALUES (10), (15), (20)) l(level) GROUP BY 1, 2""", d="mean pct", i="level n")
def _(spark, sf):
    return st.touch_groups(es.high_rows(_study(spark, sf, False)), "fwd_63")


@query("agg_07_unknown_gate_dropped", "SELECT count(*) AS dropped FROM outcomes WHERE gate IS NULL AND composite_score >= CAST(0.6 AS DOUBLE)", i="dropped")
def _(spark, sf):
    return st.dropped_by_unknown_gate(_study(spark, sf, False))


BANDS = ", ".join(f"('{round(lo * 100)}-{round(hi * 100)}%', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for lo, hi in st.DIP_BANDS)
BAND_ROWS = f"""SELECT b.band, o.* FROM outcomes o, (VALUES {BANDS}) b(band, lo, hi) WHERE gate AND CAST(0.5 AS DOUBLE) * CASE WHEN drawdown_52w IS NOT NULL THEN CAST(drawdown_52w BETWEEN lo AND hi AS INT) END
 + CAST(0.3 AS DOUBLE) * momentum_score + CAST(0.2 AS DOUBLE) * volume_score >= CAST(0.6 AS DOUBLE)"""
BAND_SQL = f"""SELECT band, n, few AS too_few, {', '.join(f'CASE WHEN NOT few THEN {c} END AS {c}' for c in ('mean', 'pct_pos', 'pct_loss', 'pct_hit20', 'bull', 'bear', 'p10', 'median', 'p90', 'spread', 'ux'))} FROM (
 SELECT *, n < 100 OR mean IS NULL AS few, mean - CAST(0.223 AS DOUBLE) AS spread, (mean - CAST(0.223 AS DOUBLE)) / CAST(0.122 AS DOUBLE) * (1 - pct_hit20) * (1 - pct_loss) AS ux FROM (
 SELECT band, count(*) AS n, avg(fwd_63) AS mean, avg(CAST(fwd_63 > 0 AS INT)) AS pct_pos, avg(CAST(fwd_63 < 0 AS INT)) AS pct_loss, avg(CAST(mae <= CAST(-0.2 AS DOUBLE) AS INT)) AS pct_hit20,
  avg(fwd_63) FILTER (WHERE regime = 'bull') AS bull, avg(fwd_63) FILTER (WHERE regime = 'bear') AS bear,
  quantile_cont(fwd_63, CAST(0.1 AS DOUBLE)) AS p10, quantile_cont(fwd_63, CAST(0.5 AS DOUBLE)) AS median, quantile_cont(fwd_63, CAST(0.9 AS DOUBLE)) AS p90 FROM ({BAND_ROWS}) GROUP BY 1))"""


def _bands(spark, sf):
    return st.band_sensitivity(st.band_entries(_study(spark, sf, False)), "fwd_63", "mae", min_n=100)


@query("agg_08_band_sensitivity", BAND_SQL, d="mean pct_pos pct_loss pct_hit20 bull bear p10 median p90 spread ux", i="n")
def _(spark, sf):
    return _bands(spark, sf)


@query("agg_09_band_findings", f"""
WITH t AS ({BAND_SQL}), e AS (SELECT * FROM t WHERE NOT too_few AND n >= 150)
SELECT *, coalesce(best_spread - current_spread > CAST(0.02 AS DOUBLE) AND best_band <> '30-50%', FALSE) AS revise, CASE WHEN above_floor >= 4 THEN 'ROBUST' WHEN above_floor >= 2 THEN 'MODERATELY ROBUST' ELSE 'FRAGILE' END AS verdict FROM (
 SELECT (SELECT band FROM e ORDER BY spread DESC, band DESC LIMIT 1) AS best_band, (SELECT max(spread) FROM e) AS best_spread, (SELECT band FROM e WHERE spread >= CAST(0.08 AS DOUBLE) ORDER BY pct_hit20, band LIMIT 1) AS safest_band,
  (SELECT band FROM e ORDER BY coalesce(bull, -99) DESC, band DESC LIMIT 1) AS best_bull, (SELECT band FROM e ORDER BY coalesce(bear, -99) DESC, band DESC LIMIT 1) AS best_bear,
  (SELECT max(spread) FROM t WHERE band = '30-50%' AND NOT too_few) AS current_spread, (SELECT count(*) FROM e) AS eligible, (SELECT count(*) FROM e WHERE spread >= CAST(0.08 AS DOUBLE)) AS above_floor, (SELECT count(*) FROM e WHERE spread >= 0) AS positive)""",
       d="best_spread current_spread", i="eligible above_floor positive")
def _(spark, sf):
    return st.band_findings(_bands(spark, sf), min_n=150)


# ---------------------------------------------------------------- cross-section

PANEL = f"""SELECT s.ticker, s.as_of AS snapshot_date, s.statement_date, s.filed_date, s.revenue_growth_yoy, s.debt_to_equity, s.roe, s.net_margin, m12.r AS momentum_12m, m6.r AS momentum_6m, f.r AS forward_return_12m FROM snap_year s
""" + "\n".join(f"""{j} JOIN (SELECT q.ticker, q.as_of, CASE WHEN count(*) >= 2 THEN (arg_max(b.close, b.date) - arg_min(b.close, b.date)) / arg_min(b.close, b.date) END AS r
 FROM req_year q JOIN bars b ON b.ticker = q.ticker AND b.date >= q.as_of + ({lo}) AND b.date < q.as_of + ({hi}) GROUP BY 1, 2) {a} ON {a}.ticker = s.ticker AND {a}.as_of = s.as_of"""
              for a, j, lo, hi in (("f", "LEFT", 2, 365), ("m12", "LEFT", -365, -2), ("m6", "LEFT", -182, -2))) + " WHERE s.statement_date IS NOT NULL AND f.r IS NOT NULL"
PANEL2 = f"""SELECT p.*, p.revenue_growth_yoy - q.revenue_growth_yoy AS revenue_growth_acceleration, p.net_margin - q.net_margin AS margin_improvement FROM ({PANEL}) p
LEFT JOIN ({PANEL}) q ON q.ticker = p.ticker AND q.snapshot_date + INTERVAL 1 YEAR = p.snapshot_date"""


def _panel(spark, sf):
    b = star.bars(spark, sf)
    req = year_end_requests(b).select("ticker", F.col("as_of").alias("snapshot_date"))
    return xs.add_factor_momentum(xs.snapshot_panel(req, star.facts(spark, sf), b))


def _spread_sql(rows: str, keys: str, value: str) -> str:
    """Top and bottom tenth by value; ties at a cut share the places evenly."""
    share = "least(c, greatest(0, k - {before}))"
    return f"""SELECT {keys}, max(n) AS n, CASE WHEN max(n) >= 20 THEN sum(s * {share.format(before='(n - upto)')} / c) / max(k) END AS top_mean, CASE WHEN max(n) >= 20 THEN sum(s * {share.format(before='(upto - c)')} / c) / max(k) END AS bottom_mean,
 CASE WHEN max(n) >= 20 THEN sum(s * {share.format(before='(n - upto)')} / c) / max(k) - sum(s * {share.format(before='(upto - c)')} / c) / max(k) END AS spread
 FROM (SELECT *, greatest(1, ceil(n * CAST(0.1 AS DOUBLE))) AS k FROM (SELECT *, sum(c) OVER (PARTITION BY {keys} ORDER BY v) AS upto, sum(c) OVER (PARTITION BY {keys}) AS n FROM (
  SELECT {keys}, {value} AS v, count(*) AS c, sum(forward_return_12m) AS s FROM ({rows}) WHERE {value} IS NOT NULL GROUP BY ALL))) GROUP BY ALL"""


FACTOR_ROWS = " UNION ALL ".join(f"SELECT '{f}' AS factor, snapshot_date, forward_return_12m, {f} * {d} AS x FROM ({PANEL2})" for f, d in xs.FACTORS.items())
SPREADS = _spread_sql(FACTOR_ROWS, "factor, snapshot_date", "x")


@query("agg_10_decile_spread", SPREADS, d="top_mean bottom_mean spread", i="n")
def _(spark, sf):
    return xs.factor_spreads(_panel(spark, sf))


@query("agg_11_factor_reliability", f"""
SELECT factor, count(*) FILTER (WHERE spread > 0) AS positive_years, count(spread) AS total_years, coalesce(count(*) FILTER (WHERE spread > 0) / nullif(CAST(count(spread) AS DOUBLE), 0) >= CAST(2 AS DOUBLE) / 3, FALSE) AS reliable FROM ({SPREADS}) GROUP BY 1""",
       i="positive_years total_years")
def _(spark, sf):
    return xs.reliability(xs.factor_spreads(_panel(spark, sf)))


def _rank(col, name):
    return (f"CASE WHEN {col} IS NOT NULL THEN (rank() OVER (PARTITION BY snapshot_date, {col} IS NULL ORDER BY {col}) + (count(*) OVER (PARTITION BY snapshot_date, {col}) - 1) / CAST(2 AS DOUBLE)) / count({col}) OVER (PARTITION BY snapshot_date) * 100 END AS {name}")


RANKS = f"""SELECT *, {_rank('revenue_growth_yoy', 'rank_growth')}, {_rank('neg_de', 'rank_de')}, {_rank('roe', 'rank_roe')}, {_rank('net_margin', 'rank_margin')}, {_rank('momentum_12m', 'rank_momentum')}
FROM (SELECT *, -debt_to_equity AS neg_de FROM ({PANEL}))"""


@query("agg_12_percentile_rank", f"SELECT ticker, snapshot_date, rank_growth, rank_de, rank_roe, rank_margin, rank_momentum FROM ({RANKS})", d="rank_growth rank_de rank_roe rank_margin rank_momentum")
def _(spark, sf):
    return xs.rank_factors(_panel(spark, sf)).select("ticker", "snapshot_date", "rank_growth", "rank_de", "rank_roe", "rank_margin", "rank_momentum")


SCHEMES = ", ".join(f"('{s}', " + ", ".join(f"CAST({w[f]} AS DOUBLE)" for f in xs.RANK_OF) + ")" for s, w in xs.WEIGHT_SCHEMES.items())
HAVE = " + ".join(f"CAST({r} IS NOT NULL AS INT)" for r in xs.RANK_OF.values())
COMP = f"""SELECT *, {HAVE} AS factors_available, CASE WHEN {HAVE} >= 3 THEN ({' + '.join(f'coalesce(w{i} * {r}, 0)' for i, r in enumerate(xs.RANK_OF.values()))}) / ({' + '.join(f'CASE WHEN {r} IS NOT NULL THEN w{i} ELSE 0 END' for i, r in enumerate(xs.RANK_OF.values()))}) END AS composite_score
FROM ({RANKS}) r, (VALUES {SCHEMES}) s(scheme, w0, w1, w2, w3)"""


@query("agg_13_composite", f"SELECT ticker, snapshot_date, factors_available, composite_score FROM ({COMP}) WHERE scheme = 'theory'", d="composite_score", i="factors_available")
def _(spark, sf):
    return xs.composite(xs.rank_factors(_panel(spark, sf))).select("ticker", "snapshot_date", "factors_available", "composite_score")


@query("udf_03_weight_schemes", f"SELECT scheme, count(composite_score) AS n, avg(composite_score) AS mean FROM ({COMP}) GROUP BY 1", d="mean", i="n")
def _(spark, sf):
    out = xs.composite(xs.rank_factors(_panel(spark, sf)), xs.WEIGHT_SCHEMES)
    return out.groupBy("scheme").agg(F.count("composite_score").alias("n"), F.avg("composite_score").alias("mean"))


COMP_SPREADS = _spread_sql(f"SELECT * REPLACE (round(composite_score, 9) AS composite_score) FROM ({COMP})", "scheme, snapshot_date", "composite_score")


def _scheme_spreads(spark, sf):
    scored = xs.composite(xs.rank_factors(_panel(spark, sf)), xs.WEIGHT_SCHEMES)
    return xs.decile_spreads(scored.withColumn("composite_score", F.round("composite_score", 9)), ["scheme", "snapshot_date"], "composite_score", "forward_return_12m")


@query("agg_14_composite_evaluation", COMP_SPREADS, d="top_mean bottom_mean spread", i="n")
def _(spark, sf):
    return _scheme_spreads(spark, sf)


@query("agg_14_scheme_reliability", f"""
SELECT scheme, count(*) FILTER (WHERE spread > 0) AS positive_years, count(spread) AS total_years, coalesce(count(*) FILTER (WHERE spread > 0) / nullif(CAST(count(spread) AS DOUBLE), 0) >= CAST(5 AS DOUBLE) / 7, FALSE) AS reliable FROM ({COMP_SPREADS}) GROUP BY 1""",
       i="positive_years total_years")
def _(spark, sf):
    return xs.reliability(_scheme_spreads(spark, sf), "scheme", 5 / 7)


PANEL_D = "revenue_growth_yoy debt_to_equity roe net_margin momentum_12m momentum_6m forward_return_12m"


@query("agg_15_walk_forward_panel", PANEL, d=PANEL_D)
def _(spark, sf):
    return _panel(spark, sf).drop("revenue_growth_acceleration", "margin_improvement")


@query("agg_16_factor_momentum", f"SELECT ticker, snapshot_date, revenue_growth_acceleration, margin_improvement FROM ({PANEL2})", d="revenue_growth_acceleration margin_improvement")
def _(spark, sf):
    return _panel(spark, sf).select("ticker", "snapshot_date", "revenue_growth_acceleration", "margin_improvement")


# ---------------------------------------------------------------- curves


def _curves(spark, sf):
    """Every instrument's closes and the benchmark as value series."""
    b = star.bars(spark, sf)
    return b.select(F.col("ticker").alias("series"), "date", F.col("close").alias("value"))


def _bench(spark, sf):
    return star.benchmark(star.bars(spark, sf)).withColumn("series", F.lit("benchmark"))


CURVE_SQL = """
SELECT a.series, days, "start", "end", final_value, max_drawdown, final_value / v0 - 1 AS total_return, pow(final_value / v0, 1 / greatest(date_diff('day', "start", "end") / CAST(365.25 AS DOUBLE), 1)) - 1 AS cagr, CASE WHEN s > 1e-10 THEN m / s * sqrt(252) ELSE 0 END AS sharpe,
 best_year, best_return, worst_year, worst_return FROM (
 SELECT series, count(*) AS days, min(date) AS "start", max(date) AS "end", arg_min(value, date) AS v0, arg_max(value, date) AS final_value, min((value - top) / top) AS max_drawdown, avg(r) AS m, stddev_samp(r) AS s FROM (
  SELECT *, max(value) OVER (PARTITION BY series ORDER BY date) AS top, value / lag(value) OVER (PARTITION BY series ORDER BY date) - 1 AS r FROM ({src})) GROUP BY 1) a
JOIN (SELECT series, arg_max(year, a) AS best_year, max(a) AS best_return, arg_min(year, a) AS worst_year, min(a) AS worst_return FROM (
  SELECT series, year, c / coalesce(lag(c) OVER (PARTITION BY series ORDER BY year), o) - 1 AS a FROM (SELECT series, year(date) AS year, arg_min(value, date) AS o, arg_max(value, date) AS c FROM ({src}) GROUP BY 1, 2)) GROUP BY 1) b ON a.series = b.series"""
CURVE_D = "final_value max_drawdown total_return cagr sharpe best_return worst_return"


@query("agg_17_curve_metrics", CURVE_SQL.replace("{src}", "SELECT ticker AS series, date, close AS value FROM bars"), d=CURVE_D, i="days best_year worst_year")
def _(spark, sf):
    return curve.curve_metrics(_curves(spark, sf))


@query("agg_18_benchmark_metrics", CURVE_SQL.replace("{src}", "SELECT 'benchmark' AS series, date, close / first_value(close) OVER (ORDER BY date) * 100000 AS value FROM bench"), d=CURVE_D, i="days best_year worst_year", digits=4)
def _(spark, sf):
    return curve.curve_metrics(curve.buy_and_hold(_bench(spark, sf)))


@query("agg_19_within_year_returns", "SELECT ticker AS series, year(date) AS year, arg_max(close, date) / arg_min(close, date) - 1 AS year_return, count(*) AS days FROM bars GROUP BY 1, 2 HAVING count(*) >= 2", d="year_return", i="year days")
def _(spark, sf):
    return curve.within_year_returns(_curves(spark, sf))


def _trades(spark, sf):
    return es.crossing_trades(star.bars(spark, sf), 63)


T = "(SELECT t.*, c.composite_score AS score FROM crossed c JOIN trades t ON t.ticker = c.ticker AND t.date = c.date)"
STATS = """count(*) AS n, avg(CAST(trade_return > 0 AS INT)) AS win_rate, avg(trade_return) AS avg_return, avg(bars_held) AS avg_hold, count(*) FILTER (WHERE trade_return > 0) AS winners,
 count(*) FILTER (WHERE trade_return <= 0) AS losers, max(trade_return) AS best, min(trade_return) AS worst"""
YEARS = "(SELECT CAST(date_diff('day', min(date), max(date)) AS DOUBLE) / CAST(365.25 AS DOUBLE) FROM bars)"
STATS_D, STATS_I = "win_rate avg_return avg_hold best worst", "n winners losers"


@query("agg_20_trade_stats", f"SELECT {STATS} FROM {T} WHERE trade_return IS NOT NULL", d=STATS_D, i=STATS_I)
def _(spark, sf):
    return st.trade_stats(_trades(spark, sf))


@query("agg_21_score_buckets", f"""
SELECT CASE WHEN score < CAST(0.65 AS DOUBLE) THEN '0.60-0.65' WHEN score < CAST(0.70 AS DOUBLE) THEN '0.65-0.70' WHEN score < CAST(0.75 AS DOUBLE) THEN '0.70-0.75' ELSE '0.75-1.00' END AS bucket, {STATS}, count(*) / {YEARS} AS per_year
FROM {T} t WHERE trade_return IS NOT NULL AND EXISTS (SELECT 1 FROM ranked u WHERE cap_rank <= 50 AND u.ticker = t.ticker AND date_trunc('month', u.as_of) = date_trunc('month', t.date)) GROUP BY 1""", d=STATS_D + " per_year", i=STATS_I)
def _(spark, sf):
    top = uni.top_by_cap(_month_caps(spark, sf), 50)
    pool = uni.in_universe(_trades(spark, sf), top).withColumn("bucket", tiers.score_bucket(F.col("composite_score")))
    return st.per_year(st.trade_stats(pool, ["bucket"]), star.bars(spark, sf), "n", "per_year")


@query("agg_22_threshold_sweep", f"SELECT th.threshold, {STATS} FROM {T} t JOIN (VALUES (CAST(0.60 AS DOUBLE)), (CAST(0.65 AS DOUBLE)), (CAST(0.70 AS DOUBLE)), (CAST(0.75 AS DOUBLE))) th(threshold) ON t.score >= th.threshold WHERE trade_return IS NOT NULL GROUP BY 1",
       d=STATS_D + " threshold", i=STATS_I)
def _(spark, sf):
    return st.trade_stats(st.over_thresholds(_trades(spark, sf), [0.60, 0.65, 0.70, 0.75]), ["threshold"])


P63 = """(SELECT e.ticker, e.date AS entry_date, e.composite_score AS score, b.pos - e.pos AS day, b.close / e.close AS ratio
 FROM crossed e JOIN scored b ON b.ticker = e.ticker AND b.pos BETWEEN e.pos + 1 AND e.pos + 63 WHERE e.pos + 63 <= e.n_bars)"""
GRID_SQL = f"""SELECT th.threshold, g.hold, g.rule, avg(p.ratio - 1) AS metric, avg(CAST(p.ratio > 1 AS INT)) AS win_rate, count(*) AS n FROM (
 SELECT e.*, h.hold, r.rule, CASE WHEN r.rule = 'A' THEN h.hold ELSE least(h.hold, coalesce(e.stop, h.hold)) END AS last FROM (
  SELECT ticker, entry_date, max(score) AS score, min(day) FILTER (WHERE ratio <= CAST(0.6 AS DOUBLE)) AS stop FROM {P63} GROUP BY 1, 2) e, (VALUES (21), (63)) h(hold), (VALUES ('A'), ('B')) r(rule)) g
 JOIN {P63} p ON p.ticker = g.ticker AND p.entry_date = g.entry_date AND p.day = g.last
 JOIN (VALUES (CAST(0.60 AS DOUBLE)), (CAST(0.65 AS DOUBLE)), (CAST(0.70 AS DOUBLE))) th(threshold) ON g.score >= th.threshold GROUP BY 1, 2, 3"""


def _grid(spark, sf):
    """Mean return and share of winners per entry threshold, holding period and exit rule."""
    arrays = es.crossing_paths(star.bars(spark, sf), horizon=max(HZ))
    rows = st.over_thresholds(exits.ruled_returns(arrays, HZ), [0.60, 0.65, 0.70], "entry_score")
    return rows.groupBy("threshold", "hold", "rule").agg(F.avg("ret").alias("metric"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.count(F.lit(1)).alias("n"))


@query("agg_23_grid_rollups", f"""
WITH g AS ({GRID_SQL}) SELECT 'threshold' AS dimension, CASE WHEN threshold = CAST(0.6 AS DOUBLE) THEN '0.6' WHEN threshold = CAST(0.65 AS DOUBLE) THEN '0.65' ELSE '0.7' END AS level, count(*) AS variants, avg(metric) AS avg_metric, max(metric) AS best_metric FROM g GROUP BY ALL
UNION ALL SELECT 'hold', CAST(hold AS VARCHAR), count(*), avg(metric), max(metric) FROM g GROUP BY ALL
UNION ALL SELECT 'rule', rule, count(*), avg(metric), max(metric) FROM g GROUP BY ALL""", d="avg_metric best_metric", i="variants")
def _(spark, sf):
    return st.grid_rollup(_grid(spark, sf), ["threshold", "hold", "rule"], "metric")


@query("agg_23_grid_candidates", f"""
WITH g AS ({GRID_SQL}) SELECT g.*, g.metric > b.metric AND g.win_rate > b.win_rate AS candidate FROM g, (SELECT * FROM g WHERE threshold = CAST(0.6 AS DOUBLE) AND hold = 63 AND rule = 'A') b""", d="threshold metric win_rate", i="hold n")
def _(spark, sf):
    baseline = (F.col("threshold") == 0.60) & (F.col("hold") == 63) & (F.col("rule") == "A")
    return st.grid_candidates(_grid(spark, sf), baseline, ["metric", "win_rate"])


@query("agg_23_grid_top", f"WITH g AS ({GRID_SQL}) SELECT * FROM g ORDER BY round(metric, 9) DESC, threshold, hold, rule LIMIT 5", d="threshold metric win_rate", i="hold n")
def _(spark, sf):
    return _grid(spark, sf).orderBy(F.round("metric", 9).desc(), "threshold", "hold", "rule").limit(5)


@query("agg_24_rate_by_year", "SELECT year(b.date) AS year, avg(r.rate) AS mean_rate FROM bench b ASOF LEFT JOIN rates r ON r.date <= b.date GROUP BY 1", d="mean_rate", i="year")
def _(spark, sf):
    filled = curve.forward_fill(star.benchmark(star.bars(spark, sf)), star.rates(spark, sf), "rate")
    return filled.groupBy(F.year("date").alias("year")).agg(F.avg("rate").alias("mean_rate"))


@query("agg_25_interaction", f"""
SELECT *, a + (b - a) + (c - a) AS additive, d - (a + (b - a) + (c - a)) AS interaction FROM (
 SELECT avg(trade_return) FILTER (WHERE score >= CAST(0.6 AS DOUBLE)) AS a, avg(trade_return) FILTER (WHERE score >= CAST(0.7 AS DOUBLE)) AS b,
        avg(same_close_return) FILTER (WHERE score >= CAST(0.6 AS DOUBLE)) AS c, avg(same_close_return) FILTER (WHERE score >= CAST(0.7 AS DOUBLE)) AS d FROM {T})""".replace(" AS a,", ' AS "A",').replace(" AS b,", ' AS "B",').replace(" AS c,", ' AS "C",').replace(" AS d FROM", ' AS "D" FROM'),
       d="A B C D additive interaction")
def _(spark, sf):
    high = F.col("composite_score") >= 0.70
    cell = lambda name, value, keep: F.when(keep, F.struct(F.lit(name).alias("cell"), F.col(value).alias("v")))
    every = F.lit(True)
    cells = F.array_compact(F.array(cell("A", "trade_return", every), cell("B", "trade_return", high), cell("C", "same_close_trade_return", every), cell("D", "same_close_trade_return", high)))
    rows = _trades(spark, sf).select(F.explode(cells).alias("_c")).select("_c.*")
    return st.interaction(rows.groupBy("cell").agg(F.avg("v").alias("v")), "cell", "v")


@query("agg_26_regime_days", "SELECT count(*) FILTER (WHERE above_ma) AS days_above, count(*) FILTER (WHERE NOT above_ma) AS days_below FROM regimes", i="days_above days_below")
def _(spark, sf):
    return st.regime_days(ev.level_regime(star.benchmark(star.bars(spark, sf))))


@query("agg_26_blocked_per_year", """
SELECT d.year, d.days_below, coalesce(s.signals, 0) AS signals, coalesce(s.blocked, 0) AS blocked FROM (SELECT year(date) AS year, count(*) FILTER (WHERE NOT above_ma) AS days_below FROM regimes GROUP BY 1) d
LEFT JOIN (SELECT year(c.date) AS year, count(*) AS signals, count(*) FILTER (WHERE NOT r.above_ma) AS blocked FROM crossed c JOIN regimes r USING (date)
 WHERE EXISTS (SELECT 1 FROM ranked u WHERE cap_rank <= 50 AND u.ticker = c.ticker AND date_trunc('month', u.as_of) = date_trunc('month', c.date)) GROUP BY 1) s ON s.year = d.year""", i="year days_below signals blocked")
def _(spark, sf):
    b = star.bars(spark, sf)
    signals = uni.in_universe(es.score_crossings(b).select("ticker", "date"), uni.top_by_cap(_month_caps(spark, sf), 50))
    return st.blocked_per_year(signals, ev.level_regime(star.benchmark(b)))


MOMENTS = """SELECT count(r) AS n, avg(r) / stddev_pop(r) AS sr, avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5) AS skew, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) AS kurt FROM (
 SELECT r, avg(r) OVER () AS m FROM (SELECT close / lag(close) OVER (ORDER BY date) - 1 AS r FROM bench) WHERE r IS NOT NULL)"""


@query("agg_27_sharpe_moments", MOMENTS, d="sr skew kurt", i="n")
def _(spark, sf):
    return curve.sharpe_moments(_bench(spark, sf).withColumnRenamed("close", "value")).drop("series")


def _phi(z: str) -> str:
    """Normal distribution function by Simpson's rule with 200 steps."""
    return (f"(CAST(0.5 AS DOUBLE) + ({z}) / 600 * list_sum(list_transform(range(0, 201), lambda i: CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END "
            f"* exp(-0.5 * pow(({z}) * i / 200, 2)) / sqrt(2 * pi()))))")


PSR_Z = "(sr - {0}) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr)"
DSR_SQL = f"""
WITH RECURSIVE m AS ({MOMENTS}), t AS (SELECT var_samp(sr) AS trial_variance, count(sr) AS trials FROM (
  SELECT ticker, avg(r) / stddev_pop(r) AS sr FROM (SELECT ticker, close / lag(close) OVER ({W}) - 1 AS r FROM bars) WHERE r IS NOT NULL GROUP BY 1)),
p AS (SELECT 1 AS k, 1 - 1 / CAST(trials AS DOUBLE) AS p FROM t UNION ALL SELECT 2, 1 - 1 / (trials * exp(CAST(1 AS DOUBLE))) FROM t),
inv AS (SELECT k, p, CAST(0 AS DOUBLE) AS lo, CAST(8 AS DOUBLE) AS hi, 0 AS it FROM p
  UNION ALL SELECT k, p, CASE WHEN f < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f < p THEN hi ELSE (lo + hi) / 2 END, it + 1 FROM (SELECT *, {_phi('(lo + hi) / 2')} AS f FROM inv WHERE it < 50)),
q AS (SELECT max(lo) FILTER (WHERE k = 1) AS a, max(lo) FILTER (WHERE k = 2) AS b FROM inv WHERE it = 50),
s AS (SELECT *, sqrt(trial_variance) * ((1 - CAST(0.5772156649015329 AS DOUBLE)) * a + CAST(0.5772156649015329 AS DOUBLE) * b) AS sr0 FROM m, t, q),
z AS (SELECT *, {PSR_Z.format('0')} AS z0, {PSR_Z.format('CAST(0.01 AS DOUBLE)')} AS z1, {PSR_Z.format('sr0')} AS z2 FROM s)
SELECT n, sr, skew, kurt, trial_variance, trials, sr0, {_phi('z0')} AS psr_zero, {_phi('z1')} AS psr_benchmark, {_phi('z2')} AS dsr FROM z"""


@query("agg_27_deflated_sharpe", DSR_SQL, d="sr skew kurt trial_variance sr0 psr_zero psr_benchmark dsr", i="n trials")
def _(spark, sf):
    moments = curve.sharpe_moments(_bench(spark, sf).withColumnRenamed("close", "value")).drop("series")
    trials = curve.sharpe_moments(_curves(spark, sf)).select(F.col("sr").alias("sharpe"))
    return curve.deflated_sharpe(moments, trials, benchmark_sr=0.01)


@query("udf_05_sharpe_z", f"""WITH z AS (SELECT {PSR_Z.format('0')} AS z FROM ({MOMENTS})) SELECT z, {_phi('z / 10')} AS p, z / 10 AS back FROM z""", d="z p back")
def _(spark, sf):
    m = curve.sharpe_moments(_bench(spark, sf).withColumnRenamed("close", "value"))
    z = stats.sharpe_z(F.col("sr"), F.lit(0.0), F.col("n"), F.col("skew"), F.col("kurt"))
    # A tenth of the statistic stays off the flat ends of the distribution function.
    return m.select(z.alias("z"), stats.normal_cdf(z / 10).alias("p"), stats.normal_quantile(stats.normal_cdf(z / 10)).alias("back"))


@query("agg_28_timing_cost", """
SELECT count(*) AS n, avg(a) AS avg_now, avg(b) AS avg_later, avg(b / a - 1) AS mean_move, quantile_cont(b / a - 1, CAST(0.5 AS DOUBLE)) AS median_move, avg(CAST(b > a AS INT)) AS pct_higher FROM (
 SELECT x.close AS a, y.close AS b FROM crossed c ASOF JOIN bench x ON x.date <= c.date ASOF JOIN bench y ON y.date <= c.date + 30)""", d="avg_now avg_later mean_move median_move pct_higher", i="n")
def _(spark, sf):
    from ..operators.ranking import exact_quantiles
    b = star.bars(spark, sf)
    rows = curve.timing_cost(es.score_crossings(b).select("ticker", "date"), star.benchmark(b))
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("level_now").alias("avg_now"), F.avg("level_later").alias("avg_later"),
                   F.avg("move").alias("mean_move"), F.avg((F.col("move") > 0).cast("double")).alias("pct_higher"))
    return st.side_by_side(one, exact_quantiles(rows, [], "move", {"median_move": 0.5}))


@query("agg_29_money_market_index", """
SELECT date, rate, exp(sum(ln(1 + coalesce(rate, 0)) * coalesce(gap, 0) / 365) OVER (ORDER BY date)) AS mm_index FROM (
 SELECT b.date, r.rate, date_diff('day', lag(b.date) OVER (ORDER BY b.date), b.date) AS gap FROM bench b ASOF LEFT JOIN rates r ON r.date <= b.date)""", d="rate mm_index")
def _(spark, sf):
    return curve.money_market_index(star.benchmark(star.bars(spark, sf)), star.rates(spark, sf))


SPAN = "(SELECT CAST(unnest(generate_series((SELECT min(date) FROM bars), (SELECT max(date) FROM bars), INTERVAL 1 DAY)) AS DATE) AS day)"
ACCRUED = f"(SELECT d.day, sum(ln(1 + coalesce(r.rate, 0)) / 365) OVER (ORDER BY d.day) AS acc FROM {SPAN} d ASOF LEFT JOIN rates r ON r.date <= d.day)"


def _accrual(spark, sf):
    return curve.daily_accrual(star.rates(spark, sf), star.bars(spark, sf))


@query("agg_29_position_interest", f"""
SELECT t.ticker, t.date, exp(b.acc - a.acc) - 1 AS mm_return FROM {T} t JOIN {ACCRUED} a ON a.day = t.entry_date JOIN {ACCRUED} b ON b.day = t.exit_date WHERE t.exit_date > t.entry_date""", d="mm_return")
def _(spark, sf):
    t = _trades(spark, sf).where(F.col("exit_date") > F.col("entry_date"))
    return curve.span_interest(t, _accrual(spark, sf), "entry_date", "exit_date").select("ticker", "date", "mm_return")


@query("agg_30_benchmark_relative", f"""
SELECT status, count(*) AS n, avg(ret) AS strategy, avg(bench_ret) AS benchmark, avg(mm) AS money_market, avg(ret - bench_ret) AS vs_benchmark, avg(ret - mm) AS vs_mm FROM (
 SELECT t.status, t.trade_return AS ret, y.close / x.close - 1 AS bench_ret, exp(b.acc - a.acc) - 1 AS mm FROM {T} t ASOF JOIN bench x ON x.date >= t.entry_date ASOF JOIN bench y ON y.date < t.exit_date
 JOIN {ACCRUED} a ON a.day = t.entry_date JOIN {ACCRUED} b ON b.day = t.exit_date WHERE t.exit_date > t.entry_date) GROUP BY 1""", d="strategy benchmark money_market vs_benchmark vs_mm", i="n")
def _(spark, sf):
    t = _trades(spark, sf).where(F.col("exit_date") > F.col("entry_date")).withColumnsRenamed({"trade_return": "ret", "exit_date": "end_date"})
    rel = pos.benchmark_relative(t, star.benchmark(star.bars(spark, sf)), _accrual(spark, sf))
    return rel.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("strategy"), F.avg("benchmark_return").alias("benchmark"),
                                     F.avg("mm_return").alias("money_market"), F.avg("vs_benchmark").alias("vs_benchmark"), F.avg("vs_mm").alias("vs_mm"))


@query("agg_31_fill_comparison", f"""
SELECT count(*) AS n, avg(g) AS mean_gap, avg(same_close_return) AS same_close_mean, avg(trade_return) AS next_open_mean, avg(trade_return - same_close_return) AS mean_delta, avg(CAST(g > 0 AS INT)) AS pct_gap_up FROM (
 SELECT *, entry_price / close - 1 AS g FROM {T} WHERE entry_price IS NOT NULL)""", d="mean_gap same_close_mean next_open_mean mean_delta pct_gap_up", i="n")
def _(spark, sf):
    rows = _trades(spark, sf).withColumnsRenamed({"same_close_entry_price": "same_close_price", "same_close_trade_return": "same_close_return",
                                                  "entry_price": "next_open_price", "trade_return": "next_open_return"})
    return st.fill_comparison(rows.where(F.col("next_open_price").isNotNull()))


AUDIT = """
SELECT t.ticker, t.date, t.same_close_return AS r, CASE WHEN n_bars - t.pos >= 63 THEN 'CLOSED' ELSE 'OPEN' END AS status
FROM trades t JOIN gkept k ON k.ticker = t.ticker AND k.pos = t.pos WHERE t.date >= DATE '1999-01-01' AND t.same_close_return IS NOT NULL"""


@query("agg_32_oos_audit", f"""
WITH a AS ({AUDIT}), g AS (SELECT status, count(*) AS n, avg(r) AS mean_return, quantile_cont(r, CAST(0.5 AS DOUBLE)) AS median_return, avg(CAST(r > 0 AS INT)) AS win_rate,
 max(struct_pack(r := r, t := ticker, d := date)) AS b, min(struct_pack(r := r, t := ticker, d := date)) AS w FROM a GROUP BY 1)
SELECT status, n, mean_return, median_return, win_rate, b.t AS best_ticker, b.d AS best_date, b.r AS best_return, w.t AS worst_ticker, w.d AS worst_date, w.r AS worst_return,
 0.223 AS random_baseline, 0.492 AS high_baseline, mean_return - CAST(0.223 AS DOUBLE) AS vs_random, mean_return - CAST(0.492 AS DOUBLE) AS vs_high,
 CASE WHEN coalesce((SELECT n FROM g WHERE status = 'CLOSED'), 0) < 5 THEN 'TOO FEW' WHEN (SELECT mean_return FROM g WHERE status = 'CLOSED') > CAST(0.223 AS DOUBLE) THEN 'SUPPORTS' ELSE 'CONTRADICTS' END AS verdict FROM g""",
       d="mean_return median_return win_rate best_return worst_return random_baseline high_baseline vs_random vs_high", i="n")
def _(spark, sf):
    return es.audit_report(es.audit_trades(star.bars(spark, sf), star.facts(spark, sf), "1999-01-01", 63))


@query("agg_33_market_context", """
SELECT series, total_return, max_drawdown, pct_bull, CASE WHEN pct_bull > 0.5 THEN 'bull' ELSE 'bear' END AS dominant FROM (SELECT 'benchmark' AS series, arg_max(close, date) / arg_min(close, date) - 1 AS total_return, min(close / top - 1) AS max_drawdown, avg(CAST(regime = 'bull' AS INT)) AS pct_bull
FROM (SELECT *, max(close) OVER (ORDER BY date) AS top FROM regimes))""", d="total_return max_drawdown pct_bull")
def _(spark, sf):
    return curve.market_context(ev.slope_regime(_bench(spark, sf)))


YEARLY = """SELECT series, year, c / coalesce(lag(c) OVER (PARTITION BY series ORDER BY year), o) - 1 AS a FROM (SELECT series, year(date) AS year, arg_min(value, date) AS o, arg_max(value, date) AS c FROM ({0}) GROUP BY 1, 2)"""


@query("agg_34_years_against_benchmark", f"""
SELECT s.series, count(*) FILTER (WHERE s.a > b.a) AS years_won, count(*) AS years, coalesce(string_agg(CAST(s.year AS VARCHAR), ',' ORDER BY s.year) FILTER (WHERE s.a > b.a), '') AS won, coalesce(string_agg(CAST(s.year AS VARCHAR), ',' ORDER BY s.year) FILTER (WHERE NOT s.a > b.a), '') AS lost
FROM ({YEARLY.format('SELECT ticker AS series, date, close AS value FROM bars')}) s JOIN ({YEARLY.format("SELECT 'b' AS series, date, close AS value FROM bench")}) b ON b.year = s.year GROUP BY 1""", i="years_won years")
def _(spark, sf):
    base = curve.annual_returns(_bench(spark, sf), value="close").select("year", F.col("annual_return").alias("bench_return"))
    return curve.years_against(curve.annual_returns(_curves(spark, sf)), base)


@query("agg_35_lookahead_audit", f"""
SELECT count(*) AS snapshots, count(*) FILTER (WHERE filed_date > as_of - 90) AS violations FROM ({asof_sql('month_universe')}) WHERE statement_date IS NOT NULL""", i="snapshots violations")
def _(spark, sf):
    snaps = snapshots_asof(_month_requests(spark, sf).select("ticker", "as_of").distinct(), star.facts(spark, sf)).where(F.col("statement_date").isNotNull())
    bad = lookahead_violations(snaps).agg(F.count(F.lit(1)).alias("violations"))
    return st.side_by_side(snaps.agg(F.count(F.lit(1)).alias("snapshots")), bad)


@query("agg_36_robustness_verdict", f"""
SELECT *, alt_avg_return > base_avg_return AND alt_win_rate > base_win_rate AS better_both, alt_per_year >= 3 AS enough_signals, coalesce(high_bucket >= low_bucket, FALSE) AS ordered_buckets,
 NOT (abs(alt_avg_return - base_avg_return) < CAST(0.01 AS DOUBLE) AND abs(alt_win_rate - base_win_rate) < CAST(0.1 AS DOUBLE)) AS clear_gap,
 alt_avg_return > base_avg_return AND alt_win_rate > base_win_rate AND alt_per_year >= 3 AND coalesce(high_bucket >= low_bucket, FALSE) AND NOT (abs(alt_avg_return - base_avg_return) < CAST(0.01 AS DOUBLE) AND abs(alt_win_rate - base_win_rate) < CAST(0.1 AS DOUBLE)) AS robust FROM (
 SELECT avg(trade_return) AS base_avg_return, avg(CAST(trade_return > 0 AS INT)) AS base_win_rate, avg(trade_return) FILTER (WHERE score >= CAST(0.65 AS DOUBLE)) AS alt_avg_return,
  avg(CAST(trade_return > 0 AS INT)) FILTER (WHERE score >= CAST(0.65 AS DOUBLE)) AS alt_win_rate, count(*) FILTER (WHERE score >= CAST(0.65 AS DOUBLE)) / {YEARS} AS alt_per_year,
  avg(trade_return) FILTER (WHERE score >= CAST(0.65 AS DOUBLE)) AS high_bucket, avg(trade_return) FILTER (WHERE score < CAST(0.65 AS DOUBLE)) AS low_bucket FROM {T} WHERE trade_return IS NOT NULL)""",
       d="base_avg_return base_win_rate alt_avg_return alt_win_rate alt_per_year high_bucket low_bucket")
def _(spark, sf):
    t = _trades(spark, sf).where(F.col("trade_return").isNotNull())
    r, up = F.col("trade_return"), F.col("composite_score") >= 0.65
    win = (r > 0).cast("double")
    one = t.agg(F.avg(r).alias("base_avg_return"), F.avg(win).alias("base_win_rate"), F.avg(F.when(up, r)).alias("alt_avg_return"),
                F.avg(F.when(up, win)).alias("alt_win_rate"), F.count_if(up).alias("alt_n"),
                F.avg(F.when(up, r)).alias("high_bucket"), F.avg(F.when(~up, r)).alias("low_bucket"))
    return st.robustness_verdict(st.per_year(one, star.bars(spark, sf), "alt_n", "alt_per_year").drop("alt_n"))


EPATHS = """(SELECT e.ticker, e.date AS entry_date, b.pos - e.pos AS day, b.close, b.close / e.close AS ratio, e.close AS entry_price, b.atr_14 AS atr, e.atr_14 AS entry_atr
 FROM entry_all e JOIN entry_all b ON b.ticker = e.ticker AND b.pos BETWEEN e.pos + 1 AND e.pos + 252 WHERE e.n_bars >= 200 AND e.composite_score >= CAST(0.65 AS DOUBLE) AND e.pos + 252 <= e.n_bars)"""


@query("agg_37_exit_styles", f"""
WITH p AS {EPATHS} SELECT avg(c.f252) AS fixed_252, avg(c.f126) AS fixed_126, avg(a.ret) AS atr_trail, count(*) AS n FROM (
 SELECT ticker, entry_date, max(ratio) FILTER (WHERE day = 252) - 1 AS f252, max(ratio) FILTER (WHERE day = 126) - 1 AS f126 FROM p GROUP BY 1, 2) c
JOIN (SELECT ticker, entry_date, coalesce(arg_min(ratio, day) FILTER (WHERE close < stop), arg_max(ratio, day)) - 1 AS ret FROM (SELECT *, coalesce(last_value(lvl IGNORE NULLS) OVER (PARTITION BY ticker, entry_date ORDER BY day), entry_price - 3 * entry_atr) AS stop FROM (
  SELECT *, CASE WHEN close > greatest(entry_price, coalesce(max(close) OVER (PARTITION BY ticker, entry_date ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), entry_price)) AND atr IS NOT NULL THEN close - 3 * atr END AS lvl FROM p)) GROUP BY 1, 2) a
 ON a.ticker = c.ticker AND a.entry_date = c.entry_date""", d="fixed_252 fixed_126 atr_trail", i="n")
def _(spark, sf):
    return exits.exit_styles(es.entry_paths(star.bars(spark, sf)))


def _entry_ablation_sql(h: int) -> str:
    return f"""
SELECT d.disabled, avg(f) FILTER (WHERE c >= CAST(0.65 AS DOUBLE)) AS high_mean, avg(f) FILTER (WHERE c < CAST(0.35 AS DOUBLE)) AS low_mean, count(*) FILTER (WHERE c >= CAST(0.65 AS DOUBLE)) AS high_n, count(*) FILTER (WHERE c < CAST(0.35 AS DOUBLE)) AS low_n FROM (
 SELECT d.disabled, f, CAST(0.3 AS DOUBLE) * CASE WHEN d.disabled = 'trend' THEN 0.5 ELSE trend_score END + CAST(0.3 AS DOUBLE) * CASE WHEN d.disabled = 'momentum' THEN 0.5 ELSE momentum_score END
   + CAST(0.2 AS DOUBLE) * CASE WHEN d.disabled = 'volume' THEN 0.5 ELSE volume_score END + CAST(0.2 AS DOUBLE) * CASE WHEN d.disabled = 'rsi' THEN 0.5 ELSE rsi_score END AS c
 FROM (SELECT *, lead(close, {h}) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS f FROM even_entry), (VALUES ('none'), ('trend'), ('momentum'), ('volume'), ('rsi')) d(disabled) WHERE f IS NOT NULL AND n_bars >= 200) d GROUP BY d.disabled"""


def _entry_ablation(spark, sf, h):
    rows = ev.forward_returns(ind.entry_scores(has_history(star.bars(spark, sf), 200)), [h])
    return st.ablation(rows, tiers.ENTRY_WEIGHTS, f"fwd_{h}", 0.65, 0.35, use_gate=False)


@query("agg_03_entry_ablation", _entry_ablation_sql(63), d="high_mean low_mean", i="high_n low_n")
def _(spark, sf):
    return _entry_ablation(spark, sf, 63)


ABL_252 = _entry_ablation_sql(252)


@query("agg_38_spread_deltas", f"WITH a AS ({ABL_252}) SELECT a.*, high_mean - low_mean AS spread, high_mean - low_mean - (SELECT high_mean - low_mean FROM a WHERE disabled = 'none') AS delta FROM a",
       d="high_mean low_mean spread delta", i="high_n low_n")
def _(spark, sf):
    return st.spread_deltas(_entry_ablation(spark, sf, 252))
