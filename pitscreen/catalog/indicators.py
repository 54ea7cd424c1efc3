"""Indicators and scoring projections over derived bars."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tiers
from ..operators import indicators as ind
from ..plans import event_study
from ..sources import star
from .base import query
from .ctes import W, roll, ret

KEEP = ["ticker", "date"]


@query("ind_01_sma", f"SELECT ticker, date, {roll('avg', 'close', 50)} AS sma_50, {roll('avg', 'close', 200)} AS sma_200, {roll('avg', 'volume', 10)} AS vol_10 FROM bars",
       d="sma_50 sma_200 vol_10", digits=7)
def _(spark, sf):
    df = ind.sma(ind.sma(star.bars(spark, sf), 50), 200)
    return ind.sma(df, 10, "volume", name="vol_10").select(*KEEP, "sma_50", "sma_200", "vol_10")


@query("ind_02_high_52w", f"SELECT ticker, date, {roll('max', 'close', 252)} AS high_52w FROM bars", d="high_52w")
def _(spark, sf):
    return ind.rolling_high(star.bars(spark, sf)).select(*KEEP, "high_52w")


@query("ind_03_drawdown", "SELECT ticker, date, drawdown_52w FROM ind2", d="drawdown_52w")
def _(spark, sf):
    return ind.drawdown(ind.rolling_high(star.bars(spark, sf))).select(*KEEP, "drawdown_52w")


@query("ind_04_bar_return", f"SELECT ticker, date, {ret(5)} AS ret_5, {ret(40)} AS ret_40 FROM bars", d="ret_5 ret_40")
def _(spark, sf):
    return ind.bar_return(ind.bar_return(star.bars(spark, sf), 5), 40).select(*KEEP, "ret_5", "ret_40")


@query("ind_05_rsi", "SELECT i.ticker, i.date, r.rsi_14 FROM ind i JOIN rsi_rows r USING (ticker, pos)", d="rsi_14")
def _(spark, sf):
    return ind.rsi(star.bars(spark, sf)).select(*KEEP, "rsi_14")


EMA_SQL = """
SELECT ticker, date, list_reduce(list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       lambda a, x: CAST(6 AS DOUBLE) / 7 * a + CAST(1 AS DOUBLE) / 7 * x) AS ema FROM bars"""


@query("ind_06_ema", EMA_SQL, d="ema")
def _(spark, sf):
    return ind.ema(star.bars(spark, sf), 1 / 7, {"ema": "close"}).select(*KEEP, "ema")


@query("udf_04_ema_grouped_map", EMA_SQL, d="ema")
def _(spark, sf):
    return ind.ema_grouped(star.bars(spark, sf), 1 / 7).select(*KEEP, "ema")


@query("ind_07_atr", "SELECT ticker, date, true_range, atr_14 FROM ind2", d="true_range atr_14")
def _(spark, sf):
    return ind.atr(ind.true_range(star.bars(spark, sf)).withColumn("tr", F.col("true_range"))).select(
        *KEEP, F.col("tr").alias("true_range"), "atr_14")


@query("ind_08_volume_ratio", "SELECT ticker, date, vol_ratio FROM ind", d="vol_ratio")
def _(spark, sf):
    return ind.volume_ratio(star.bars(spark, sf)).select(*KEEP, "vol_ratio")


@query("ind_09_sma_slope", "SELECT ticker, date, sma_rising FROM even")
def _(spark, sf):
    return ind.sma_slope(ind.sma(star.bars(spark, sf), 200)).select(*KEEP, "sma_rising")


@query("ind_10_crossed_above", "SELECT ticker, date, crossed_up FROM ind2")
def _(spark, sf):
    return ind.crossed_above(ind.sma(star.bars(spark, sf), 50)).select(*KEEP, "crossed_up")


def _scored(spark, sf, *cols):
    return ind.recovery_scores(star.bars(spark, sf)).select(*KEEP, *cols)


@query("scr_01_dip_tiers", "SELECT ticker, date, dip_score FROM scored_all", d="dip_score")
def _(spark, sf):
    return _scored(spark, sf, "dip_score")


@query("scr_02_dip_bands", """
SELECT b.band, count(*) AS known, sum(CASE WHEN drawdown_52w BETWEEN lo AND hi THEN 1 ELSE 0 END) AS inside
FROM ind2, (VALUES ('30-50', CAST(0.3 AS DOUBLE), CAST(0.5 AS DOUBLE)), ('40-60', CAST(0.4 AS DOUBLE), CAST(0.6 AS DOUBLE)), ('50-70', CAST(0.5 AS DOUBLE), CAST(0.7 AS DOUBLE))) b(band, lo, hi)
WHERE drawdown_52w IS NOT NULL GROUP BY b.band""", i="known inside")
def _(spark, sf):
    df = ind.drawdown(ind.rolling_high(star.bars(spark, sf)))
    bands = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(a).alias("lo"), F.lit(b).alias("hi"))
                      for n, a, b in (("30-50", 0.3, 0.5), ("40-60", 0.4, 0.6), ("50-70", 0.5, 0.7))])
    df = df.withColumn("_b", F.explode(bands)).withColumn("score", tiers.band_score(F.col("drawdown_52w"), F.col("_b.lo"), F.col("_b.hi")))
    return df.groupBy(F.col("_b.band").alias("band")).agg(F.count("score").alias("known"), F.sum("score").cast("bigint").alias("inside")).where("known > 0")


@query("scr_03_reversal", "SELECT ticker, date, recovery_score FROM scored_all", d="recovery_score")
def _(spark, sf):
    return _scored(spark, sf, "recovery_score")


@query("scr_04_momentum", "SELECT ticker, date, momentum_score FROM scored_all", d="momentum_score")
def _(spark, sf):
    return _scored(spark, sf, "momentum_score")


@query("scr_05_volume_tiers", "SELECT ticker, date, volume_score FROM scored_all", d="volume_score")
def _(spark, sf):
    return _scored(spark, sf, "volume_score")


@query("scr_06_trend_tiers", """
SELECT ticker, date, CAST(CASE WHEN close <= sma_50 THEN 0 WHEN close > sma_50 AND close <= sma_200 THEN 0.4 WHEN close > sma_200 AND NOT sma_rising THEN 0.7
       WHEN close > sma_200 AND sma_rising THEN 1 END AS DOUBLE) AS trend_score FROM ind2""", d="trend_score")
def _(spark, sf):
    df = ind.sma_slope(ind.sma(ind.sma(star.bars(spark, sf), 50), 200))
    return df.select(*KEEP, tiers.trend_score(F.col("close"), F.col("sma_50"), F.col("sma_200"), F.col("sma_rising"),
                                              ~F.col("sma_rising")).alias("trend_score"))


@query("scr_07_rsi_tiers", """
SELECT i.ticker, i.date, CAST(CASE WHEN rsi_14 < 30 THEN 1 WHEN rsi_14 < 45 THEN 0.8 WHEN rsi_14 < 60 THEN 0.6 WHEN rsi_14 < 70 THEN 0.3 WHEN rsi_14 >= 70 THEN 0 END AS DOUBLE) AS rsi_score
FROM ind i JOIN rsi_rows r USING (ticker, pos)""", d="rsi_score")
def _(spark, sf):
    df = ind.rsi(star.bars(spark, sf))
    return df.select(*KEEP, tiers.rsi_score(F.col("rsi_14")).alias("rsi_score"))


@query("scr_08_recovery_composite", "SELECT ticker, date, composite_score FROM scored_all", d="composite_score")
def _(spark, sf):
    return _scored(spark, sf, "composite_score")


@query("scr_09_entry_composite", "SELECT ticker, date, rsi_14, trend_score, rsi_score, composite_score FROM entry_all",
       d="rsi_14 trend_score rsi_score composite_score")
def _(spark, sf):
    return ind.entry_scores(star.bars(spark, sf)).select(*KEEP, "rsi_14", "trend_score", "rsi_score", "composite_score")


@query("scr_10_ablated_composite", """
SELECT d.disabled, count(c) AS n, sum(c) AS total FROM (
  SELECT d.disabled, CAST(0.5 AS DOUBLE) * CASE WHEN d.disabled = 'dip' THEN 0.5 ELSE dip_score END + CAST(0.3 AS DOUBLE) * CASE WHEN d.disabled = 'momentum' THEN 0.5 ELSE momentum_score END
         + CAST(0.2 AS DOUBLE) * CASE WHEN d.disabled = 'volume' THEN 0.5 ELSE volume_score END AS c
  FROM scored_all, (VALUES ('none'), ('dip'), ('momentum'), ('volume')) d(disabled)) d GROUP BY d.disabled""", d="total", i="n")
def _(spark, sf):
    df = ind.recovery_scores(star.bars(spark, sf))
    parts = {k: F.col(f"{k}_score") for k in tiers.RECOVERY_WEIGHTS}
    df = df.withColumn("disabled", F.explode(F.array(*[F.lit(x) for x in ("none", *parts)])))
    df = df.withColumn("c", tiers.ablated_sum(parts, tiers.RECOVERY_WEIGHTS, F.col("disabled")))
    return df.groupBy("disabled").agg(F.count("c").alias("n"), F.sum("c").alias("total"))


@query("scr_11_entry_signal", """
SELECT ticker, date, CASE WHEN composite_score IS NULL THEN 'INSUFFICIENT_DATA' WHEN composite_score >= CAST(0.65 AS DOUBLE) THEN 'BUY' ELSE 'WAIT' END AS signal FROM entry_all""")
def _(spark, sf):
    return ind.entry_scores(star.bars(spark, sf)).select(*KEEP, "signal")


@query("scr_12_recovery_signal", """
SELECT ticker, date, CASE WHEN composite_score IS NULL THEN 'INSUFFICIENT_DATA' WHEN NOT coalesce(gate, FALSE) THEN 'SKIP'
       WHEN composite_score >= CAST(0.6 AS DOUBLE) THEN 'BUY' ELSE 'WAIT' END AS signal
FROM scored s LEFT JOIN (SELECT ticker AS gt, year AS gy, gate FROM gates) ON gt = ticker AND gy = year(date)""")
def _(spark, sf):
    bars = star.bars(spark, sf)
    rows = ind.recovery_scores(event_study.has_history(bars, 252))
    rows = event_study.with_yearly_gate(rows, event_study.yearly_gates(bars, star.facts(spark, sf)))
    return rows.select(*KEEP, tiers.recovery_signal(F.col("composite_score"), F.col("gate")).alias("signal"))


@query("scr_13_quality_gate", "SELECT ticker, year, gate FROM gates", i="year")
def _(spark, sf):
    return event_study.yearly_gates(star.bars(spark, sf), star.facts(spark, sf))


@query("scr_14_score_bucket", """
SELECT CASE WHEN composite_score < CAST(0.65 AS DOUBLE) THEN '0.60-0.65' WHEN composite_score < CAST(0.70 AS DOUBLE) THEN '0.65-0.70'
            WHEN composite_score < CAST(0.75 AS DOUBLE) THEN '0.70-0.75' ELSE '0.75-1.00' END AS bucket, count(*) AS n
FROM scored_all WHERE composite_score >= CAST(0.6 AS DOUBLE) GROUP BY 1""", i="n")
def _(spark, sf):
    df = ind.recovery_scores(star.bars(spark, sf)).where(F.col("composite_score") >= 0.60)
    return df.groupBy(tiers.score_bucket(F.col("composite_score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("scr_15_size_weight", """
SELECT ticker, date, CAST(CASE WHEN composite_score >= CAST(0.70 AS DOUBLE) THEN 0.12 ELSE 0.10 END AS DOUBLE) AS weight FROM crossed""", d="weight")
def _(spark, sf):
    return event_study.score_crossings(star.bars(spark, sf)).select(*KEEP, tiers.size_weight(F.col("composite_score")).alias("weight"))


@query("scr_16_gate_explanation", """
SELECT ticker, as_of, coalesce(revenue_growth_yoy > 0, FALSE) AS growth_ok, coalesce(debt_to_equity < 3, FALSE) AS debt_ok, coalesce(net_margin > 0, FALSE) AS margin_ok FROM snap_year""")
def _(spark, sf):
    from ..operators.fundamentals import snapshots_asof, year_end_requests
    snaps = snapshots_asof(year_end_requests(star.bars(spark, sf)), star.facts(spark, sf))
    parts = tiers.gate_explanation(F.col("revenue_growth_yoy"), F.col("debt_to_equity"), F.col("net_margin"))
    return snaps.select("ticker", "as_of", *[c.alias(n) for n, c in parts.items()])


@query("udf_01_pluggable_dip", """
SELECT ticker, date, CAST(0.5 AS DOUBLE) * CASE WHEN drawdown_52w IS NOT NULL THEN CAST(drawdown_52w BETWEEN CAST(0.4 AS DOUBLE) AND CAST(0.6 AS DOUBLE) AS INT) END
       + CAST(0.3 AS DOUBLE) * momentum_score + CAST(0.2 AS DOUBLE) * volume_score AS composite_score FROM scored_all""", d="composite_score")
def _(spark, sf):
    only_deep = lambda dd: tiers.band_score(dd, 0.40, 0.60)
    return ind.recovery_scores(star.bars(spark, sf), dip=only_deep).select(*KEEP, "composite_score")
