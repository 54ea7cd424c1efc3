"""Event study: score once, attach gate, regime and outcomes, then summarise."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import tiers
from ..functions.guards import holds
from ..operators import events, exits, indicators
from ..operators.fundamentals import snapshots_asof, year_end_requests
from ..operators.ranking import quantile_summary
from ..operators.windows import bar_index, has_history
from ..session import clustered
from ..sources.star import benchmark


def gate_of(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("gate", tiers.quality_gate(
        F.col("revenue_growth_yoy"), F.col("debt_to_equity"), F.col("net_margin")))


def yearly_gates(bars: DataFrame, facts: DataFrame) -> DataFrame:
    """(ticker, year, gate): the gate of 31 December of each year. Looks ahead within
    the year by design; use `entry_gates` for a point-in-time gate."""
    return gate_of(snapshots_asof(year_end_requests(bars), facts)).select("ticker", "year", "gate")


def with_yearly_gate(rows: DataFrame, gates: DataFrame) -> DataFrame:
    """Attach the gate of the row's year. A ticker's few gates are packed into one map, so the
    join key is the ticker alone and the rows keep the partitioning of their windows."""
    packed = gates.groupBy("ticker").agg(
        F.map_from_entries(F.collect_list(F.struct("year", "gate"))).alias("_gates"))
    return rows.join(packed, "ticker", "left").withColumn(
        "gate", F.try_element_at("_gates", F.year("date"))).drop("_gates")


def entry_gates(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Point-in-time gate of each candidate (ticker, date); requests are made only for the candidates."""
    requests = candidates.select("ticker", F.col("date").alias("as_of")).distinct()
    gates = gate_of(snapshots_asof(requests, facts)).select("ticker", F.col("as_of").alias("date"), "gate")
    return candidates.join(gates, ["ticker", "date"], "left")


def study_rows(bars: DataFrame, facts: DataFrame, horizons: Sequence[int] = events.HORIZONS,
               span: int = events.HOLD_BARS, min_bars: int = 252, drawdown: bool = True) -> DataFrame:
    """Scored bars with forward outcomes, yearly gate and market regime. The bars are stored once by
    instrument; scoring, outcomes and the gate then share that layout without another exchange.
    Outcomes come first, while rows are narrow."""
    bars = clustered(bars)
    rows = has_history(bars, min_bars)
    if drawdown:
        rows = events.forward_drawdown(rows, span)
    rows = events.forward_returns(rows, horizons)
    rows = events.touch_flags(events.adverse_excursion(rows, span))
    rows = indicators.recovery_scores(rows.withColumn("pos", bar_index()))
    rows = with_yearly_gate(rows, yearly_gates(bars, facts))
    return events.label_by_date(rows, events.slope_regime(benchmark(bars)), "regime")


def buy_crossings(bars: DataFrame, facts: DataFrame, threshold: float = tiers.RECOVERY_BUY) -> DataFrame:
    """Scored bars whose gated score crosses into the buy zone, with `pos`."""
    rows = indicators.recovery_scores(has_history(bars, 252)).withColumn("pos", bar_index())
    rows = with_yearly_gate(rows, yearly_gates(bars, facts))
    rows = events.crossings(rows, (F.col("composite_score") >= threshold) & F.col("gate"))
    return rows.where("crossed").drop("crossed")


def score_crossings(bars: DataFrame, threshold: float = tiers.RECOVERY_BUY) -> DataFrame:
    """Crossings by score alone."""
    rows = indicators.recovery_scores(has_history(bars, 252)).withColumn("pos", bar_index())
    return events.crossings(rows, F.col("composite_score") >= threshold).where("crossed").drop("crossed")


def crossing_paths(bars: DataFrame, threshold: float = tiers.RECOVERY_BUY, horizon: int = events.HOLD_BARS,
                   full_only: bool = True) -> DataFrame:
    """Forward path array of every score crossing. Scores are stored once; entries and price series are both read from them."""
    rows = indicators.recovery_scores(has_history(bars, 252)).withColumn("pos", bar_index())
    rows = events.crossings(rows, F.col("composite_score") >= threshold).select("ticker", "date", "close", "atr_14", "composite_score", "pos", "crossed")
    rows = clustered(rows)
    return exits.path_arrays(rows.where("crossed"), rows, horizon, full_only)


def entry_paths(bars: DataFrame, threshold: float = tiers.ENTRY_BUY, horizon: int = events.HOLD_BARS, full_only: bool = True) -> DataFrame:
    """Forward path array of every bar whose entry score is in the buy zone."""
    rows = indicators.entry_scores(has_history(bars, 200)).withColumn("pos", bar_index())
    if "atr_14" not in rows.columns:
        rows = indicators.atr(indicators.true_range(rows).withColumn("tr", F.col("true_range")))
    rows = clustered(rows.select("ticker", "date", "close", "atr_14", "composite_score", "pos"))
    return exits.path_arrays(rows.where(F.col("composite_score") >= threshold), rows, horizon, full_only)


def high_rows(rows: DataFrame, threshold: float = tiers.RECOVERY_BUY) -> DataFrame:
    return rows.where(holds(F.col("gate")) & (F.col("composite_score") >= threshold))


def entry_study_rows(bars: DataFrame, span: int = events.HOLD_BARS) -> DataFrame:
    """The same for the entry score, which has no gate."""
    rows = indicators.entry_scores(has_history(bars, 200))
    rows = events.forward_drawdown(events.forward_returns(rows, (126, 252)), span)
    rows = rows.withColumns({"pos": bar_index(), "gate": F.lit(True)})
    return events.label_by_date(rows, events.slope_regime(benchmark(bars)), "regime")


def crossing_trades(bars: DataFrame, hold: int = events.HOLD_BARS, threshold: float = tiers.RECOVERY_BUY) -> DataFrame:
    """The trade of every score crossing, filled at the next open, and beside it (same_close_*) at the same close.

    Scores, crossings and outcomes are windows over one partitioning and order, so bars are scanned and sorted once;
    rows are narrowed to the crossings at the end.
    """
    rows = has_history(bars, 252)
    rows = events.fixed_hold_trades(rows, hold, "same_close").withColumnsRenamed({n: f"same_close_{n}" for n in events.TRADE})
    rows = indicators.recovery_scores(events.fixed_hold_trades(rows, hold)).withColumn("pos", bar_index())
    rows = events.crossings(rows, F.col("composite_score") >= threshold).where("crossed")
    return rows.select("ticker", "date", "pos", "close", "composite_score", "drawdown_52w", *events.TRADE, *[f"same_close_{n}" for n in events.TRADE])


#: The published in-sample means that out-of-sample results are held against.
IN_SAMPLE_RANDOM, IN_SAMPLE_HIGH = 0.223, 0.492


def audit_trades(bars: DataFrame, facts: DataFrame, start: str, hold: int = events.HOLD_BARS) -> DataFrame:
    """Out-of-sample audit: gated crossings, thinned to one per holding period over the whole history, then the trades
    that start in the audit window. Scores, gate and outcomes ride on one pass over the bars."""
    rows = events.fixed_hold_trades(has_history(bars, 252), hold, "same_close")
    rows = indicators.recovery_scores(rows).withColumn("pos", bar_index())
    rows = with_yearly_gate(rows, yearly_gates(bars, facts))
    rows = events.crossings(rows, (F.col("composite_score") >= tiers.RECOVERY_BUY) & F.col("gate")).where("crossed")
    rows = rows.select("ticker", "date", "pos", "composite_score", "drawdown_52w", *events.TRADE)
    return events.suppress_within(rows, hold).where(F.col("date") >= F.lit(start).cast("date"))


def audit_report(trades: DataFrame, enough: int = 5) -> DataFrame:
    """Per status (CLOSED, OPEN): count, mean, median, share of winners, best and worst trade, the in-sample baselines and
    the distance to them; on every row the verdict of the closed ones: TOO FEW below `enough`, else SUPPORTS or CONTRADICTS."""
    r = F.col("trade_return")
    known = trades.where(r.isNotNull())
    mark = F.struct(r.alias("ret"), "ticker", "date")
    sums = {"n": F.lit(1).cast("long"), "_sum": r, "_won": (r > 0).cast("double")}
    found = quantile_summary(known, ["status"], "trade_return", {"median_return": 0.5}, sums, {"_b": (mark, "max"), "_w": (mark, "min")})
    out = found.withColumns({"mean_return": F.col("_sum") / F.col("n"), "win_rate": F.col("_won") / F.col("n")})
    side = lambda c, name: [F.col(f"{c}.ticker").alias(f"{name}_ticker"), F.col(f"{c}.date").alias(f"{name}_date"), F.col(f"{c}.ret").alias(f"{name}_return")]
    out = out.select("status", "n", "mean_return", "median_return", "win_rate", *side("_b", "best"), *side("_w", "worst"))
    out = out.withColumns({"random_baseline": F.lit(IN_SAMPLE_RANDOM), "high_baseline": F.lit(IN_SAMPLE_HIGH),
                           "vs_random": F.col("mean_return") - IN_SAMPLE_RANDOM, "vs_high": F.col("mean_return") - IN_SAMPLE_HIGH})
    both = Window.partitionBy(F.lit(1))  # two rows
    closed = lambda c: F.max(F.when(F.col("status") == "CLOSED", F.col(c))).over(both)
    return out.withColumn("verdict", F.when(F.coalesce(closed("n"), F.lit(0)) < enough, "TOO FEW")
                          .when(closed("mean_return") > IN_SAMPLE_RANDOM, "SUPPORTS").otherwise("CONTRADICTS"))
