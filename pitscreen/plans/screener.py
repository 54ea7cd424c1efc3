"""The daily job: universe, scores, gate, label, veto, ranking."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tiers
from ..operators import indicators, universe, veto
from ..operators.fundamentals import companies_on
from ..operators.windows import by_bar, has_history
from .event_study import gate_of

ROW = ["as_of", "ticker", "current_price", "high_52w", "drawdown_pct", "dip_score", "momentum_score", "volume_score",
       "composite_score", "gate", "signal", "veto_reason"]
SCORED = ["ticker", "date", "close", "high_52w", "drawdown_52w", "dip_score", "momentum_score", "volume_score", "composite_score"]


def latest_scored(bars: DataFrame, as_of: Column, min_bars: int = 252) -> DataFrame:
    """The last scored bar before `as_of` of every instrument with enough history."""
    scored = indicators.recovery_scores(has_history(bars.where(F.col("date") < as_of), min_bars))
    return scored.withColumn("_next", F.lead("date").over(by_bar())).where(F.col("_next").isNull()).drop("_next")


def prices_on(bars: DataFrame, as_of: Column, min_bars: int = 252) -> DataFrame:
    """(ticker, raw_close, last) of one day: the last known close up to it, and the last scored bar before it as a
    struct, NULL without enough history. One scan; the aggregate keeps the partitioning of the score windows."""
    before = F.col("date") < as_of
    scored = indicators.recovery_scores(bars.where(F.col("date") <= as_of))
    fields = [c for c in SCORED if c != "ticker"]
    last = F.max_by(F.struct(*fields), F.when(before, F.col("date")))
    return scored.groupBy("ticker").agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("raw_close"),
                                        F.when(F.count_if(before) >= min_bars, last).alias("last"))


def screen(bars: DataFrame, facts: DataFrame, filings: DataFrame, membership: DataFrame, as_of: Column, n: int = 100,
           flags: DataFrame | None = None) -> DataFrame:
    """One row per screened ticker with BUY / WATCH / SKIP / VETO / INSUFFICIENT_DATA.

    Each source is read once and reduced to one row per ticker by the day: bars to close and scores, facts to shares
    and ratios, filings to what may veto. Raw records are many times the bars, so scoring every member's
    bars costs less than a second scan for the few that are kept.
    """
    members = universe.members_on(membership, as_of)
    rows = (members.join(prices_on(bars, as_of), "ticker").join(companies_on(facts, as_of), "ticker")
            .withColumns({"as_of": as_of, "mcap": universe.market_cap()}))
    rows = gate_of(universe.top_by_cap(rows, n).where(F.col("last").isNotNull())).select("ticker", "as_of", "gate", "last.*")
    rows = rows.withColumns({
        "current_price": F.col("close"), "high_52w": F.coalesce("high_52w", "close"),
        "drawdown_pct": F.coalesce("drawdown_52w", F.lit(0.0)),
        "signal": tiers.recovery_signal(F.col("composite_score"), F.col("gate"), below="WATCH")})
    return veto.veto_buys(rows, filings, rule=veto.veto_on, day=as_of, flags=flags).select(*ROW)


def ranking(rows: DataFrame) -> DataFrame:
    """Sink order: unscored last, best first."""
    return rows.orderBy(F.desc_nulls_last("composite_score"), "ticker")


def split_signals(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("signal") == "BUY"), rows.where(F.col("signal") == "VETO")
