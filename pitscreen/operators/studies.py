"""Summary tables over study rows and trades.

Study rows carry composite_score, gate, regime, fwd_*, mae, max_dd. Reports are
one pass of partial aggregation; order statistics go through `exact_quantiles`.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import tiers
from ..functions.guards import holds
from .events import hash_sample
from .ranking import exact_quantiles, quantile_summary

# Drawdown bands of the sensitivity study.
DIP_BANDS = [(0.10, 0.20), (0.20, 0.30), (0.30, 0.40), (0.40, 0.50), (0.30, 0.50), (0.20, 0.50), (0.20, 0.40),
             (0.30, 0.60), (0.40, 0.60), (0.50, 0.70)]
RANDOM_MEAN = 0.223
BASELINE_SPREAD = 0.122


def share(cond: Column) -> Column:
    """Share of TRUE among rows where the condition is known."""
    return F.avg(cond.cast("double"))


def with_buckets(rows: DataFrame, high: float = tiers.RECOVERY_BUY, low: float = tiers.RECOVERY_LOW,
                 use_gate: bool = True, one_in: int = 10) -> DataFrame:
    """One row per bucket membership; RANDOM overlaps the other two."""
    comp = F.col("composite_score")
    gate = holds(F.col("gate")) if use_gate else F.lit(True)
    tags = F.array(F.when(gate & holds(comp >= high), F.lit("HIGH")), F.when(gate & holds(comp < low), F.lit("LOW")),
                   F.when(hash_sample(F.col("ticker"), F.col("date"), one_in=one_in), F.lit("RANDOM")))
    return rows.withColumn("bucket", F.explode(F.array_compact(tags)))


def bucket_stats(buckets: DataFrame, horizons: Sequence[int], main: int, by: Sequence[str] = ("bucket",)) -> DataFrame:
    main_col = F.col(f"fwd_{main}")
    return buckets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"fwd_{h}").alias(f"mean_{h}") for h in horizons],
        share(main_col > 0).alias("pct_positive"), F.avg("max_dd").alias("mean_max_dd"))


def _mean(total: str, count: str) -> Column:
    return F.try_divide(F.col(total), F.col(count))


def _counted(name: str, value: Column) -> dict[str, Column]:
    """Sum and number of the known values, from which a mean follows."""
    return {f"_s_{name}": value.cast("double"), f"_n_{name}": value.isNotNull().cast("long")}


def bucket_report(buckets: DataFrame, horizons: Sequence[int], main: int) -> DataFrame:
    """`bucket_stats` plus the exact median of the main horizon, from one aggregate over the rows."""
    ret = F.col(f"fwd_{main}")
    sums = {"n": F.lit(1).cast("long"), **_counted("pos", (ret > 0).cast("double")), **_counted("dd", F.col("max_dd"))}
    for h in horizons:
        sums |= _counted(str(h), F.col(f"fwd_{h}"))
    out = quantile_summary(buckets, ["bucket"], f"fwd_{main}", {"median": 0.5}, sums)
    return out.select("bucket", "n", *[_mean(f"_s_{h}", f"_n_{h}").alias(f"mean_{h}") for h in horizons],
                      _mean("_s_pos", "_n_pos").alias("pct_positive"), _mean("_s_dd", "_n_dd").alias("mean_max_dd"), "median")


def spread_criteria(stats: DataFrame, main: int, min_spread: float = 0.03, min_gap: float = 0.05) -> DataFrame:
    """HIGH against RANDOM in one row, with the two pass criteria."""
    pick = lambda b, c: F.max(F.when(F.col("bucket") == b, F.col(c)))
    out = stats.agg(*[pick(b, c).alias(f"{b.lower()}_{n}") for b in ("HIGH", "RANDOM")
                      for c, n in ((f"mean_{main}", "mean"), ("pct_positive", "pct"))])
    out = out.withColumns({"spread": F.col("high_mean") - F.col("random_mean"),
                           "gap": F.col("high_pct") - F.col("random_pct")})
    return out.withColumns({"pass_spread": F.col("spread") > min_spread, "pass_gap": F.col("gap") > min_gap})


def ablation(rows: DataFrame, weights: Mapping[str, float], outcome: str, high: float, low: float,
             use_gate: bool = True) -> DataFrame:
    """HIGH and LOW means with one component neutralised at a time ('none' is the full score)."""
    disabled = F.explode(F.array(*[F.lit(k) for k in ("none", *weights)])).alias("disabled")
    keep = F.col(outcome).isNotNull()
    if use_gate:
        keep = keep & holds(F.col("gate"))
    parts = {k: F.col(f"{k}_score") for k in weights}
    variants = rows.where(keep).select(outcome, *[f"{k}_score" for k in weights], disabled).withColumn(
        "_comp", tiers.ablated_sum(parts, weights, F.col("disabled")))
    ret = F.col(outcome)
    is_high, is_low = F.col("_comp") >= high, F.col("_comp") < low
    return variants.groupBy("disabled").agg(
        F.avg(F.when(is_high, ret)).alias("high_mean"), F.avg(F.when(is_low, ret)).alias("low_mean"),
        F.count_if(is_high).alias("high_n"), F.count_if(is_low).alias("low_n"))


def spread_deltas(ablated: DataFrame) -> DataFrame:
    """HIGH-LOW spread per ablation and its change against the full score (a handful of rows)."""
    df = ablated.withColumns({"spread": F.col("high_mean") - F.col("low_mean"), "_all": F.lit(1)})
    base = F.max(F.when(F.col("disabled") == "none", F.col("spread"))).over(Window.partitionBy("_all"))
    return df.withColumn("delta", F.col("spread") - base).drop("_all")


def regime_breakdown(rows: DataFrame, outcome: str) -> DataFrame:
    ret = F.col(outcome)
    return rows.where(F.col("regime").isin("bull", "bear")).groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean"), share(ret > 0).alias("pct_positive"))


def regime_capture(buckets: DataFrame, outcome: str) -> DataFrame:
    """Per bucket, each regime and 'all', with the gap to RANDOM in the same regime."""
    df = buckets.where(F.col("regime").isin("bull", "bear")).groupingSets(
        [["bucket", "regime"], ["bucket"]], "bucket", "regime").agg(
        F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean"), F.grouping("regime").alias("_g"))
    df = df.select("bucket", F.when(F.col("_g") == 1, "all").otherwise(F.col("regime")).alias("regime"), "n", "mean")
    base = df.where(F.col("bucket") == "RANDOM").select("regime", F.col("mean").alias("_base"))
    return df.join(base, "regime", "left").withColumn("gap_to_random", F.col("mean") - F.col("_base")).drop("_base")


def drawdown_quantiles(high: DataFrame) -> DataFrame:
    return exact_quantiles(high, [], "mae", {"p10": 0.10, "p50": 0.50, "p75": 0.75, "p90": 0.90})


def touch_groups(high: DataFrame, outcome: str, levels: Sequence[int] = (10, 15, 20)) -> DataFrame:
    """Entries that did and did not fall by each level: count, share and mean outcome."""
    tags = F.array(*[F.struct(F.lit(n).cast("bigint").alias("level"), F.col(f"touched_{n}").alias("touched")) for n in levels])
    long = high.select(outcome, F.explode(tags).alias("_t")).select(outcome, "_t.*")
    out = long.groupBy("level", "touched").agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean"))
    w = Window.partitionBy("level")  # two rows per level
    return out.withColumn("pct", F.col("n") / F.sum("n").over(w))


def dropped_by_unknown_gate(rows: DataFrame, high: float = tiers.RECOVERY_BUY) -> DataFrame:
    return rows.agg(F.count_if(F.col("gate").isNull() & (F.col("composite_score") >= high)).alias("dropped"))


def band_entries(rows: DataFrame, bands: Sequence[tuple[float, float]] = DIP_BANDS, high: float = tiers.RECOVERY_BUY) -> DataFrame:
    """Gated rows that reach the buy score under each drawdown band (10 bands: a fixed fan-out, filtered at once)."""
    grid = F.array(*[F.struct(F.lit(f"{round(lo * 100)}-{round(hi * 100)}%").alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                     for lo, hi in bands])
    df = rows.where(holds(F.col("gate"))).withColumn("_b", F.explode(grid))
    w = tiers.RECOVERY_WEIGHTS
    comp = tiers.weighted_sum({"dip": tiers.band_score(F.col("drawdown_52w"), F.col("_b.lo"), F.col("_b.hi")),
                               "momentum": F.col("momentum_score"), "volume": F.col("volume_score")}, w)
    return df.withColumn("band", F.col("_b.band")).where(comp >= high).drop("_b")


def band_sensitivity(entries: DataFrame, outcome: str, mae: str, random_mean: float = RANDOM_MEAN, baseline_spread: float = BASELINE_SPREAD,
                     min_n: int = 200) -> DataFrame:
    """Outcome table per drawdown band; bands with fewer than `min_n` entries keep only their count."""
    r = F.col(outcome)
    parts = {"mean": r, "pct_pos": (r > 0).cast("double"), "pct_loss": (r < 0).cast("double"), "pct_hit20": (F.col(mae) <= -0.20).cast("double"),
             "bull": F.when(F.col("regime") == "bull", r), "bear": F.when(F.col("regime") == "bear", r)}
    sums = {"n": F.lit(1).cast("long")}
    for name, c in parts.items():
        sums |= _counted(name, c)
    cuts = ("p10", "median", "p90")
    df = quantile_summary(entries, ["band"], outcome, dict(zip(cuts, (0.10, 0.50, 0.90))), sums)
    df = df.select("band", "n", *[_mean(f"_s_{name}", f"_n_{name}").alias(name) for name in parts], *cuts)
    df = df.withColumn("spread", F.col("mean") - random_mean)
    df = df.withColumn("ux", F.col("spread") / baseline_spread * (1 - F.col("pct_hit20")) * (1 - F.col("pct_loss")))
    few = (F.col("n") < min_n) | F.col("mean").isNull()
    hidden = [c for c in df.columns if c not in ("band", "n")]
    return df.withColumn("too_few", few).withColumns({c: F.when(~F.col("too_few"), F.col(c)) for c in hidden})


def band_findings(table: DataFrame, min_n: int = 500, floor: float = 0.08, current: str = "30-50%") -> DataFrame:
    """Best band by spread, safest band above the floor, best band per regime and the robustness counts (one row)."""
    ok = (~F.col("too_few")) & (F.col("n") >= min_n)
    spread, safe = F.col("spread"), F.col("spread") >= floor
    best = lambda col, cond: F.max_by("band", F.when(cond, F.struct(col, F.col("band"))))
    out = table.agg(
        best(spread, ok).alias("best_band"), F.max(F.when(ok, spread)).alias("best_spread"),
        F.min_by("band", F.when(ok & safe, F.struct("pct_hit20", "band"))).alias("safest_band"),
        best(F.coalesce("bull", F.lit(-99.0)), ok).alias("best_bull"), best(F.coalesce("bear", F.lit(-99.0)), ok).alias("best_bear"),
        F.max(F.when((F.col("band") == current) & ~F.col("too_few"), spread)).alias("current_spread"),
        F.count_if(ok).alias("eligible"), F.count_if(ok & safe).alias("above_floor"), F.count_if(ok & (spread >= 0)).alias("positive"))
    return out.withColumns({
        "revise": holds((F.col("best_spread") - F.col("current_spread") > 0.02) & (F.col("best_band") != current)),
        "verdict": F.when(F.col("above_floor") >= 4, "ROBUST").when(F.col("above_floor") >= 2, "MODERATELY ROBUST").otherwise("FRAGILE")})


def per_year(stats: DataFrame, bars: DataFrame, count: str, name: str) -> DataFrame:
    """Add `count` over the measured span of the bars in years (one row, joined by a constant)."""
    span = bars.agg((F.datediff(F.max("date"), F.min("date")).cast("double") / 365.25).alias("_years")).withColumn("_one", F.lit(1))
    return (stats.withColumn("_one", F.lit(1)).join(F.broadcast(span), "_one")
            .withColumn(name, F.col(count) / F.col("_years")).drop("_one", "_years"))


def trade_stats(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, win rate, means, winners and losers, best and worst trade."""
    r = F.col("trade_return")
    return trades.where(r.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(r > 0).alias("win_rate"), F.avg(r).alias("avg_return"),
        F.avg("bars_held").alias("avg_hold"), F.count_if(r > 0).alias("winners"), F.count_if(r <= 0).alias("losers"),
        F.max(r).alias("best"), F.min(r).alias("worst"))


def over_thresholds(rows: DataFrame, thresholds: Sequence[float], score: str = "composite_score") -> DataFrame:
    """Fan each row out to every threshold it reaches, as `threshold`."""
    grid = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col(score) >= t)
    return rows.withColumn("threshold", F.explode(grid))


def grid_rollup(results: DataFrame, dims: Sequence[str], metric: str) -> DataFrame:
    """Average and best metric by every single dimension, by grouping sets over one scan."""
    out = results.groupingSets([[d] for d in dims], *dims).agg(
        F.count(F.lit(1)).alias("variants"), F.avg(metric).alias("avg_metric"), F.max(metric).alias("best_metric"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    name = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dims])
    level = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")) for d in dims])
    return out.select(name.alias("dimension"), level.alias("level"), "variants", "avg_metric", "best_metric")


def grid_candidates(results: DataFrame, baseline: Column, metrics: Sequence[str]) -> DataFrame:
    """Flag grid rows that beat the baseline row on every metric (grid-sized input)."""
    df, grid = results.withColumn("_all", F.lit(1)), Window.partitionBy("_all")
    df = df.withColumns({f"_b_{m}": F.max(F.when(baseline, F.col(m))).over(grid) for m in metrics})
    beats = F.lit(True)
    for m in metrics:
        beats = beats & holds(F.col(m) > F.col(f"_b_{m}"))
    return df.withColumn("candidate", beats).drop("_all", *[f"_b_{m}" for m in metrics])


def interaction(cells: DataFrame, variant: str, value: str) -> DataFrame:
    """2x2 interaction D - (A + (B - A) + (C - A)) from rows labelled A, B, C, D."""
    wide = cells.groupBy().pivot(variant, ["A", "B", "C", "D"]).agg(F.first(value))
    a, b, c, d = (F.col(x) for x in "ABCD")
    return wide.withColumn("additive", a + (b - a) + (c - a)).withColumn("interaction", d - F.col("additive"))


def regime_days(calendar: DataFrame) -> DataFrame:
    return calendar.agg(F.count_if("above_ma").alias("days_above"), F.count_if(~F.col("above_ma")).alias("days_below"))


def blocked_per_year(signals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per calendar year: days below the average, signals, and signals that fell on such days. calendar(date, above_ma)
    has one row per day, also in years without a signal."""
    year = F.year("date").alias("year")
    days = calendar.groupBy(year).agg(F.count_if(~F.col("above_ma")).alias("days_below"))
    marked = signals.select("date").join(F.broadcast(calendar.select("date", "above_ma")), "date")
    counts = marked.groupBy(year).agg(F.count(F.lit(1)).alias("signals"), F.count_if(~F.col("above_ma")).alias("blocked"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return days.join(counts, "year", "left").select("year", "days_below", none("signals"), none("blocked"))


def fill_comparison(trades: DataFrame) -> DataFrame:
    """Same-bar against next-open entries on the same trades."""
    gap = F.col("next_open_price") / F.col("same_close_price") - 1
    return trades.agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean_gap"), F.avg("same_close_return").alias("same_close_mean"),
        F.avg("next_open_return").alias("next_open_mean"),
        F.avg(F.col("next_open_return") - F.col("same_close_return")).alias("mean_delta"), share(gap > 0).alias("pct_gap_up"))


def robustness_verdict(one_row: DataFrame) -> DataFrame:
    """Checks over a row with base/alt win_rate and avg_return, signals per year and bucket means."""
    return one_row.withColumns({
        "better_both": (F.col("alt_avg_return") > F.col("base_avg_return")) & (F.col("alt_win_rate") > F.col("base_win_rate")),
        "enough_signals": F.col("alt_per_year") >= 3,
        "ordered_buckets": holds(F.col("high_bucket") >= F.col("low_bucket")),
        "clear_gap": ~((F.abs(F.col("alt_avg_return") - F.col("base_avg_return")) < 0.01)
                       & (F.abs(F.col("alt_win_rate") - F.col("base_win_rate")) < 0.10)),
    }).withColumn("robust", F.col("better_both") & F.col("enough_signals") & F.col("ordered_buckets") & F.col("clear_gap"))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row summaries with different columns as one row."""
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def coverage(caps: DataFrame, n: int, by: str = "as_of") -> DataFrame:
    """Per date: tickers, tickers with a cap, share, and whether n can be ranked."""
    return caps.groupBy(by).agg(F.count(F.lit(1)).alias("tickers"), F.count("mcap").alias("with_cap")).withColumns({
        "share": F.col("with_cap") / F.col("tickers"), "rankable": F.col("with_cap") >= n})
