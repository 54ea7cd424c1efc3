"""Cross-sectional factor studies: rows are (ticker, snapshot_date, factors..., forward_return_12m)."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .events import window_returns
from .fundamentals import SNAPSHOT_COLUMNS, snapshots_asof
from .ranking import average_ranks, bin_of

# Factor directions and composite weights.
FACTORS = {"revenue_growth_yoy": 1, "debt_to_equity": -1, "roe": 1, "net_margin": 1, "momentum_12m": 1,
           "momentum_6m": 1, "revenue_growth_acceleration": 1, "margin_improvement": 1}
WEIGHTS = {"revenue_growth_yoy": 0.30, "debt_to_equity": 0.25, "momentum_12m": 0.25, "roe": 0.20}
WEIGHT_SCHEMES = {
    "theory": WEIGHTS,
    "equal": {"revenue_growth_yoy": 0.25, "debt_to_equity": 0.25, "momentum_12m": 0.25, "roe": 0.25},
    "momentum_heavy": {"revenue_growth_yoy": 0.10, "debt_to_equity": 0.20, "momentum_12m": 0.50, "roe": 0.20},
    "quality_heavy": {"revenue_growth_yoy": 0.40, "debt_to_equity": 0.30, "momentum_12m": 0.10, "roe": 0.20},
}
MIN_ROWS = 20
MIN_FACTORS = 3


def snapshot_panel(requests: DataFrame, facts: DataFrame, bars: DataFrame, as_of: str = "snapshot_date") -> DataFrame:
    """requests(ticker, snapshot_date) with fundamentals, momenta and the forward return; rows
    without fundamentals or without a forward return are left out."""
    snaps = snapshots_asof(requests, facts, as_of=as_of).where(F.col("statement_date").isNotNull())
    day = F.col(as_of)
    snaps = window_returns(snaps, bars, {
        "forward_return_12m": (F.date_add(day, 2), F.date_add(day, 365)), "momentum_12m": (F.date_sub(day, 365), F.date_sub(day, 2)),
        "momentum_6m": (F.date_sub(day, 182), F.date_sub(day, 2))})
    cols = ["ticker", as_of, *SNAPSHOT_COLUMNS, "momentum_12m", "momentum_6m", "forward_return_12m"]
    return snaps.where(F.col("forward_return_12m").isNotNull()).select(*cols)


def add_factor_momentum(panel: DataFrame, as_of: str = "snapshot_date") -> DataFrame:
    """Factor value minus the same ticker's value at the snapshot one year earlier."""
    ago = F.datediff(as_of, F.lit("1970-01-01").cast("date"))
    # a year is 365 or 366 days, so the frame holds two rows of the ticker at most
    year = Window.partitionBy("ticker").orderBy(ago).rangeBetween(-366, -365)
    held = F.collect_list(F.struct(F.col(as_of).alias("_d"), F.col("revenue_growth_yoy").alias("_g"), F.col("net_margin").alias("_m"))).over(year)
    prior = F.try_element_at(F.filter("_held", lambda x: F.add_months(x["_d"], 12) == F.col(as_of)), F.lit(-1))
    return panel.withColumn("_held", held).withColumn("_prior", prior).withColumns({
        "revenue_growth_acceleration": F.col("revenue_growth_yoy") - F.col("_prior._g"),
        "margin_improvement": F.col("net_margin") - F.col("_prior._m")}).drop("_held", "_prior")


def decile_spreads(long: DataFrame, keys: Sequence[str], value: str, outcome: str, min_rows: int = MIN_ROWS,
                   share: float = 0.10) -> DataFrame:
    """Mean outcome of the highest and lowest share of `value` within each group, and their difference.

    Rows collapse to one per distinct value first, so a group or a tie of any
    size is split over tasks. A histogram then tells which bins lie wholly
    within a cut; only the bins that a cut goes through are sorted. Tied rows across a cut share its places evenly,
    where a sort-based ranking would pick among them arbitrarily.
    """
    rows = long.where(F.col(value).isNotNull() & F.col(outcome).isNotNull())
    values = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.sum(outcome).alias("_s"))
    binned = values.withColumn("_bin", bin_of(F.col("_v")))
    of_key, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_bc"), F.sum("_s").alias("_bs"))
    bins = bins.withColumns({"n": F.sum("_bc").over(of_key), "_upto": F.sum("_bc").over(upto), "_turn": F.row_number().over(of_key.orderBy("_bin"))})
    bins = bins.withColumns({"_k": F.greatest(F.lit(1), F.ceil(F.col("n") * share)), "_below": F.col("_upto") - F.col("_bc"), "_above": F.col("n") - F.col("_upto")})
    whole = {"_low": F.col("_upto") <= F.col("_k"), "_high": F.col("_above") + F.col("_bc") <= F.col("_k")}
    bins = bins.withColumns({name: F.sum(F.when(cond, F.col("_bs"))).over(of_key) for name, cond in whole.items()})
    cut = lambda before: (before < F.col("_k")) & (before + F.col("_bc") > F.col("_k"))
    bins = bins.withColumns({"_cut_low": cut(F.col("_below")), "_cut_high": cut(F.col("_above"))})
    # only the bins that a cut goes through are opened; the first bin of a group carries what lies beyond
    opened = bins.where(F.col("_cut_low") | F.col("_cut_high") | (F.col("_turn") == 1)).drop("_bs", "_upto")
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = opened.join(binned, [*keys, "_bin"]).withColumn("_in", F.sum("_c").over(inside))
    taken = lambda before: F.least(F.col("_c"), F.greatest(F.lit(0), F.col("_k") - before))
    part = lambda cut, before: F.coalesce(F.sum(F.when(F.col(cut), F.col("_s") * taken(before) / F.col("_c"))), F.lit(0.0))
    low = part("_cut_low", F.col("_below") + F.col("_in") - F.col("_c"))
    high = part("_cut_high", F.col("_above") + F.col("_bc") - F.col("_in"))
    out = ranked.groupBy(*keys).agg(F.max("n").alias("n"), ((F.coalesce(F.max("_high"), F.lit(0.0)) + high) / F.max("_k")).alias("top_mean"),
                                    ((F.coalesce(F.max("_low"), F.lit(0.0)) + low) / F.max("_k")).alias("bottom_mean"))
    enough = F.col("n") >= min_rows
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("top_mean", "bottom_mean")})
    return out.withColumn("spread", F.col("top_mean") - F.col("bottom_mean"))


def factor_spreads(panel: DataFrame, factors: Mapping[str, int] = FACTORS, as_of: str = "snapshot_date",
                   outcome: str = "forward_return_12m", **options) -> DataFrame:
    """Direction-adjusted decile spread per (factor, date)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), (F.col(f) * d).alias("v")) for f, d in factors.items()])
    long = panel.select(as_of, outcome, F.explode(pairs).alias("_p")).select(
        as_of, outcome, F.col("_p.factor").alias("factor"), F.col("_p.v").alias("v"))
    return decile_spreads(long, ["factor", as_of], "v", outcome, **options)


def reliability(spreads: DataFrame, by: str = "factor", threshold: float = 2 / 3) -> DataFrame:
    out = spreads.groupBy(by).agg(F.count_if(F.col("spread") > 0).alias("positive_years"),
                                  F.count("spread").alias("total_years"))
    return out.withColumn("reliable", F.coalesce(
        F.try_divide(F.col("positive_years"), F.col("total_years")) >= threshold, F.lit(False)))


def rank_factors(panel: DataFrame, as_of: str = "snapshot_date") -> DataFrame:
    """0-100 ranks per date; debt-to-equity is ranked from high to low. All factors are ranked in one
    pass over a long table keyed by (factor, date). The panel, a row per ticker and snapshot, is read
    twice and therefore kept (lazily, on memory or disk; a lost part is derived again)."""
    panel = panel.persist()
    sources = {"rank_growth": F.col("revenue_growth_yoy"), "rank_de": -F.col("debt_to_equity"), "rank_roe": F.col("roe"),
               "rank_margin": F.col("net_margin"), "rank_momentum": F.col("momentum_12m")}
    pairs = F.array(*[F.struct(F.lit(n).alias("factor"), c.alias("v")) for n, c in sources.items()])
    long = panel.select("ticker", as_of, F.explode(pairs).alias("_p")).select("ticker", as_of, "_p.*").where(F.col("v").isNotNull())
    ranked = average_ranks(long, ["factor", as_of], "v", "rank")
    wide = ranked.groupBy("ticker", as_of).agg(*[F.max(F.when(F.col("factor") == n, F.col("rank"))).alias(n) for n in sources])
    return panel.join(wide, ["ticker", as_of], "left")


RANK_OF = {"revenue_growth_yoy": "rank_growth", "debt_to_equity": "rank_de", "momentum_12m": "rank_momentum",
           "roe": "rank_roe"}


def composite(ranked: DataFrame, schemes: Mapping[str, Mapping[str, float]] | None = None,
              min_factors: int = MIN_FACTORS) -> DataFrame:
    """Weighted mean of the available ranks, weights re-scaled over what is present; NULL below
    `min_factors`. Several weight schemes give one row per scheme."""
    schemes = schemes or {"theory": WEIGHTS}
    table = F.array(*[F.struct(F.lit(s).alias("scheme"), *[F.lit(float(w[f])).alias(f) for f in RANK_OF])
                      for s, w in schemes.items()])
    df = ranked.withColumn("_w", F.explode(table))
    have = sum(F.col(r).isNotNull().cast("int") for r in RANK_OF.values())
    total = sum(F.coalesce(F.col("_w")[f] * F.col(r), F.lit(0.0)) for f, r in RANK_OF.items())
    weight = sum(F.when(F.col(r).isNotNull(), F.col("_w")[f]).otherwise(0.0) for f, r in RANK_OF.items())
    return df.withColumns({
        "scheme": F.col("_w.scheme"), "factors_available": have.cast("bigint"),
        "composite_score": F.when(have >= min_factors, F.try_divide(total, weight))}).drop("_w")

