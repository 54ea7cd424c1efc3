"""Index membership and market-cap universes as of a date."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .asof import asof_backward
from .fundamentals import PUBLICATION_LAG, SHARE_COLUMNS, preferred_shares, share_counts


def membership_intervals(membership: DataFrame) -> DataFrame:
    """membership(date, ticker) to (since, until, ticker); a snapshot holds until the next one.
    Only the distinct snapshot dates are ordered, never the member rows."""
    dates = membership.select("date").distinct().withColumn("_all", F.lit(1))
    w = Window.partitionBy("_all").orderBy("date")  # calendar-bounded
    spans = dates.withColumn("until", F.lead("date").over(w)).drop("_all")
    return membership.join(F.broadcast(spans), "date").withColumnRenamed("date", "since")


def members_on(membership: DataFrame, day: Column) -> DataFrame:
    """Members on one day, from the last snapshot at or before it. Asking for a
    day before the first snapshot is an error."""
    first = membership.agg(F.min("date").alias("d"), F.max(F.when(F.col("date") <= day, F.col("date"))).alias("s"))
    snapshot = first.select(F.when(F.col("s").isNotNull(), F.col("s")).otherwise(
        F.raise_error(F.lit("date precedes the first membership snapshot")).cast("date")).alias("date"))
    return membership.join(F.broadcast(snapshot), "date").select("ticker").distinct()


def members_per_day(membership: DataFrame, days: DataFrame) -> DataFrame:
    """(date, members) for every day: the size of the last snapshot at or before it. Before the first snapshot the
    membership is unknown, hence NULL and not zero; `members_on` refuses such a day."""
    sizes = membership.groupBy("date").agg(F.count_distinct("ticker").alias("members"))
    # Both sides have at most one row per calendar day.
    one = lambda df: df.withColumn("_all", F.lit(1))
    return asof_backward(one(days.select("date").distinct()), one(sizes.withColumnRenamed("date", "_since")), ["_all"], "date", "_since", ["members"]).drop("_all")


def first_trading_days(calendar: DataFrame) -> DataFrame:
    """calendar(date) to (month, date): the first trading day of every month."""
    return calendar.groupBy(F.trunc("date", "month").alias("month")).agg(F.min("date").alias("date"))


def monthly_universe(membership: DataFrame, calendar: DataFrame) -> DataFrame:
    """(month, as_of, ticker): membership on the first trading day, held all month."""
    firsts = first_trading_days(calendar).select("month", F.col("date").alias("as_of"), F.lit(1).alias("_all"))
    dates = membership.select(F.col("date").alias("snapshot"), F.lit(1).alias("_all")).distinct()
    months = asof_backward(firsts, dates, ["_all"], "as_of", "snapshot", ["snapshot"]).drop("_all")
    # Both sides of the as-of join above hold at most one row per calendar day.
    return (membership.withColumnRenamed("date", "snapshot").join(F.broadcast(months), "snapshot")
            .select("month", "as_of", "ticker").distinct())


def close_asof(requests: DataFrame, bars: DataFrame, as_of: str = "as_of", name: str = "raw_close") -> DataFrame:
    prices = bars.select("ticker", "date", F.col("close").alias(name))
    return asof_backward(requests, prices, ["ticker"], as_of, "date", [name])


def market_cap() -> Column:
    """NULL when an input is missing or not positive."""
    usable = (F.col("raw_close") > 0) & (F.col("shares") > 0)
    return F.when(usable, F.col("raw_close") * F.col("shares"))


def market_caps(requests: DataFrame, bars: DataFrame, facts: DataFrame, as_of: str = "as_of",
                lag_days: int = PUBLICATION_LAG) -> DataFrame:
    """requests + raw_close, shares, mcap; NULL when an input is missing or not positive.
    Share counts enter the time line on the day they may be used (filed + lag), next to the
    closes, so one as-of join and one exchange serve both."""
    closes = bars.select("ticker", F.col("date").alias("_known"), F.col("close").alias("raw_close"))
    counts = share_counts(facts).select("ticker", F.date_add("filed", lag_days).alias("_known"), *SHARE_COLUMNS)
    known = closes.unionByName(counts, allowMissingColumns=True)
    both = asof_backward(requests, known, ["ticker"], as_of, "_known", ["raw_close", *SHARE_COLUMNS], per_column=True)
    both = both.withColumn("shares", preferred_shares()).drop(*SHARE_COLUMNS)
    return both.withColumn("mcap", market_cap())


def top_by_cap(caps: DataFrame, n: int, by: Sequence[str] = ("as_of",)) -> DataFrame:
    """The n largest per date. The rank limit is applied before the shuffle, so a task receives n rows per map task."""
    w = Window.partitionBy(*by).orderBy(F.desc("mcap"), "ticker")
    return (caps.where(F.col("mcap") > 0).withColumn("cap_rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("cap_rank") <= n))


def union_universe(universe: DataFrame) -> DataFrame:
    return universe.select("ticker").distinct()


def in_universe(signals: DataFrame, universe: DataFrame) -> DataFrame:
    """Signals whose ticker belongs to the universe of their month."""
    keyed = signals.withColumn("_month", F.trunc("date", "month"))
    members = universe.select(F.col("month").alias("_month"), "ticker")
    return keyed.join(members, ["_month", "ticker"], "left_semi").drop("_month")


def size_sweep(caps: DataFrame, sizes: Sequence[int], by: Sequence[str] = ("as_of",), fixed: DataFrame | None = None) -> DataFrame:
    """The universe at several sizes and in full, as (size, ...) rows. Only the largest size is ranked, so the
    rank limit still runs before the shuffle; the full universe needs no rank. `fixed` (ticker) adds the variant of an
    unchanging list, whatever its caps."""
    labels = F.array(*[F.struct(F.lit(str(s)).alias("size"), F.lit(s).cast("bigint").alias("cap")) for s in sizes])
    ranked = top_by_cap(caps, max(sizes), by).withColumn("_g", F.explode(labels)).where(F.col("cap_rank") <= F.col("_g.cap"))
    everyone = caps.where(F.col("mcap") > 0).withColumn("size", F.lit("full"))
    out = ranked.withColumn("size", F.col("_g.size")).select(everyone.columns).unionByName(everyone)
    if fixed is None:
        return out
    return out.unionByName(caps.join(fixed.select("ticker").distinct(), "ticker", "left_semi").withColumn("size", F.lit("fixed")).select(everyone.columns))


def membership_sanity(membership: DataFrame, sample: int = 10) -> DataFrame:
    """Member count and the first few tickers of every snapshot."""
    distinct = membership.select("date", "ticker").distinct()
    counts = distinct.groupBy("date").agg(F.count(F.lit(1)).alias("members"))
    w = Window.partitionBy("date").orderBy("ticker")
    head = (distinct.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample)
            .groupBy("date").agg(F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("sample")))
    return counts.join(head, "date")


def average_cap(signals: DataFrame, caps: DataFrame) -> DataFrame:
    """Mean cap and count of signalled tickers at entry; caps(ticker, month, mcap)."""
    joined = signals.withColumn("month", F.trunc("date", "month")).join(
        caps.select("ticker", "month", "mcap"), ["ticker", "month"])
    return joined.agg(F.avg("mcap").alias("avg_mcap"), F.count("mcap").alias("n"))
