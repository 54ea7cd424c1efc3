"""Company facts as of a date: what was public, and what it said.

Facts carry the period they describe (`period_end`) and the day they became
public (`filed`). Instead of pairing every request with every fact, a company's
facts are replayed once in filing order, giving one snapshot per filing day; a
request then takes the last snapshot at or before its cutoff.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.guards import ratio
from .asof import asof_backward

# Accepted concept names per line item, preferred first.
CONCEPTS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet",
                "SalesRevenueGoodsNet"],
    "net_income": ["NetIncomeLoss"],
    "equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "lt_debt": ["LongTermDebt", "LongTermDebtNoncurrent"],
}
SHARE_CONCEPTS = [("dei", "EntityCommonStockSharesOutstanding"), ("us-gaap", "CommonStockSharesOutstanding")]
PUBLICATION_LAG = 90
PRIOR_YEAR_GAP = (280, 420)
SNAPSHOT_COLUMNS = ["statement_date", "filed_date", "revenue_growth_yoy", "debt_to_equity", "roe", "net_margin"]


def line_item(concept: Column) -> Column:
    expr = None
    for item, names in CONCEPTS.items():
        expr = F.when(concept.isin(names), item) if expr is None else expr.when(concept.isin(names), item)
    return expr


def preference(concept: Column) -> Column:
    """0 for the preferred name of an item, growing with lower preference."""
    expr = None
    for names in CONCEPTS.values():
        for place, name in enumerate(names):
            expr = F.when(concept == name, place) if expr is None else expr.when(concept == name, place)
    return expr


def is_annual() -> Column:
    """Whether a fact is a yearly figure of a line item from an annual report."""
    wanted = [name for names in CONCEPTS.values() for name in names]
    return ((F.col("taxonomy") == "us-gaap") & (F.col("unit") == "USD") & (F.col("form") == "10-K")
            & (F.col("fp") == "FY") & F.col("period_end").isNotNull() & F.col("concept").isin(wanted))


def annual_entries(facts: DataFrame) -> DataFrame:
    """Yearly figures from annual reports, one row per (ticker, concept, period_end, filed)."""
    return facts.where(is_annual()).groupBy("ticker", "concept", "period_end", "filed").agg(F.max("val").alias("val"))


def annual_intervals(facts: DataFrame) -> DataFrame:
    """Validity of each figure: from its filing day until a later filing restates the same period."""
    w = Window.partitionBy("ticker", "concept", "period_end").orderBy("filed")
    return annual_entries(facts).withColumn("superseded", F.lead("filed").over(w))


def annual_entries_asof(facts: DataFrame, cutoff: Column) -> DataFrame:
    """Figures known on one cutoff date: later filings are excluded before de-duplication."""
    return annual_intervals(facts).where(
        (F.col("filed") <= cutoff) & (F.col("superseded").isNull() | (F.col("superseded") > cutoff)))


def latest_items(facts: DataFrame) -> DataFrame:
    """One row per (ticker, filing day) with the most recent figure of every
    item known by then; equal periods prefer the earlier concept name."""
    entries = annual_entries(facts).withColumns({
        "_item": line_item(F.col("concept")), "_pref": -preference(F.col("concept"))})
    known = Window.partitionBy("ticker").orderBy("filed")
    figure = F.struct("period_end", "_pref", "filed", "val", "concept")
    running = {i: F.max(F.when(F.col("_item") == i, figure)).over(known) for i in CONCEPTS}
    return (entries.withColumns(running).select("ticker", F.col("filed").alias("version"), *CONCEPTS)
            .dropDuplicates(["ticker", "version"]))


def prior_year_revenue(versions: DataFrame, facts: DataFrame) -> DataFrame:
    """Add the newest same-concept revenue 280-420 days before the current one, as known at that version.
    Period ends are blocked by the width of the gap range, so a probe meets two blocks of its own concept."""
    low, high = PRIOR_YEAR_GAP
    block = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / (high - low))
    revenue = F.col("revenue")
    probe = versions.where(revenue.isNotNull()).select(
        "ticker", "version", revenue["concept"].alias("concept"), revenue["period_end"].alias("_end"))
    probe = probe.withColumn("_block", F.explode(F.array_distinct(F.array(
        block(F.date_sub("_end", high)), block(F.date_sub("_end", low))))))
    build = (annual_entries(facts).where(F.col("concept").isin(CONCEPTS["revenue"]))
             .select("ticker", "concept", F.col("period_end").alias("_p_end"), F.col("filed").alias("_p_filed"),
                     F.col("val").alias("_p_val"), block(F.col("period_end")).alias("_block")))
    pairs = probe.join(build, ["ticker", "concept", "_block"]).where(
        (F.col("_p_filed") <= F.col("version")) & F.datediff("_end", "_p_end").between(low, high))
    prior = pairs.groupBy("ticker", "version").agg(
        F.max(F.struct("_p_end", "_p_filed", "_p_val")).alias("_prior"))
    return versions.join(prior, ["ticker", "version"], "left").withColumns({
        "prior_revenue": F.col("_prior")["_p_val"], "prior_end": F.col("_prior")["_p_end"]}).drop("_prior")


def growth_over(current: Column, prior: Column) -> Column:
    return F.when(prior > 0, (current - prior) / prior)


def ratios(revenue: Column, net_income: Column, equity: Column, lt_debt: Column) -> dict[str, Column]:
    """Non-positive equity leaves the equity ratios unknown."""
    own = F.when(equity > 0, equity)
    return {"debt_to_equity": ratio(lt_debt, own), "roe": ratio(net_income, own),
            "net_margin": ratio(net_income, revenue)}


def snapshot_versions(facts: DataFrame) -> DataFrame:
    """One fundamentals snapshot per (ticker, filing day); none before the first revenue."""
    items = prior_year_revenue(latest_items(facts), facts).where(F.col("revenue").isNotNull())
    val = {i: F.col(i)["val"] for i in CONCEPTS}
    return items.select(
        "ticker", "version", F.col("revenue")["period_end"].alias("statement_date"),
        F.col("revenue")["filed"].alias("filed_date"),
        growth_over(val["revenue"], F.col("prior_revenue")).alias("revenue_growth_yoy"),
        *[c.alias(n) for n, c in ratios(**val).items()])


def snapshots_asof(requests: DataFrame, facts: DataFrame, lag_days: int = PUBLICATION_LAG,
                   as_of: str = "as_of") -> DataFrame:
    """requests(ticker, as_of) + snapshot columns, all NULL where nothing was public by as_of - lag."""
    keyed = requests.withColumn("_cutoff", F.date_sub(as_of, lag_days))
    return asof_backward(keyed, snapshot_versions(facts), ["ticker"], "_cutoff", "version",
                         SNAPSHOT_COLUMNS).drop("_cutoff")


def statement_asof(requests: DataFrame, statements: DataFrame, values: Sequence[str], lag_days: int = PUBLICATION_LAG,
                   as_of: str = "as_of") -> DataFrame:
    """Latest statement whose period ended at least `lag_days` before the request."""
    keyed = requests.withColumn("_cutoff", F.date_sub(as_of, lag_days))
    return asof_backward(keyed, statements, ["ticker"], "_cutoff", "statement_date",
                         ["statement_date", *values]).drop("_cutoff")


def filed_asof(requests: DataFrame, statements: DataFrame, values: Sequence[str], as_of: str = "as_of") -> DataFrame:
    """Latest filing at or before the request, by its real filing date and without a lag."""
    newest = (statements.where(F.col("filed_date").isNotNull()).groupBy("ticker", "filed_date")
              .agg(F.max(F.struct("statement_date", *values)).alias("_s"))
              .select("ticker", "filed_date", "_s.*"))
    return asof_backward(requests, newest, ["ticker"], as_of, "filed_date", ["filed_date", "statement_date", *values])


def period_growth(statements: DataFrame, name: str = "revenue_growth_yoy", positive_only: bool = True) -> DataFrame:
    """Growth against the previous row by statement date, whatever the gap."""
    w = Window.partitionBy("ticker").orderBy("statement_date")
    before = F.lag("revenue").over(w)
    usable = before > 0 if positive_only else before != 0
    return statements.withColumn("_prior", F.when(usable, before)).withColumn(
        name, (F.col("revenue") - F.col("_prior")) / F.col("_prior")).drop("_prior")


def statement_ratios(statements: DataFrame, positive_equity: bool = True) -> DataFrame:
    """Ratio columns on rows that carry revenue, net_income, equity and lt_debt."""
    equity = F.col("equity")
    own = F.when(equity > 0, equity) if positive_equity else F.nullif(equity, F.lit(0.0))
    return statements.withColumns({
        "debt_to_equity": F.col("lt_debt") / own, "roe": F.col("net_income") / own,
        "net_margin": ratio(F.col("net_income"), F.col("revenue"))})


def with_fallback(primary: DataFrame, secondary: DataFrame, on: Sequence[str], values: Sequence[str],
                  present: str = "statement_date") -> DataFrame:
    """Whole-row fallback per request: the secondary source is used only where the primary has nothing."""
    rows = lambda df, name: df.select(*on, F.when(F.col(present).isNotNull(), F.struct(*values)).alias(name))
    both = rows(primary, "_a").join(rows(secondary, "_b"), list(on), "left")
    return both.withColumn("_s", F.coalesce("_a", "_b")).select(
        *on, "_s.*", F.when(F.col("_a").isNotNull(), "primary").when(F.col("_b").isNotNull(), "secondary").alias("origin"))


SHARE_COLUMNS = [f"_s{i}" for i in range(len(SHARE_CONCEPTS))]


def is_share_count() -> Column:
    return ((F.col("unit") == "shares") & F.col("form").isin("10-K", "10-Q") & F.col("filed").isNotNull() & (F.col("val") != 0))


def share_counts(facts: DataFrame) -> DataFrame:
    """One row per (ticker, filed) with the count of each share concept filed that day."""
    usable = facts.where(is_share_count())
    newest = F.struct(F.coalesce(F.col("period_end").cast("string"), F.lit("")).alias("e"), F.col("val").alias("v"))
    daily = usable.groupBy("ticker", "filed").agg(*[
        F.max(F.when((F.col("taxonomy") == t) & (F.col("concept") == c), newest)).alias(n)
        for n, (t, c) in zip(SHARE_COLUMNS, SHARE_CONCEPTS)])
    return daily.select("ticker", "filed", *[F.col(n)["v"].alias(n) for n in SHARE_COLUMNS])


def preferred_shares() -> Column:
    return F.coalesce(*[F.when(F.col(n) > 0, F.col(n)) for n in SHARE_COLUMNS])


def shares_asof(requests: DataFrame, facts: DataFrame, lag_days: int = PUBLICATION_LAG, as_of: str = "as_of") -> DataFrame:
    """requests + `shares`: the newest count filed by as_of - lag, cover page before balance sheet."""
    keyed = requests.withColumn("_cutoff", F.date_sub(as_of, lag_days))
    found = asof_backward(keyed, share_counts(facts), ["ticker"], "_cutoff", "filed", SHARE_COLUMNS, per_column=True)
    return found.withColumn("shares", preferred_shares()).drop("_cutoff", *SHARE_COLUMNS)


def companies_on(facts: DataFrame, as_of: Column, lag_days: int = PUBLICATION_LAG) -> DataFrame:
    """(ticker, snapshot columns, shares) of one day, for every company with a usable fact by as_of - lag.

    The values are those of `snapshots_asof` and `shares_asof`, in one scan: facts collapse to one row per
    (ticker, concept, period_end, filed), then to the newest figures of a ticker by partial aggregation. What is
    gathered per ticker are its annual revenues, a few rows a year.
    """
    annual, held = F.coalesce(is_annual(), F.lit(False)), F.coalesce(is_share_count(), F.lit(False))
    known = facts.where((F.col("filed") <= F.date_sub(as_of, lag_days)) & (annual | held))
    entries = known.groupBy("ticker", "taxonomy", "concept", "period_end", "filed").agg(
        F.bool_or(annual).alias("_annual"), F.max(F.when(annual, F.col("val"))).alias("_fy"), F.max(F.when(held, F.col("val"))).alias("_held"))
    concept = F.col("concept")
    figure = F.struct("period_end", (-preference(concept)).alias("pref"), "filed", F.col("_fy").alias("val"), "concept")
    items = {i: F.max(F.when(F.col("_annual") & (line_item(concept) == i), figure)) for i in CONCEPTS}
    revenues = F.collect_list(F.when(F.col("_annual") & (line_item(concept) == "revenue"), F.struct("period_end", "filed", F.col("_fy").alias("val"), "concept")))
    shares = {n: F.max(F.when(F.col("_held").isNotNull() & (F.col("taxonomy") == t) & (concept == c), F.struct(
        "filed", F.coalesce(F.col("period_end").cast("string"), F.lit("")).alias("e"), F.col("_held").alias("v"))))["v"] for n, (t, c) in zip(SHARE_COLUMNS, SHARE_CONCEPTS)}
    company = entries.groupBy("ticker").agg(*[c.alias(n) for n, c in {**items, "_revenues": revenues, **shares}.items()])
    now = F.col("revenue")
    prior = F.array_max(F.filter("_revenues", lambda r: (r["concept"] == now["concept"]) & F.datediff(now["period_end"], r["period_end"]).between(*PRIOR_YEAR_GAP)))
    val = {i: F.when(now.isNotNull(), F.col(i)["val"]) for i in CONCEPTS}
    return company.select("ticker", now["period_end"].alias("statement_date"), now["filed"].alias("filed_date"),
                          growth_over(val["revenue"], prior["val"]).alias("revenue_growth_yoy"),
                          *[c.alias(n) for n, c in ratios(**val).items()], preferred_shares().alias("shares"))


def year_end_requests(bars: DataFrame) -> DataFrame:
    """One request per instrument and calendar year, dated 31 December."""
    return (bars.select("ticker", F.year("date").alias("year")).distinct()
            .withColumn("as_of", F.make_date("year", F.lit(12), F.lit(31))))


def lookahead_violations(snapshots: DataFrame, lag_days: int = PUBLICATION_LAG, as_of: str = "as_of") -> DataFrame:
    """Snapshots that rest on a filing not yet public at the cutoff; must be empty."""
    return snapshots.where(F.col("filed_date") > F.date_sub(as_of, lag_days))
