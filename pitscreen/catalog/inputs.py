"""Sources, sinks, fundamentals, universe, temporal joins and vetoes."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, tiers
from ..operators import asof, curve, events, fundamentals as fnd, studies, universe as uni, veto
from ..operators.windows import has_history
from ..plans import alerts, event_study
from ..session import clustered, scratch_path
from ..sources import bars as src_bars, facts as src_facts, filings as src_filings, membership as src_members, sinks, star
from .base import query
from .ctes import W, asof as asof_sql, busday, caps, gate, shares

# ---------------------------------------------------------------- sources


@query("src_01_bar_scan", "SELECT * FROM bars WHERE date >= DATE '1996-01-01' AND date < DATE '1998-01-01'", d="open high low close volume")
def _(spark, sf):
    path = scratch_path(spark, "bars")
    star.bars(spark, sf).write.parquet(path)
    return src_bars.scan_bars(spark, path, start="1996-01-01", end="1998-01-01")


@query("src_02_adjusted_bars", """
SELECT ticker, date, open * f AS open, high * f AS high, low * f AS low, adj AS close, volume FROM (
  SELECT *, CASE WHEN volume < 5 THEN NULL ELSE close * CAST(0.5 AS DOUBLE) END AS adj, CAST(0.5 AS DOUBLE) AS f FROM bars) WHERE adj IS NOT NULL""", d="open high low close volume")
def _(spark, sf):
    b = star.bars(spark, sf)
    raw = b.withColumns({c: F.col(c).cast("string") for c in ("open", "high", "low")}).withColumn(
        "adjusted_close", F.when(F.col("volume") < 5, "n/a").otherwise((F.col("close") * 0.5).cast("string")))
    return src_bars.adjusted_bars(raw)


@query("src_03_unsplit_bars", """
SELECT b.ticker, b.date, b.close * coalesce(s.f, 1) AS close, coalesce(s.f, 1) AS split_factor FROM bars b LEFT JOIN (
  SELECT b.ticker, b.date, product(s.ratio) AS f FROM bars b JOIN splits s ON s.ticker = b.ticker AND s.split_date > b.date GROUP BY 1, 2) s USING (ticker, date)""",
       d="close split_factor", digits=None)
def _(spark, sf):
    return src_bars.unsplit_bars(star.bars(spark, sf), star.splits(spark, sf)).select("ticker", "date", "close", "split_factor")


def _facts_json(spark, sf):
    f = star.facts(spark, sf)
    entry = F.struct(F.col("period_end").cast("string").alias("end"), F.col("filed").cast("string").alias("filed"), "val", "form", "fp")
    units = f.groupBy("ticker", "taxonomy", "concept", "unit").agg(F.collect_list(entry).alias("e"))
    pack = lambda df, keys, k, v: df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(k, v))).alias("m"))
    c = pack(units, ["ticker", "taxonomy", "concept"], "unit", "e")
    t = pack(c.withColumn("u", F.struct(F.col("m").alias("units"))), ["ticker", "taxonomy"], "concept", "u")
    d = pack(t.withColumnRenamed("m", "x"), ["ticker"], "taxonomy", "x")
    return d.select("ticker", F.to_json(F.struct(F.col("m").alias("facts"))).alias("json"))


@query("src_04_company_facts", "SELECT * FROM facts", d="val")
def _(spark, sf):
    return src_facts.company_facts(_facts_json(spark, sf))


def _vendor_json(spark, sf):
    s = star.statements(spark, sf)
    day = F.col("statement_date").cast("string")
    text = lambda c: F.col(c).cast("string")
    inc = F.create_map(F.lit("date"), day, F.lit("filing_date"), text("filed_date"), F.lit("totalRevenue"),
                       F.when(F.col("suppkey") % 13 == 0, "None").otherwise(text("revenue")), F.lit("netIncome"), text("net_income"))
    bal = F.create_map(F.lit("totalStockholderEquity"), text("equity"),
                       F.when(F.col("suppkey") % 2 == 0, "longTermDebt").otherwise("longTermDebtTotal"), text("lt_debt"))
    packed = s.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct(day, inc))).alias("i"),
                                     F.map_from_entries(F.collect_list(F.struct(day, bal))).alias("b"))
    doc = F.struct(F.struct(F.struct(F.col("i").alias("yearly")).alias("Income_Statement"),
                            F.struct(F.col("b").alias("yearly")).alias("Balance_Sheet")).alias("Financials"))
    return packed.select("ticker", F.to_json(doc).alias("json"))


@query("src_05_vendor_statements", "SELECT ticker, statement_date, filed_date, revenue, net_income, lt_debt, equity FROM stm WHERE suppkey % 13 <> 0",
       d="revenue net_income lt_debt equity")
def _(spark, sf):
    return src_facts.vendor_statements(_vendor_json(spark, sf))


@query("src_06_wide_statement", """
SELECT ticker, statement_date, coalesce(CASE WHEN suppkey % 3 <> 0 THEN revenue END, revenue * 2) AS revenue, net_income, equity, lt_debt
FROM stm""", d="revenue net_income equity lt_debt")
def _(spark, sf):
    s = star.statements(spark, sf)
    years = sorted(r["year"] for r in s.select("year").distinct().collect())  # the columns of the wide layout
    rows = F.array(F.struct(F.lit("TotalRevenue").alias("label"), F.when(F.col("suppkey") % 3 != 0, F.col("revenue")).alias("v")),
                   F.struct(F.lit("Operating Revenue").alias("label"), (F.col("revenue") * 2).alias("v")),
                   F.struct(F.lit("Net Income").alias("label"), F.col("net_income").alias("v")),
                   F.struct(F.lit("CommonStockEquity").alias("label"), F.col("equity").alias("v")),
                   F.struct(F.lit("LongTermDebt").alias("label"), F.col("lt_debt").alias("v")))
    long = s.select("ticker", F.col("statement_date").cast("string").alias("d"), F.explode(rows).alias("r")).select("ticker", "d", "r.*")
    wide = long.groupBy("ticker", "label").pivot("d", [f"{y}-12-31" for y in years]).agg(F.first("v", ignorenulls=True))
    out = src_facts.wide_statement(wide).where(F.col("revenue").isNotNull())
    return out.select("ticker", "statement_date", "revenue", "net_income", "equity", "lt_debt")


@query("src_07_filing_rows", "SELECT ticker, form, filing_date, array_to_string(items, '|') AS items, accession FROM filings")
def _(spark, sf):
    f = star.filings(spark, sf)
    # Parallel arrays per ticker and block of 10,000 accessions: one submissions shard, bounded by its block.
    one = F.struct("accession", "form", F.col("filing_date").cast("string").alias("d"), F.concat_ws(", ", "items").alias("i"))
    blocks = f.groupBy("ticker", F.floor(F.col("accession").cast("bigint") / 10_000).alias("m")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    blocks = blocks.select("ticker", F.col("x.form").alias("form"), F.col("x.d").alias("filingDate"), F.col("x.i").alias("items"),
                           F.col("x.accession").alias("accessionNumber"), F.array(F.lit("main.htm")).alias("primaryDocument"))
    # Shards as JSON files, the recent one read last; it repeats the filings of the first block.
    path = scratch_path(spark, "submissions")
    blocks.write.json(f"{path}/older")
    blocks.where(F.col("accessionNumber")[0] < "000000010000").write.json(f"{path}/recent")
    fields = "ticker string, " + ", ".join(f"{c} array<string>" for c in src_filings.FIELDS)
    read = lambda part: spark.read.schema(fields).json(f"{path}/{part}")
    rows = src_filings.merge_shards(read("recent"), read("older"))
    return rows.select("ticker", "form", "filing_date", F.array_join("items", "|").alias("items"), "accession")


@query("src_08_membership_lines", "SELECT * FROM members")
def _(spark, sf):
    m = star.membership(spark, sf).withColumn("block", F.floor(F.col("ticker").cast("bigint") / 400))
    # One quoted line per month and block of 400 symbols, as in an index-membership file.
    lines = m.groupBy("date", "block").agg(F.array_join(F.collect_list("ticker"), ", ").alias("t")).select(
        F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(',"'), "t", F.lit('"')).alias("value"))
    path = scratch_path(spark, "membership")
    bad = lines.limit(0).unionByName(spark.createDataFrame([("date,tickers",), ("not a date,\"1,2\"",), ("1997-01-01,\"\"",), ("",)], "value string"))
    lines.unionByName(bad).write.text(path)
    return src_members.exploded(src_members.read_membership(spark, path))


@query("src_09_constituents_by_add_date", """
SELECT ticker AS symbol FROM (SELECT ticker, min(date) AS d FROM members GROUP BY 1) WHERE d <= DATE '1995-01-15' OR CAST(ticker AS BIGINT) % 9 = 0""")
def _(spark, sf):
    first = star.membership(spark, sf).groupBy("ticker").agg(F.min("date").alias("d"))
    text = F.when(F.col("ticker").cast("bigint") % 9 == 0, "unknown").otherwise(F.col("d").cast("string"))
    path = scratch_path(spark, "constituents")
    rows = first.select(F.concat_ws(",", "ticker", F.lit("sector"), text).alias("value"))
    header, broken = F.lit("Symbol,Sector,Date added"), F.lit("lonely")
    first.select(header.alias("value")).limit(1).unionByName(rows).unionByName(first.select(broken.alias("value")).limit(1)).coalesce(1).write.text(path)
    return src_members.members_by_add_date(src_members.read_constituents(spark, path), F.lit("1995-01-15").cast("date"))


@query("src_10_rates", "SELECT date, rate FROM rates", d="rate")
def _(spark, sf):
    raw = star.rates(spark, sf).select("date", (F.col("rate") * 100).cast("string").alias("percent"))
    path = scratch_path(spark, "rates")
    lines = raw.select(F.concat_ws(",", F.col("date").cast("string"), "percent").alias("value"))
    extra = lambda text: raw.select(F.lit(text).alias("value")).limit(1)
    extra("DATE,RATE").unionByName(lines).unionByName(extra("1999-01-01,.")).unionByName(extra("1999-01-02,1.0,surplus")).coalesce(1).write.text(path)
    return src_members.read_rates(spark, path)


@query("src_11_concept_pruning", "SELECT concept, count(*) AS n FROM facts WHERE concept <> 'Assets' GROUP BY 1", i="n")
def _(spark, sf):
    path = scratch_path(spark, "facts")
    src_facts.write_by_concept(star.facts(spark, sf), path)
    kept = src_facts.prune_concepts(spark.read.parquet(path))
    return kept.groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


@query("src_11_concept_folders", """
SELECT concept, count(*) AS n, sum(val) AS total FROM facts WHERE concept IN ('Revenues', 'NetIncomeLoss') GROUP BY 1
UNION ALL SELECT concept, count(*), sum(val) FROM facts WHERE concept IN (SELECT concept FROM facts GROUP BY 1 ORDER BY count(*) DESC, concept LIMIT 1) GROUP BY 1""", d="total", i="n", digits=2)
def _(spark, sf):
    path = scratch_path(spark, "facts")
    src_facts.write_by_concept(star.facts(spark, sf), path)
    named = src_facts.read_concepts(spark, path, ["Revenues", "NetIncomeLoss"])
    commonest = spark.read.parquet(path).groupBy("concept").count().orderBy(F.desc("count"), "concept").limit(1)
    totals = lambda df: df.groupBy("concept").agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("total"))
    return totals(named).unionByName(totals(src_facts.read_concepts(spark, path, commonest)))


@query("src_12_history_filter", "SELECT ticker, count(*) AS n FROM bars GROUP BY 1 HAVING count(*) >= 520", i="n")
def _(spark, sf):
    return has_history(star.bars(spark, sf), 520).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("src_13_coverage", """
SELECT as_of, count(*) AS tickers, count(mcap) AS with_cap, count(mcap) / CAST(count(*) AS DOUBLE) AS share, count(mcap) >= 50 AS rankable FROM caps_month GROUP BY 1""",
       d="share", i="tickers with_cap")
def _(spark, sf):
    return studies.coverage(_month_caps(spark, sf), 50)


@query("src_14_symbol_cik", """
SELECT ticker, count(*) AS filings, max(CASE WHEN suppkey % 6 <> 0 THEN suppkey + 1000 END) AS cik FROM filings f
LEFT JOIN (SELECT DISTINCT suppkey, ticker AS st FROM stm) s ON s.st = f.ticker GROUP BY 1""", i="filings cik")
def _(spark, sf):
    sup = star.table(spark, sf, "supplier").where(F.col("s_suppkey") % 6 != 0)
    dim = src_facts.symbol_dimension(sup.select(F.col("s_suppkey").cast("string").alias("symbol"), (F.col("s_suppkey") + 1000).alias("cik")))
    counts = star.filings(spark, sf).groupBy("ticker").agg(F.count(F.lit(1)).alias("filings"))
    return src_facts.with_cik(counts, dim)


# ---------------------------------------------------------------- sinks


@query("snk_01_daily_snapshot", "SELECT date AS as_of, count(*) AS n, sum(close) AS total FROM bars GROUP BY 1", d="total", i="n")
def _(spark, sf):
    path = scratch_path(spark, "snapshot")
    rows = star.bars(spark, sf).select("ticker", "close", F.col("date").alias("as_of"))
    # Two spans taken from the data overlap: what the first wrote wrongly, the second replaces; other days stay.
    span = lambda share: F.expr(f"date_add(first, cast(floor(datediff(last, first) * {share}) as int))")
    ends = rows.agg(F.min("as_of").alias("first"), F.max("as_of").alias("last")).select(span(0.4).alias("a"), span(0.7).alias("b")).first()
    wrong = F.when(F.col("as_of") >= ends["a"], 0.0).otherwise(F.col("close"))
    sinks.write_daily(rows.where(F.col("as_of") <= ends["b"]).withColumn("close", wrong), path, tasks=16)
    sinks.write_daily(rows.where(F.col("as_of") >= ends["a"]), path, tasks=16)
    return spark.read.parquet(path).groupBy("as_of").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total"))


RUN_DIFF = """SELECT date, 'NEW' AS status FROM (SELECT DISTINCT ticker, date FROM scored WHERE composite_score >= CAST(0.6 AS DOUBLE)) s
 WHERE NOT EXISTS (SELECT 1 FROM scored p WHERE p.ticker = s.ticker AND p.composite_score >= CAST(0.6 AS DOUBLE) AND p.date = s.date - CASE isodow(s.date) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END)"""


@query("snk_02_daily_outputs", f"""
SELECT 'alerts' AS output, date AS as_of, count(*) AS n FROM ({RUN_DIFF}) GROUP BY 2
UNION ALL SELECT 'exits', due, count(*) FROM (SELECT (SELECT min(b.date) FROM bars b WHERE b.ticker = c.ticker AND b.date > c.date AND {busday('c.date', 'b.date')} >= 252) AS due FROM crossed c) WHERE due IS NOT NULL GROUP BY 2
UNION ALL SELECT 'state', date, count(*) FROM scored WHERE composite_score >= CAST(0.6 AS DOUBLE) GROUP BY 2""", i="n")
def _(spark, sf):
    """A backfill of all daily runs, its second half run again: every run writes alerts, exits and state of its days."""
    path = scratch_path(spark, "runs")
    rows = event_study.indicators.recovery_scores(has_history(star.bars(spark, sf), 252)).select("ticker", "date", "close", "composite_score")
    # stored once: six writes and the prices of the exits read from it
    rows = clustered(events.crossings(rows, F.col("composite_score") >= 0.60))
    state = rows.where(F.col("composite_score") >= 0.60).select("ticker", F.col("date").alias("as_of"), "composite_score")
    history = state.select("ticker", F.col("as_of").alias("date"), F.lit("BUY").alias("signal"))
    fresh = alerts.weekday_changes(history).where(F.col("status") == "NEW").select("ticker", F.col("date").alias("as_of"), "status")
    due = events.first_bar_after(rows.where("crossed").select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_price")), rows, 252)
    exits = due.select("ticker", "entry_date", F.col("date").alias("as_of"), (F.col("close") / F.col("entry_price") - 1).alias("ret"))
    half = F.col("as_of") > "1998-06-30"
    sinks.write_run(path, tasks=16, alerts=fresh, exits=exits, state=state)
    sinks.write_run(path, tasks=16, alerts=fresh.where(half), exits=exits.where(half), state=state.where(half))
    counts = [spark.read.parquet(f"{path}/{name}").groupBy("as_of").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("output"), "as_of", "n")
              for name in ("alerts", "exits", "state")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _month_requests(spark, sf):
    cal = star.benchmark(star.bars(spark, sf))
    return uni.monthly_universe(star.membership(spark, sf), cal)


def _month_caps(spark, sf):
    return uni.market_caps(_month_requests(spark, sf), star.bars(spark, sf), star.facts(spark, sf))


@query("snk_03_cap_grid_refresh", "SELECT ticker, as_of, CASE WHEN as_of < DATE '1999-01-01' THEN -1.0 ELSE mcap END AS mcap FROM caps_month", d="mcap", digits=None)
def _(spark, sf):
    path, req = scratch_path(spark, "grid"), _month_requests(spark, sf).select("ticker", "as_of")
    # The first refresh stores -1 for everything; rows then final stay, the second one computes all later ones.
    today = F.date_add(F.lit("1999-01-01").cast("date"), 120)
    sinks.refresh_stored_grid(spark, path, req, today, lambda r: r.withColumn("mcap", F.lit(-1.0)))
    sinks.refresh_stored_grid(spark, path, req, today, lambda r: uni.market_caps(r, star.bars(spark, sf), star.facts(spark, sf)))
    return spark.read.parquet(path).select("ticker", "as_of", "mcap")


@query("snk_04_recent_alerts", "SELECT ticker, date AS as_of FROM crossed WHERE date > DATE '2001-03-01' AND date <= DATE '2001-03-31'")
def _(spark, sf):
    path = scratch_path(spark, "alerts")
    rows = event_study.score_crossings(star.bars(spark, sf)).select("ticker", F.col("date").alias("as_of"))
    sinks.write_daily(rows.withColumn("month", F.trunc("as_of", "month")), path, by="month")
    return sinks.recent_alerts(spark, path, F.lit("2001-03-31").cast("date")).select("ticker", "as_of")


# ---------------------------------------------------------------- fundamentals


@query("fnd_01_annual_dedup", """
SELECT ticker, concept, period_end, filed, val FROM annual WHERE filed <= DATE '1999-06-30'
QUALIFY row_number() OVER (PARTITION BY ticker, concept, period_end ORDER BY filed DESC) = 1""", d="val")
def _(spark, sf):
    return fnd.annual_entries_asof(star.facts(spark, sf), F.lit("1999-06-30").cast("date")).select("ticker", "concept", "period_end", "filed", "val")


@query("fnd_02_latest_concept", """
SELECT r.ticker, r.version, a.concept, a.period_end, a.val FROM (SELECT DISTINCT ticker, filed AS version FROM annual) r
JOIN annual a ON a.ticker = r.ticker AND a.filed <= r.version AND a.item = 'revenue'
QUALIFY row_number() OVER (PARTITION BY r.ticker, r.version ORDER BY a.period_end DESC, a.pref, a.filed DESC) = 1""", d="val")
def _(spark, sf):
    v = fnd.latest_items(star.facts(spark, sf)).where(F.col("revenue").isNotNull())
    return v.select("ticker", "version", F.col("revenue.concept").alias("concept"), F.col("revenue.period_end").alias("period_end"), F.col("revenue.val").alias("val"))


PRIOR_SQL = """
SELECT c.ticker, c.version, p.period_end AS prior_end, p.val AS prior_revenue, {extra} FROM (
  SELECT r.ticker, r.version, a.concept, a.period_end, a.val FROM (SELECT DISTINCT ticker, filed AS version FROM annual) r
  JOIN annual a ON a.ticker = r.ticker AND a.filed <= r.version AND a.item = 'revenue'
  QUALIFY row_number() OVER (PARTITION BY r.ticker, r.version ORDER BY a.period_end DESC, a.pref, a.filed DESC) = 1) c
LEFT JOIN annual p ON p.ticker = c.ticker AND p.concept = c.concept AND p.filed <= c.version AND date_diff('day', p.period_end, c.period_end) BETWEEN 280 AND 420
QUALIFY row_number() OVER (PARTITION BY c.ticker, c.version ORDER BY p.period_end DESC, p.filed DESC) = 1"""


def _prior(spark, sf):
    f = star.facts(spark, sf)
    return fnd.prior_year_revenue(fnd.latest_items(f), f).where(F.col("revenue").isNotNull())


@query("fnd_03_prior_year", PRIOR_SQL.format(extra="c.concept"), d="prior_revenue")
def _(spark, sf):
    return _prior(spark, sf).select("ticker", "version", "prior_end", "prior_revenue", F.col("revenue.concept").alias("concept"))


@query("fnd_04_growth", PRIOR_SQL.format(extra="CASE WHEN p.val > 0 THEN (c.val - p.val) / p.val END AS growth"), d="prior_revenue growth")
def _(spark, sf):
    return _prior(spark, sf).select("ticker", "version", "prior_end", "prior_revenue",
                                    fnd.growth_over(F.col("revenue.val"), F.col("prior_revenue")).alias("growth"))


@query("fnd_05_ratios", """
SELECT ticker, year, CASE WHEN equity > 0 THEN lt_debt / equity END AS debt_to_equity, CASE WHEN equity > 0 THEN net_income / equity END AS roe, net_income / nullif(revenue, 0) AS net_margin FROM stm""",
       d="debt_to_equity roe net_margin", i="year")
def _(spark, sf):
    s = star.statements(spark, sf)
    parts = fnd.ratios(*[F.col(c) for c in ("revenue", "net_income", "equity", "lt_debt")])
    return s.select("ticker", "year", *[c.alias(n) for n, c in parts.items()])


SNAP_D = "revenue_growth_yoy debt_to_equity roe net_margin"


@query("fnd_06_snapshot_asof", f"SELECT * FROM ({asof_sql('month_universe')})", d=SNAP_D)
def _(spark, sf):
    req = _month_requests(spark, sf).select("ticker", "as_of").distinct()
    return fnd.snapshots_asof(req, star.facts(spark, sf))


@query("fnd_07_statement_asof", """
SELECT r.ticker, r.as_of, s.statement_date, s.revenue FROM (SELECT DISTINCT ticker, as_of FROM month_universe) r
ASOF LEFT JOIN (SELECT ticker, statement_date, revenue FROM stm) s ON s.ticker = r.ticker AND s.statement_date <= r.as_of - 90""", d="revenue")
def _(spark, sf):
    req = _month_requests(spark, sf).select("ticker", "as_of").distinct()
    return fnd.statement_asof(req, star.statements(spark, sf), ["revenue"])


@query("fnd_08_filed_asof", """
SELECT r.ticker, r.as_of, s.filed_date, s.statement_date, s.revenue FROM (SELECT DISTINCT ticker, as_of FROM month_universe) r
ASOF LEFT JOIN (SELECT ticker, filed_date, statement_date, revenue FROM stm) s ON s.ticker = r.ticker AND s.filed_date <= r.as_of""", d="revenue")
def _(spark, sf):
    req = _month_requests(spark, sf).select("ticker", "as_of").distinct()
    return fnd.filed_asof(req, star.statements(spark, sf), ["revenue"])


@query("fnd_09_period_growth", """
SELECT ticker, statement_date, CASE WHEN p > 0 THEN (revenue - p) / p END AS revenue_growth_yoy FROM (
  SELECT *, lag(revenue) OVER (PARTITION BY ticker ORDER BY statement_date) AS p FROM stm)""", d="revenue_growth_yoy")
def _(spark, sf):
    return fnd.period_growth(star.statements(spark, sf)).select("ticker", "statement_date", "revenue_growth_yoy")


@query("fnd_10_wide_growth", """
SELECT ticker, statement_date, (revenue - p) / nullif(p, 0) AS revenue_growth_yoy, net_income / nullif(equity, 0) AS roe, lt_debt / nullif(equity, 0) AS debt_to_equity FROM (
  SELECT * REPLACE (r AS revenue), lag(r) OVER (PARTITION BY ticker ORDER BY statement_date) AS p FROM (SELECT *, CASE WHEN (suppkey + year) % 4 = 0 THEN NULL ELSE revenue END AS r FROM stm)) WHERE revenue IS NOT NULL""",
       d="revenue_growth_yoy roe debt_to_equity")
def _(spark, sf):
    s = star.statements(spark, sf)
    s = s.withColumn("revenue", F.when((F.col("suppkey") + F.col("year")) % 4 != 0, F.col("revenue")))
    s = fnd.statement_ratios(fnd.period_growth(s, positive_only=False), positive_equity=False)
    return s.where(F.col("revenue").isNotNull()).select("ticker", "statement_date", "revenue_growth_yoy", "roe", "debt_to_equity")


@query("fnd_11_source_fallback", f"""
SELECT p.ticker, p.as_of, coalesce(p.statement_date, s.statement_date) AS statement_date,
       CASE WHEN p.statement_date IS NOT NULL THEN p.net_margin ELSE s.net_margin END AS net_margin,
       CASE WHEN p.statement_date IS NOT NULL THEN 'primary' WHEN s.statement_date IS NOT NULL THEN 'secondary' END AS origin
FROM ({asof_sql('month_universe')}) p LEFT JOIN (
  SELECT r.ticker, r.as_of, s.statement_date, s.net_margin FROM (SELECT DISTINCT ticker, as_of FROM month_universe) r
  ASOF LEFT JOIN (SELECT ticker, statement_date, net_income / nullif(revenue, 0) AS net_margin FROM stm) s ON s.ticker = r.ticker AND s.statement_date <= r.as_of - 90) s
ON s.ticker = p.ticker AND s.as_of = p.as_of""", d="net_margin")
def _(spark, sf):
    req = _month_requests(spark, sf).select("ticker", "as_of").distinct()
    primary = fnd.snapshots_asof(req, star.facts(spark, sf))
    stm = fnd.statement_ratios(star.statements(spark, sf))
    secondary = fnd.statement_asof(req, stm, ["net_margin"])
    return fnd.with_fallback(primary, secondary, ["ticker", "as_of"], ["statement_date", "net_margin"])


@query("fnd_12_shares_asof", f"SELECT * FROM ({shares('month_universe')})", d="shares")
def _(spark, sf):
    req = _month_requests(spark, sf).select("ticker", "as_of").distinct()
    return fnd.shares_asof(req, star.facts(spark, sf))


@query("fnd_13_yearly_gate_on_bars", """
SELECT b.ticker, b.date, g.gate FROM bars b LEFT JOIN gates g ON g.ticker = b.ticker AND g.year = year(b.date)""")
def _(spark, sf):
    b = star.bars(spark, sf)
    return event_study.with_yearly_gate(b.select("ticker", "date"), event_study.yearly_gates(b, star.facts(spark, sf)))


@query("fnd_14_yearly_snapshots", "SELECT * FROM snap_year WHERE statement_date IS NOT NULL", d=SNAP_D)
def _(spark, sf):
    snaps = fnd.snapshots_asof(fnd.year_end_requests(star.bars(spark, sf)), star.facts(spark, sf))
    return snaps.where(F.col("statement_date").isNotNull()).drop("year")


@query("fnd_15_gate_at_entry", f"""
SELECT ticker, as_of AS date, {gate()} AS gate FROM ({asof_sql('(SELECT ticker, date AS as_of FROM crossed)')})""")
def _(spark, sf):
    entries = event_study.score_crossings(star.bars(spark, sf)).select("ticker", "date")
    return event_study.entry_gates(entries, star.facts(spark, sf)).select("ticker", "date", "gate")


# ---------------------------------------------------------------- universe


@query("uni_01_membership_asof", """
SELECT d.date, s.members FROM bench d ASOF LEFT JOIN (SELECT date + 45 AS date, count(DISTINCT ticker) AS members FROM members GROUP BY 1) s ON s.date <= d.date""", i="members")
def _(spark, sf):
    # Snapshots become known 45 days late, so that some days precede the first one.
    late = star.membership(spark, sf).withColumn("date", F.date_add("date", 45))
    return uni.members_per_day(late, star.benchmark(star.bars(spark, sf)).select("date"))


@query("uni_02_first_trading_days", "SELECT month, as_of AS date FROM month_first")
def _(spark, sf):
    return uni.first_trading_days(star.benchmark(star.bars(spark, sf)))


@query("uni_03_monthly_universe", "SELECT month, as_of, ticker FROM month_universe")
def _(spark, sf):
    return _month_requests(spark, sf)


@query("uni_04_close_asof", """
SELECT r.month, r.as_of, r.ticker, b.close AS raw_close FROM month_universe r ASOF LEFT JOIN bars b ON b.ticker = r.ticker AND b.date <= r.as_of""", d="raw_close")
def _(spark, sf):
    return uni.close_asof(_month_requests(spark, sf), star.bars(spark, sf))


@query("uni_05_market_cap", "SELECT ticker, as_of, raw_close, shares, mcap FROM caps_month", d="raw_close shares mcap", digits=None)
def _(spark, sf):
    return _month_caps(spark, sf).drop("month")


@query("uni_06_top_n", "SELECT ticker, as_of, mcap, cap_rank FROM ranked WHERE cap_rank <= 20", d="mcap", i="cap_rank", digits=None)
def _(spark, sf):
    return uni.top_by_cap(_month_caps(spark, sf), 20).select("ticker", "as_of", "mcap", "cap_rank")


@query("uni_07_union_universe", "SELECT DISTINCT ticker FROM ranked WHERE cap_rank <= 20")
def _(spark, sf):
    return uni.union_universe(uni.top_by_cap(_month_caps(spark, sf), 20))


@query("uni_08_membership_gate", """
SELECT c.ticker, c.date FROM crossed c JOIN (SELECT ticker, CAST(date_trunc('month', as_of) AS DATE) AS month FROM ranked WHERE cap_rank <= 20) u
ON u.ticker = c.ticker AND u.month = CAST(date_trunc('month', c.date) AS DATE)""")
def _(spark, sf):
    top = uni.top_by_cap(_month_caps(spark, sf), 20)
    return uni.in_universe(event_study.score_crossings(star.bars(spark, sf)), top).select("ticker", "date")


@query("uni_09_size_sweep", """
SELECT s.size, count(*) AS rows_kept, count(DISTINCT ticker) AS tickers FROM ranked r JOIN (VALUES ('10', 10), ('20', 20), ('50', 50), ('full', 1000000000)) s(size, cap) ON r.cap_rank <= s.cap GROUP BY 1
UNION ALL SELECT 'fixed', count(*), count(DISTINCT ticker) FROM caps_month WHERE ticker IN (SELECT ticker FROM members GROUP BY 1 HAVING min(date) <= DATE '1992-06-01' AND CAST(ticker AS BIGINT) % 3 = 0) HAVING count(*) > 0""",
       i="rows_kept tickers")
def _(spark, sf):
    m = star.membership(spark, sf)
    fixed = m.groupBy("ticker").agg(F.min("date").alias("d")).where((F.col("d") <= "1992-06-01") & (F.col("ticker").cast("bigint") % 3 == 0))
    return uni.size_sweep(_month_caps(spark, sf), [10, 20, 50], fixed=fixed).groupBy("size").agg(
        F.count(F.lit(1)).alias("rows_kept"), F.count_distinct("ticker").alias("tickers"))


@query("uni_10_membership_sanity", """
SELECT date, max(members) AS members, string_agg(ticker, ',' ORDER BY ticker) FILTER (WHERE r <= 10) AS sample FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY ticker) AS r, count(*) OVER (PARTITION BY date) AS members FROM members) GROUP BY 1""", i="members")
def _(spark, sf):
    return uni.membership_sanity(star.membership(spark, sf))


@query("uni_11_average_cap", """
SELECT avg(m.mcap) AS avg_mcap, count(m.mcap) AS n FROM crossed c JOIN (SELECT ticker, CAST(date_trunc('month', as_of) AS DATE) AS month, mcap FROM caps_month) m
ON m.ticker = c.ticker AND m.month = CAST(date_trunc('month', c.date) AS DATE)""", d="avg_mcap", i="n", digits=2)
def _(spark, sf):
    return uni.average_cap(event_study.score_crossings(star.bars(spark, sf)), _month_caps(spark, sf))


# ---------------------------------------------------------------- joins


@query("joi_01_asof_backward", """
SELECT b.ticker, b.date, f.filing_date FROM bars b ASOF LEFT JOIN (SELECT DISTINCT ticker, filing_date FROM filings) f ON f.ticker = b.ticker AND f.filing_date <= b.date""")
def _(spark, sf):
    f = star.filings(spark, sf).select("ticker", F.col("filing_date").alias("t"), "filing_date").distinct()
    return asof.asof_backward(star.bars(spark, sf).select("ticker", "date"), f, ["ticker"], "date", "t", ["filing_date"])


@query("joi_02_asof_staleness", """
SELECT o.ticker, o.as_of, CASE WHEN date_diff('day', b.date, o.as_of) <= 5 THEN b.close END AS price FROM (SELECT DISTINCT ticker, filing_date AS as_of FROM filings) o
ASOF LEFT JOIN bars b ON b.ticker = o.ticker AND b.date <= o.as_of""", d="price")
def _(spark, sf):
    req = star.filings(spark, sf).select("ticker", F.col("filing_date").alias("as_of")).distinct()
    b = star.bars(spark, sf).select("ticker", "date", "close", F.col("date").alias("seen"))
    out = asof.asof_backward(req, b, ["ticker"], "as_of", "date", ["close", "seen"])
    return out.select("ticker", "as_of", asof.within_days(F.col("close"), F.col("seen"), F.col("as_of"), 5).alias("price"))


@query("joi_03_asof_lookback", """
SELECT o.ticker, o.as_of, CASE WHEN date_diff('day', b.date, o.as_of) <= 10 THEN b.close END AS price FROM (SELECT DISTINCT ticker, filing_date AS as_of FROM filings) o
ASOF LEFT JOIN bars b ON b.ticker = o.ticker AND b.date < o.as_of""", d="price")
def _(spark, sf):
    req = star.filings(spark, sf).select("ticker", F.col("filing_date").alias("as_of")).distinct()
    b = star.bars(spark, sf).select("ticker", "date", "close", F.col("date").alias("seen"))
    out = asof.asof_backward(req, b, ["ticker"], "as_of", "date", ["close", "seen"], strict=True)
    return out.select("ticker", "as_of", asof.within_days(F.col("close"), F.col("seen"), F.col("as_of"), 10).alias("price"))


@query("joi_04_forward_fill", "SELECT b.date, r.rate FROM bench b ASOF LEFT JOIN rates r ON r.date <= b.date", d="rate")
def _(spark, sf):
    from ..operators.curve import forward_fill
    return forward_fill(star.benchmark(star.bars(spark, sf)), star.rates(spark, sf), "rate")


@query("joi_05_asof_shifted", """
SELECT c.ticker, c.date, a.close AS level_now, b.close AS level_later FROM crossed c ASOF LEFT JOIN bench a ON a.date <= c.date ASOF LEFT JOIN bench b ON b.date <= c.date + 30""",
       d="level_now level_later", digits=10)
def _(spark, sf):
    from ..operators.curve import timing_cost
    b = star.bars(spark, sf)
    return timing_cost(event_study.score_crossings(b).select("ticker", "date"), star.benchmark(b)).select("ticker", "date", "level_now", "level_later")


@query("joi_06_interval_join", """
SELECT c.ticker, c.date, f.accession FROM crossed c JOIN filings f ON f.ticker = c.ticker AND f.filing_date BETWEEN c.date - 90 AND c.date""")
def _(spark, sf):
    s = event_study.score_crossings(star.bars(spark, sf)).select("ticker", "date")
    f = star.filings(spark, sf).select("ticker", "filing_date", "accession")
    return asof.interval_join(s, f, ["ticker"], "date", "filing_date", 90).select("ticker", "date", "accession")


@query("joi_07_gap_range", "SELECT a.ticker, a.period_end, b.period_end AS prior_end FROM (SELECT DISTINCT ticker, concept, period_end FROM annual WHERE item = 'revenue') a JOIN (SELECT DISTINCT ticker, concept, period_end FROM annual WHERE item = 'revenue') b ON a.ticker = b.ticker AND a.concept = b.concept AND date_diff('day', b.period_end, a.period_end) BETWEEN 280 AND 420")
def _(spark, sf):
    e = fnd.annual_entries(star.facts(spark, sf)).where(fnd.line_item(F.col("concept")) == "revenue").select("ticker", "concept", "period_end").distinct()
    shifted = e.select("ticker", "concept", "period_end", F.date_sub("period_end", 280).alias("t"))
    prior = e.select("ticker", "concept", F.col("period_end").alias("prior_end"))
    return asof.interval_join(shifted, prior, ["ticker", "concept"], "t", "prior_end", 140).select("ticker", "period_end", "prior_end")


@query("joi_08_shifted_self_join", """
SELECT a.ticker, a.as_of, a.net_margin - b.net_margin AS change FROM snap_year a LEFT JOIN snap_year b ON b.ticker = a.ticker AND b.as_of + INTERVAL 1 YEAR = a.as_of""", d="change")
def _(spark, sf):
    s = fnd.snapshots_asof(fnd.year_end_requests(star.bars(spark, sf)), star.facts(spark, sf))
    prior = s.select("ticker", F.add_months("as_of", 12).alias("as_of"), F.col("net_margin").alias("p"))
    return s.join(prior, ["ticker", "as_of"], "left").select("ticker", "as_of", (F.col("net_margin") - F.col("p")).alias("change"))


@query("joi_09_left_default", """
SELECT f.ticker, f.filing_date, coalesce(r.regime, 'unknown') AS regime, count(*) AS n FROM filings f LEFT JOIN regimes r ON r.date = f.filing_date GROUP BY 1, 2, 3""", i="n")
def _(spark, sf):
    f = star.filings(spark, sf).groupBy("ticker", "filing_date").agg(F.count(F.lit(1)).alias("n"))
    reg = events.slope_regime(star.benchmark(star.bars(spark, sf)))
    return events.label_by_date(f.withColumnRenamed("filing_date", "date"), reg, "regime").select(
        "ticker", F.col("date").alias("filing_date"), "regime", "n")


@query("joi_10_semi", "SELECT ticker, count(*) AS n FROM bars WHERE ticker IN (SELECT ticker FROM crossed) GROUP BY 1", i="n")
def _(spark, sf):
    b = star.bars(spark, sf)
    ever = event_study.score_crossings(b).select("ticker").distinct()
    return b.join(ever, "ticker", "left_semi").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("joi_11_anti", "SELECT DISTINCT ticker, filing_date FROM filings f WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = f.ticker AND b.date = f.filing_date)")
def _(spark, sf):
    f = star.filings(spark, sf).select("ticker", "filing_date").distinct()
    b = star.bars(spark, sf).select("ticker", F.col("date").alias("filing_date"))
    return f.join(b, ["ticker", "filing_date"], "left_anti")


@query("joi_12_parameter_grid", """
SELECT t.threshold, count(*) AS n FROM scored s JOIN (VALUES (CAST(0.60 AS DOUBLE)), (CAST(0.65 AS DOUBLE)), (CAST(0.70 AS DOUBLE)), (CAST(0.75 AS DOUBLE))) t(threshold) ON s.composite_score >= t.threshold GROUP BY 1""", d="threshold", i="n")
def _(spark, sf):
    rows = event_study.indicators.recovery_scores(has_history(star.bars(spark, sf), 252))
    return studies.over_thresholds(rows, [0.60, 0.65, 0.70, 0.75]).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))


@query("joi_14_wide_alignment", """
SELECT g.ticker, g.date, b.close, b.date <> g.date AS filled FROM (
 SELECT s.ticker, d.date FROM (SELECT ticker, min(date) AS a, max(date) AS z FROM bars GROUP BY 1) s JOIN bench d ON d.date BETWEEN s.a AND s.z) g
ASOF JOIN bars b ON b.ticker = g.ticker AND b.date <= g.date""", d="close")
def _(spark, sf):
    b = star.bars(spark, sf)
    return curve.aligned(b, star.benchmark(b))


# ---------------------------------------------------------------- vetoes

BEST = """
SELECT s.ticker, s.date, d.item, d.filing_date FROM crossed s LEFT JOIN distress d ON d.ticker = s.ticker AND d.filing_date BETWEEN s.date - 90 AND s.date
QUALIFY row_number() OVER (PARTITION BY s.ticker, s.date ORDER BY d.filing_date DESC, d.accession) = 1"""
LABEL = """CASE item WHEN '1.03' THEN 'Bankruptcy or Receivership' WHEN '4.01' THEN 'Change in Registrant''s Certifying Accountant (auditor red flag)'
WHEN '4.02' THEN 'Non-Reliance on Previously Issued Financial Statements (restatement)' ELSE 'Material Cybersecurity Incident' END"""


def _signals(spark, sf):
    return event_study.score_crossings(star.bars(spark, sf)).select("ticker", "date", F.lit("BUY").alias("signal"))


@query("vet_01_distress_events", "SELECT ticker, filing_date, accession, item FROM distress")
def _(spark, sf):
    return veto.distress_events(star.filings(spark, sf)).select("ticker", "filing_date", "accession", "item")


@query("vet_02_veto", f"""
SELECT ticker, date, item IS NOT NULL AS blocked, CASE WHEN item IS NULL THEN '' ELSE '8-K Item ' || item || ' filed ' || strftime(filing_date, '%Y-%m-%d') || ': ' || {LABEL} END AS reason FROM ({BEST})""")
def _(spark, sf):
    return veto.veto(_signals(spark, sf), star.filings(spark, sf)).drop("signal")


@query("vet_03_going_concern_text", "SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'and') AS concern FROM documents")
def _(spark, sf):
    return veto.flag_documents(star.table(spark, sf, "documents"), ("the", "and"))


REPORT = """
SELECT s.ticker, s.date, r.filing_date, r.form, r.doc_id FROM crossed s LEFT JOIN filings r ON r.ticker = s.ticker AND r.form IN ('10-K', '10-Q') AND r.filing_date <= s.date
QUALIFY row_number() OVER (PARTITION BY s.ticker, s.date ORDER BY r.filing_date DESC, r.accession) = 1"""


@query("vet_04_latest_report", f"""
SELECT q.ticker, q.date, q.form AS report_form, q.filing_date AS report_date, coalesce(contains(lower(d.text), 'the') AND contains(lower(d.text), 'and'), FALSE) AS concern
FROM ({REPORT}) q LEFT JOIN documents d ON d.doc_id = q.doc_id""")
def _(spark, sf):
    flags = veto.flag_documents(star.table(spark, sf, "documents"), ("the", "and"))
    return veto.going_concern(_signals(spark, sf), star.filings(spark, sf), flags).select("ticker", "date", "report_form", "report_date", "concern")


@query("vet_05_unverifiable", f"""
SELECT ticker, date, item IS NOT NULL AND CAST(ticker AS BIGINT) % 4 <> 0 AS blocked, CASE WHEN CAST(ticker AS BIGINT) % 4 = 0 THEN 'unverifiable: no filing record for ' || ticker WHEN item IS NULL THEN '' ELSE '8-K Item ' || item || ' filed ' || strftime(filing_date, '%Y-%m-%d') || ': ' || {LABEL} END AS reason FROM ({BEST})""")
def _(spark, sf):
    known = star.filings(spark, sf).where(F.col("ticker").cast("bigint") % 4 != 0)
    return veto.veto(_signals(spark, sf), known).drop("signal")


ROWS_SIGNAL = "CASE WHEN composite_score >= CAST(0.6 AS DOUBLE) THEN 'BUY' ELSE 'WAIT' END"


@query("vet_06_veto_buys", f'''
SELECT signal, count(*) AS n FROM (SELECT s.ticker, s.date, CASE WHEN s.composite_score >= CAST(0.6 AS DOUBLE) AND (EXISTS (
  SELECT 1 FROM distress d WHERE d.ticker = s.ticker AND d.filing_date BETWEEN s.date - 90 AND s.date) OR coalesce(contains(lower(x.text), 'the') AND contains(lower(x.text), 'and'), FALSE)) THEN 'VETO' ELSE {ROWS_SIGNAL.replace('composite', 's.composite')} END AS signal
  FROM scored s LEFT JOIN (SELECT s.ticker, s.date, r.doc_id FROM scored s JOIN filings r ON r.ticker = s.ticker AND r.form IN ('10-K', '10-Q') AND r.filing_date <= s.date
   QUALIFY row_number() OVER (PARTITION BY s.ticker, s.date ORDER BY r.filing_date DESC, r.accession) = 1) q ON q.ticker = s.ticker AND q.date = s.date
  LEFT JOIN documents x ON x.doc_id = q.doc_id WHERE s.composite_score IS NOT NULL) GROUP BY 1''', i="n")
def _(spark, sf):
    rows = event_study.indicators.recovery_scores(has_history(star.bars(spark, sf), 252)).where(F.col("composite_score").isNotNull())
    rows = rows.select("ticker", "date", F.when(F.col("composite_score") >= 0.60, "BUY").otherwise("WAIT").alias("signal"))
    flags = veto.flag_documents(star.table(spark, sf, "documents"), ("the", "and"))
    return veto.veto_buys(rows, star.filings(spark, sf), flags=flags).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


@query("udf_02_pluggable_veto", f"""
SELECT signal, count(*) AS n FROM (SELECT s.ticker, CASE WHEN s.composite_score >= CAST(0.6 AS DOUBLE) AND year(s.date) = 2000 THEN 'VETO' ELSE {ROWS_SIGNAL} END AS signal
  FROM scored s WHERE s.composite_score IS NOT NULL) GROUP BY 1""", i="n")
def _(spark, sf):
    rows = event_study.indicators.recovery_scores(has_history(star.bars(spark, sf), 252)).where(F.col("composite_score").isNotNull())
    rows = rows.select("ticker", "date", F.when(F.col("composite_score") >= 0.60, "BUY").otherwise("WAIT").alias("signal"))
    rule = lambda signals, _f: signals.withColumns({"blocked": F.year("date") == 2000, "reason": F.lit("closed year")})
    return veto.veto_buys(rows, star.filings(spark, sf), rule=rule).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


@query("vet_07_distress_census", """
SELECT item, count(*) AS events, count(DISTINCT ticker) AS tickers FROM distress WHERE filing_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1""", i="events tickers")
def _(spark, sf):
    day = lambda s: F.lit(s).cast("date")
    return veto.distress_census(star.filings(spark, sf), day("1996-01-01"), day("1999-12-31"))


@query("vet_08_blocked_returns", f"""
SELECT b.item IS NOT NULL AS blocked, count(t.trade_return) AS n, avg(t.trade_return) AS mean_return FROM ({BEST}) b JOIN trades t ON t.ticker = b.ticker AND t.date = b.date GROUP BY 1""",
       d="mean_return", i="n")
def _(spark, sf):
    trades = event_study.crossing_trades(star.bars(spark, sf), 63).select("ticker", "date", "trade_return")
    return veto.veto(trades, star.filings(spark, sf)).groupBy("blocked").agg(
        F.count("trade_return").alias("n"), F.avg("trade_return").alias("mean_return"))
