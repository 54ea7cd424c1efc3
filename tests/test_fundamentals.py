import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitscreen.operators import fundamentals as fnd
from pitscreen.sources import facts as src

SCHEMA = "ticker string, taxonomy string, concept string, unit string, form string, fp string, period_end date, filed date, val double"


def fact(concept, end, filed, val, form="10-K", fp="FY"):
    return ("A", "us-gaap", concept, "USD", form, fp, dt.date.fromisoformat(end), dt.date.fromisoformat(filed), float(val))


ROWS = [fact("Revenues", "2019-12-31", "2020-02-01", 80), fact("Revenues", "2020-12-31", "2021-02-01", 100), fact("Revenues", "2020-12-31", "2022-02-01", 101),
        fact("NetIncomeLoss", "2020-12-31", "2021-02-01", 10), fact("StockholdersEquity", "2020-12-31", "2021-02-01", 50),
        fact("LongTermDebt", "2020-12-31", "2021-02-01", 25), fact("Revenues", "2021-03-31", "2021-04-01", 30, "10-Q", "Q1")]


def snap(spark, rows, as_of):
    req = spark.createDataFrame([("A", dt.date.fromisoformat(as_of))], "ticker string, as_of date")
    return fnd.snapshots_asof(req, spark.createDataFrame(rows, SCHEMA)).first()


def test_amendment_counts_only_once_public(spark):
    before, after = snap(spark, ROWS, "2021-12-31"), snap(spark, ROWS, "2022-12-31")
    assert before.revenue_growth_yoy == pytest.approx(0.25) and before.net_margin == pytest.approx(0.10)
    assert after.revenue_growth_yoy == pytest.approx(101 / 80 - 1) and after.filed_date == dt.date(2022, 2, 1)
    assert before.debt_to_equity == pytest.approx(0.5) and before.roe == pytest.approx(0.2)


def test_publication_lag_is_inclusive(spark):
    assert snap(spark, ROWS, "2021-05-02").statement_date == dt.date(2020, 12, 31)
    assert snap(spark, ROWS, "2021-05-01").statement_date == dt.date(2019, 12, 31)
    assert snap(spark, ROWS, "2019-01-01").statement_date is None


def test_bad_equity_leaves_ratios_unknown(spark):
    rows = [r if r[2] != "StockholdersEquity" else fact("StockholdersEquity", "2020-12-31", "2021-02-01", -5) for r in ROWS]
    got = snap(spark, rows, "2021-12-31")
    assert got.debt_to_equity is None and got.roe is None and got.net_margin is not None


def test_concept_switch_uses_the_newest_period(spark):
    rows = ROWS + [fact("RevenueFromContractWithCustomerExcludingAssessedTax", "2021-12-31", "2022-02-01", 150)]
    got = snap(spark, rows, "2022-12-31")
    assert got.statement_date == dt.date(2021, 12, 31) and got.revenue_growth_yoy is None


def test_future_facts_change_nothing(spark):
    later = ROWS + [fact("Revenues", "2020-12-31", "2023-02-01", 1), fact("Revenues", "2022-12-31", "2023-02-01", 1)]
    assert snap(spark, later, "2022-12-31") == snap(spark, ROWS, "2022-12-31")


def test_zero_share_count_is_skipped(spark):
    share = lambda tax, con, filed, val: ("A", tax, con, "shares", "10-Q", "Q1", dt.date(2020, 1, 1), dt.date.fromisoformat(filed), float(val))
    rows = [share("dei", "EntityCommonStockSharesOutstanding", "2020-02-01", 7), share("dei", "EntityCommonStockSharesOutstanding", "2020-03-01", 0),
            share("us-gaap", "CommonStockSharesOutstanding", "2020-01-15", 9)]
    req = spark.createDataFrame([("A", dt.date(2020, 4, 20)), ("A", dt.date(2020, 12, 1))], "ticker string, as_of date")
    got = {r.as_of: r.shares for r in fnd.shares_asof(req, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {dt.date(2020, 4, 20): 9.0, dt.date(2020, 12, 1): 7.0}


@pytest.mark.parametrize("label", ["TotalRevenue", "Total Revenue", "OperatingRevenue", "Operating Revenue"])
def test_alias_spellings_agree(spark, label):
    wide = spark.createDataFrame([("A", label, 120.0, 100.0), ("A", "Net Income", 12.0, None)], "ticker string, label string, `2021-12-31` double, `2020-12-31` double")
    got = {str(r.statement_date): (r.revenue, r.net_income) for r in src.wide_statement(wide).collect()}
    assert got == {"2021-12-31": (120.0, 12.0), "2020-12-31": (100.0, None)}


def test_vendor_growth_and_filing_date(spark):
    doc = """{"Financials":{"Income_Statement":{"yearly":{"2020-12-31":{"date":"2020-12-31","filing_date":"2021-02-20","totalRevenue":"100","netIncome":"5"},
      "2021-12-31":{"date":"2021-12-31","filing_date":"2022-02-20","totalRevenue":"133","netIncome":"None"}}},
      "Balance_Sheet":{"yearly":{"2021-12-31":{"longTermDebtTotal":"109","totalStockholderEquity":"63"}}}}}"""
    rows = fnd.statement_ratios(fnd.period_growth(src.vendor_statements(spark.createDataFrame([("A", doc)], "ticker string, json string"))))
    got = {r.statement_date.year: r for r in rows.collect()}
    assert got[2021].revenue_growth_yoy == pytest.approx(0.33) and got[2021].debt_to_equity == pytest.approx(109 / 63)
    req = spark.createDataFrame([("A", dt.date(2022, 2, 19)), ("A", dt.date(2022, 2, 20))], "ticker string, as_of date")
    seen = {str(r.as_of): r.statement_date.year for r in fnd.filed_asof(req, rows, ["revenue"]).collect()}
    assert seen == {"2022-02-19": 2020, "2022-02-20": 2021}


def test_companies_on_one_day_equal_the_timed_snapshots(spark):
    """Random restatements, concept changes, missing items, null values and late filings."""
    import random
    rnd, rows = random.Random(3), []
    names = ["Revenues", "SalesRevenueNet", "NetIncomeLoss", "StockholdersEquity", "LongTermDebt", "LongTermDebtNoncurrent"]
    for t in range(30):
        for year in range(2016, 2022):
            for name in names:
                for again in (0, 370):
                    if rnd.random() < 0.6:
                        end, val = dt.date(year, 12, 31), None if rnd.random() < 0.05 else float(rnd.randint(-20, 200))
                        rows.append((f"T{t}", "us-gaap", name, "USD", rnd.choice(["10-K", "10-K", "10-Q"]), "FY", end, end + dt.timedelta(rnd.randint(20, 150) + again), val))
            for taxonomy, name in fnd.SHARE_CONCEPTS:
                if rnd.random() < 0.5:
                    end = None if rnd.random() < 0.2 else dt.date(year, 12, 31)
                    rows.append((f"T{t}", taxonomy, name, "shares", "10-K", "FY", end, dt.date(year + 1, rnd.randint(1, 12), 1), float(rnd.choice([0, -5, 100, 200]))))
    facts = spark.createDataFrame(rows, SCHEMA)
    day = dt.date(2020, 9, 1)
    ask = spark.createDataFrame([(f"T{t}", day) for t in range(32)], "ticker string, as_of date")
    want = fnd.shares_asof(fnd.snapshots_asof(ask, facts), facts).select("ticker", *fnd.SNAPSHOT_COLUMNS, "shares").orderBy("ticker").collect()
    got = ask.join(fnd.companies_on(facts, F.lit(day)), "ticker", "left").select("ticker", *fnd.SNAPSHOT_COLUMNS, "shares").orderBy("ticker").collect()
    assert got == want and sum(r.revenue_growth_yoy is not None for r in got) > 5 and sum(r.shares is not None for r in got) > 5
