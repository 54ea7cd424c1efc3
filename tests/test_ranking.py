import numpy as np
import pandas as pd
import pytest

from pitscreen.operators import cross_section as xs
from pitscreen.operators.ranking import average_ranks, exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value a third of them, and the tail is long."""
    rng = np.random.default_rng(2)
    v = np.concatenate([np.full(1000, 0.5), rng.normal(0, 1, 1500), rng.pareto(0.7, 500) * 1000])
    pdf = pd.DataFrame({"g": "hot", "v": v})
    pdf = pd.concat([pdf, pd.DataFrame({"g": "small", "v": [3.0, 1.0, 2.0]}), pd.DataFrame({"g": "small", "v": [np.nan]})])
    pdf["id"] = range(len(pdf))
    rows = [(g, None if np.isnan(x) else float(x), int(i)) for g, x, i in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "g string, v double, id bigint")


def test_quantiles_equal_numpy(skewed):
    pdf, df = skewed
    got = exact_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.9}).toPandas().set_index("g")
    for g, part in pdf.dropna().groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.percentile(part.v, [10, 50, 90]), rtol=1e-12)


def test_ranks_equal_pandas(skewed):
    pdf, df = skewed
    got = average_ranks(df, ["g"], "v", "r").toPandas().sort_values("id").r.to_numpy()
    assert np.allclose(got, (pdf.groupby("g").v.rank(pct=True) * 100).to_numpy(), equal_nan=True)


@pytest.mark.parametrize("direction,want", [(1, 0.30), (-1, -0.30)])
def test_decile_spread(spark, direction, want):
    rows = [(float(i), 0.2 if i >= 18 else -0.1 if i < 2 else 0.05) for i in range(20)]
    df = spark.createDataFrame([("d", x * direction, r) for x, r in rows], "k string, x double, r double")
    assert xs.decile_spreads(df, ["k"], "x", "r").first().spread == pytest.approx(want)
    assert xs.decile_spreads(df.limit(19), ["k"], "x", "r").first().spread is None


def test_composite_redistributes_missing_weights(spark):
    df = spark.createDataFrame([("A", 100.0, 50.0, 80.0, None), ("B", 100.0, None, None, 20.0)],
                               "ticker string, rank_growth double, rank_de double, rank_momentum double, rank_roe double")
    got = {r.ticker: r for r in xs.composite(df).collect()}
    assert got["A"].composite_score == pytest.approx((0.30 * 100 + 0.25 * 50 + 0.25 * 80) / 0.80)
    assert got["B"].composite_score is None and got["B"].factors_available == 2


def test_outliers_and_ties_leave_small_bins(spark):
    """Bulk in [0, 1), a third of all rows tied, and outliers at two scales: no bin holds more than a sliver of the values."""
    from pyspark.sql import functions as F

    from pitscreen.operators import ranking
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.random(20_000), np.full(10_000, 0.25), [1e9, 1e12, -1e12, 0.0]])
    df = spark.createDataFrame([("g", float(x)) for x in v], "g string, v double")
    coarse, fine = ranking._bins(F.col("v"))
    per_bin = df.distinct().groupBy(coarse.alias("a"), fine.alias("b")).count().agg(F.max("count"), F.count("*")).first()
    per_coarse = df.distinct().groupBy(coarse.alias("a")).count().agg(F.max("count")).first()[0]
    assert per_bin[0] < 20 and per_bin[1] > 15_000 and per_coarse < 500
    got = exact_quantiles(df, ["g"], "v", {"a": 0.001, "b": 0.5, "c": 0.9999}).first()
    assert np.allclose([got.a, got.b, got.c], np.percentile(v, [0.1, 50, 99.99]), rtol=1e-12)


def test_plans_build_without_running_anything(spark):
    df = spark.createDataFrame([("g", 1.0)], "g string, v double")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    exact_quantiles(df, ["g"], "v", {"a": 0.5})
    average_ranks(df, ["g"], "v", "r")
    xs.decile_spreads(df.withColumn("r", df.v), ["g"], "v", "r")
    assert len(tracker.getJobIdsForGroup(None)) == before
