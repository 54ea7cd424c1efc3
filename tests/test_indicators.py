import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitscreen.functions import tiers
from pitscreen.operators import indicators as ind


def frame(df, *cols):
    return df.orderBy("ticker", "date").select(*cols).toPandas()


def test_constant_rise_scores_full_trend(make_bars):
    out = frame(ind.entry_scores(make_bars({"A": 100 * 1.002 ** np.arange(300)})), "trend_score", "momentum_score", "rsi_14", "signal")
    last = out.iloc[-1]
    assert last.trend_score == 1.0 and last.momentum_score == 1.0
    assert last.rsi_14 == pytest.approx(100, abs=1e-6)
    assert out.signal.iloc[50] == "INSUFFICIENT_DATA"


def test_flat_series_has_neutral_rsi(make_bars):
    out = frame(ind.rsi(make_bars({"A": [50.0] * 40})), "rsi_14")
    assert out.rsi_14.iloc[0] != out.rsi_14.iloc[0] and (out.rsi_14.iloc[1:] == 50.0).all()


@pytest.mark.parametrize("late,score", [(3.0, 1.0), (1.7, 0.8), (1.1, 0.5), (0.85, 0.3), (0.3, 0.1)])
def test_volume_tiers(make_bars, late, score):
    vol = [1e6] * 290 + [late * 1e6] * 10
    out = frame(ind.recovery_scores(make_bars({"A": [100.0] * 300}, vol)), "volume_score")
    assert out.volume_score.iloc[-1] == score


@pytest.mark.parametrize("fall,score", [(0.25, 0.0), (0.35, 0.7), (0.40, 1.0), (0.60, 1.0), (0.65, 0.5), (0.75, 0.0)])
def test_dip_tiers(spark, fall, score):
    assert spark.range(1).select(tiers.dip_score(F.lit(fall))).first()[0] == score


def test_rolling_needs_full_window(make_bars):
    out = frame(ind.rolling_high(make_bars({"A": np.arange(1, 260)})), "high_52w")
    assert out.high_52w.isna().sum() == 251 and out.high_52w.iloc[-1] == 259


def test_ema_matches_pandas_and_grouped_map(make_bars):
    x = np.random.default_rng(3).uniform(10, 90, 700)
    bars = make_bars({"A": x, "B": x[:5]})
    want = pd.Series(x).ewm(alpha=1 / 14, adjust=False).mean().to_numpy()
    a = ind.ema(bars, 1 / 14, {"ema": "close"}).where("ticker = 'A'").orderBy("date").toPandas().ema.to_numpy()
    b = ind.ema_grouped(bars, 1 / 14).where("ticker = 'A'").orderBy("date").toPandas().ema.to_numpy()
    assert np.allclose(a, want, rtol=1e-12) and np.allclose(b, want, rtol=1e-12)


def test_later_bars_do_not_change_earlier_scores(make_bars):
    x = np.random.default_rng(5).uniform(20, 90, 420)
    cols = ["date", "composite_score", "atr_14", "recovery_score", "rsi_14"]
    full = frame(ind.recovery_scores(make_bars({"A": x}), with_rsi=True), *cols)
    cut = frame(ind.recovery_scores(make_bars({"A": x[:350]}), with_rsi=True), *cols)
    pd.testing.assert_frame_equal(full.iloc[:350], cut)


@pytest.mark.parametrize("row,gate", [((0.1, 1.0, 0.2), True), ((-0.1, 1.0, 0.2), False), ((0.1, None, 0.2), False), ((0.1, 3.0, 0.2), False),
                                      ((None, 1.0, 0.2), None), ((0.1, 1.0, None), None)])
def test_gate_is_fail_closed(spark, row, gate):
    df = spark.createDataFrame([row], "g double, d double, m double")
    got = df.select(tiers.quality_gate(F.col("g"), F.col("d"), F.col("m")).alias("gate"),
                    tiers.recovery_signal(F.lit(0.9), tiers.quality_gate(F.col("g"), F.col("d"), F.col("m"))).alias("s")).first()
    assert got.gate is gate and got.s == ("BUY" if gate else "SKIP")
