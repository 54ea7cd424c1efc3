import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pitscreen.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


def weekdays(n, start=dt.date(2016, 1, 1)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


@pytest.fixture
def make_bars(spark):
    """Bars from {ticker: closes}; high and low half a percent around the close."""
    def build(series, volumes=None):
        rows = []
        for t, closes in series.items():
            for i, (d, c) in enumerate(zip(weekdays(len(closes)), closes)):
                v = volumes[i] if volumes is not None else 1e6
                c = float(c)
                rows.append((t, d, c, c * 1.005, c * 0.995, c, float(v)))
        return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    return build
