import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from pitscreen.catalog import ORACLES, QUERIES
from pitscreen.streaming import runner, state

SMALL = "/root/testdata/sf0.001"


def test_signal_changes_ignore_replayed_days(spark):
    day = lambda d: dt.date(2024, 1, d)
    make = lambda rows: spark.createDataFrame(rows, "ticker string, date date, signal string")
    first = make([("A", day(2), "BUY"), ("A", day(3), "BUY"), ("B", day(2), "WATCH")])
    again = make([("A", day(3), "WATCH"), ("A", day(4), "SKIP"), ("B", day(3), "BUY")])
    out = runner.run_to_files([first, again], state.signal_changes, "t").collect()
    assert sorted((r.ticker, r.date.day, r.status) for r in out) == [("A", 2, "NEW"), ("A", 3, "CONTINUING"), ("A", 4, "DROPPED"), ("B", 3, "NEW")]


def test_every_operator_family_is_registered():
    families = {"src": 14, "snk": 4, "ind": 10, "scr": 16, "fnd": 15, "uni": 11, "joi": 14, "vet": 8, "evt": 22, "ext": 10, "agg": 38, "job": 11,
                "srt": 3, "set": 2, "fn": 15, "str": 5, "udf": 5}
    for family, n in families.items():
        have = {int(name.split("_")[1]) for name in QUERIES if name.split("_")[0] == family}
        assert have == set(range(1, n + 1)), family
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["scr_08_recovery_composite", "fnd_06_snapshot_asof", "uni_06_top_n", "vet_02_veto", "evt_16_min_gap", "agg_05_regime_capture",
                                  "agg_11_factor_reliability", "job_01_daily_screen", "str_03_thinned_crossings"])
def test_query_equals_sql(spark, name):
    import check
    problem, _ = check.compare(QUERIES[name](spark, SMALL), check.connect(SMALL), ORACLES[name])
    assert problem is None
