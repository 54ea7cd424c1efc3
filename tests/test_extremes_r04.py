"""Running extremes inside path arrays: found once a path, whatever its length."""
import datetime as dt
import random

from pyspark.sql import functions as F

from pitscreen.operators import exits

PATHS = "ticker string, entry_date date, entry_price double, entry_atr double, ahead array<struct<d: date, c: double, a: double>>"


def paths(spark, lengths, gaps=False):
    rng, day = random.Random(4), dt.date(2020, 1, 1)
    bar = lambda i: (day + dt.timedelta(i), None if gaps and rng.random() < 0.3 else rng.uniform(50, 150), None)
    return spark.createDataFrame([("A", day + dt.timedelta(k), 100.0 + k, None, [bar(i) for i in range(n)]) for k, n in enumerate(lengths)], PATHS)


def test_no_filter_finds_the_extremes_again(spark):
    plan = exits.array_extremes(paths(spark, [3]))._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter " in line]
    assert "least(" in plan and not any("least(" in line or "size(" in line for line in filters)


def test_extremes_of_any_length_and_with_missing_closes(spark):
    key = ("ticker", "entry_date", "day", "run_min", "run_max")
    for gaps in (False, True):
        arrays = paths(spark, [0, 1, 2, 3, 4, 7, 8, 9, 31, 32, 33, 255, 256, 257, 600], gaps)
        want = exits.running_extremes(exits.long_paths(arrays)).select(*key).collect()
        assert len(want) == arrays.agg(F.sum(F.size("ahead"))).first()[0]
        order = lambda rows: sorted(map(tuple, rows), key=lambda r: r[:3])
        assert order(exits.array_extremes(arrays).select(*key).collect()) == order(want)
