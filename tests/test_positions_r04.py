"""The life of positions with one timer per ticker."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest

from pitscreen.streaming import runner, state


def weekdays(first, n):
    return np.busday_offset(np.datetime64(first), np.arange(n), roll="forward").astype(object).tolist()


class Value:
    """A state value and a handle that counts what is asked of them."""
    def __init__(self):
        self.value, self.asked, self.timers = None, 0, []

    def exists(self):
        return self.value is not None

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, ms):
        self.timers.append(ms)


class At:
    def __init__(self, day):
        self.ms = int(np.datetime64(day).astype(int)) * state.DAY_MS

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def test_a_ticker_has_one_timer_however_many_positions_it_holds():
    days = weekdays("2020-01-01", 420)
    value = Value()
    life = state.PositionLifecycle()
    life.handle = life.state = value
    rows = pd.DataFrame({"date": days, "day": np.array(days, "datetime64[D]").astype("i4"), "close": 100.0 + np.arange(420), "opened": np.arange(420) < 100})
    assert not any(len(f) for f in life.handleInputRows(("A",), iter([rows]), At("1970-01-01")))
    assert value.timers == [At(days[222]).ms]
    before, reached = value.asked, days[300]
    told = pd.concat(life.handleExpiredTimer(("A",), At(reached), At(days[222])))
    want = sorted((days[i], days[i + held], alert) for i in range(100) for alert, held in (("REMINDER", 222), ("EXIT", 252)) if i + held <= 300)
    assert sorted(zip(told["entry_date"], told["date"], told["alert"])) == want
    assert value.asked == before + 1 and value.timers[1:] == [At(days[301]).ms]


@pytest.mark.parametrize("cuts", [[400], [30, 60, 250, 251, 290, 400], list(range(20, 401, 95)) + [400]])
def test_alerts_do_not_depend_on_the_deliveries(spark, cuts):
    """Positions come late and out of order inside the watermark, so an earlier day overtakes the timer that is set."""
    days = weekdays("2020-01-01", 400)
    opened = {"A": {5, 18, 19, 40}, "B": {17}, "C": set(), "D": {0, 1, 2, 130}}
    close = lambda t, i: None if (i + ord(t)) % 7 == 0 and i not in opened[t] else 50.0 + ord(t) + i
    rows = [(t, d, close(t, i), i in opened[t]) for t in opened for i, d in enumerate(days) if not (t == "D" and i > 200)]
    late = {("A", days[5]), ("A", days[18])}                       # they come a delivery later, with the rows up to 12 weekdays after the cut
    place = {d: i for i, d in enumerate(days)}
    batch = lambda r: next(k for k, c in enumerate(cuts) if place[r[1]] < c)
    parts = [[] for _ in cuts]
    for r in rows:
        k = batch(r)
        parts[min(k + 1, len(cuts) - 1) if (r[0], r[1]) in late else k].append(r)
    make = lambda some: spark.createDataFrame(some, "ticker string, date date, close double, opened boolean")
    out = runner.run_to_files([make(p) for p in parts], lambda s: state.position_lifecycle(s, "120 days"), "life").collect()
    end, want = days[-1] - dt.timedelta(120), {}
    for t, places in opened.items():
        for i in places:
            for alert, held in (("REMINDER", 222), ("EXIT", 252)):
                if i + held < 400 and days[i + held] <= end:
                    last = [r[2] for r in rows if r[0] == t and r[2] is not None and r[1] <= days[i + held]][-1]
                    want[t, days[i], alert] = (days[i + held], held, last / close(t, i) - 1)
    got = {(r.ticker, r.entry_date, r.alert): (r.date, r.days_held, pytest.approx(r.ret)) for r in out}
    assert len(out) == len(want) > 6 and got == want
