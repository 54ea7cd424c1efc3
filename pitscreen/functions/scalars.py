"""Scalar helpers on symbols, dates and returns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Expected-return anchors (days held, cumulative return) and the
# return thresholds with their percentile.
RETURN_ANCHORS = [(0, 0.0), (21, 0.020), (63, 0.064), (252, 0.492)]
PERCENTILE_STEPS = [(-0.45, 5), (-0.25, 15), (-0.15, 25), (-0.10, 35), (0.00, 45),
                    (0.20, 60), (0.40, 75), (0.70, 90), (1.50, 99)]


def market_symbol(symbol: Column, suffix: str = ".US") -> Column:
    """Trim, upper-case, class dots to dashes, one market suffix."""
    bare = F.regexp_replace(F.upper(F.trim(symbol)), r"\.US$", "")
    return F.concat(F.replace(bare, F.lit("."), F.lit("-")), F.lit(suffix))


def safe_identifier(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "")


def split_list(text: Column, sep: str = ",") -> Column:
    """Separated text to an array of trimmed, non-empty entries; NULL gives an empty array."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), sep), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def _weekdays_before(day: Column) -> Column:
    # 1969-12-29 is a Monday, so k counts days since a week start.
    k = F.datediff(day, F.lit("1969-12-29").cast("date"))
    return 5 * F.floor(k / 7) + F.least(F.pmod(k, F.lit(7)), F.lit(5))


def business_days(start: Column, end: Column) -> Column:
    """Weekdays in [start, end); negative when end lies before start."""
    return (_weekdays_before(end) - _weekdays_before(start)).cast("bigint")


def previous_weekday(day: Column) -> Column:
    back = F.when(F.dayofweek(day) == 2, 3).when(F.dayofweek(day) == 1, 2).otherwise(1)
    return F.date_sub(day, back)


def expected_return(days: Column) -> Column:
    """Straight lines between the anchors, flat after the last one and before the first: the first return plus
    the slope of each line times the days spent on it. NULL days give NULL."""
    total = F.lit(RETURN_ANCHORS[0][1])
    for left, right in zip(RETURN_ANCHORS, RETURN_ANCHORS[1:]):
        length = float(right[0] - left[0])
        spent = F.greatest(F.lit(0.0), F.least(F.lit(length), days.cast("double") - float(left[0])))
        total = total + F.lit((right[1] - left[1]) / length) * spent
    return F.when(days.isNotNull(), total)


def percentile_step(ret: Column) -> Column:
    """Percentile of the lowest threshold at or above the return; NULL stays NULL."""
    steps = F.array(*[F.struct(F.lit(float(limit)).alias("limit"), F.lit(pct).alias("pct")) for limit, pct in PERCENTILE_STEPS])
    reached = F.try_element_at(F.filter(steps, lambda s: ret <= s["limit"]), F.lit(1))["pct"]
    return F.when(ret.isNotNull(), F.coalesce(reached, F.lit(PERCENTILE_STEPS[-1][1]))).cast("bigint")


def return_zone(ret: Column) -> Column:
    return (F.when(ret < -0.20, "deep_loss").when(ret < 0, "loss")
            .when(ret < 0.20, "gain").when(ret >= 0.20, "strong_gain"))


def as_fraction(threshold: Column) -> Column:
    """Thresholds above 1 are percentages."""
    return F.when(threshold > 1, threshold / 100.0).otherwise(threshold)


def month_key(day: Column) -> Column:
    return F.trunc(day, "month")


def cagr(total_return: Column, days: Column) -> Column:
    """Annual growth over days/365.25 years, never less than one year."""
    years = F.greatest(days / F.lit(365.25), F.lit(1.0))
    return F.pow(1 + total_return, 1 / years) - 1
