"""Null discipline: NULL means missing, NaN never leaves a source."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def holds(condition: Column) -> Column:
    """A condition that is FALSE, not NULL, when an input is missing."""
    return F.coalesce(condition, F.lit(False))


def number(col: Column | str) -> Column:
    """Parse text to a finite-or-null double: bad text, NaN and null all give NULL."""
    value = F.col(col) if isinstance(col, str) else col
    parsed = value.cast("string").try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL on a zero or missing denominator."""
    return F.try_divide(numerator, denominator)


#: Relative difference up to which two averages are the same: far above the rounding of a sum of prices, which depends on
#: the order of its terms, and far below a step in a price.
EVEN = 1e-12


def above(a: Column, b: Column) -> Column:
    """Whether a lies above b by more than rounding; for values of one sign such as prices."""
    return a > b * (1 + EVEN)
