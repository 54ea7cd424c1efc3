"""Piecewise scores and labels. Every function maps columns to a column."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .guards import above, holds

# Score weights and thresholds.
RECOVERY_WEIGHTS = {"dip": 0.5, "momentum": 0.3, "volume": 0.2}
ENTRY_WEIGHTS = {"trend": 0.3, "momentum": 0.3, "volume": 0.2, "rsi": 0.2}
RECOVERY_BUY = 0.60
RECOVERY_LOW = 0.35
ENTRY_BUY = 0.65
ENTRY_LOW = 0.35
MAX_DEBT_TO_EQUITY = 3.0


def dip_score(drawdown: Column) -> Column:
    """Best for falls of 40-60 % from the one-year high; missing stays missing."""
    return (F.when(drawdown < 0.30, 0.0)
            .when(drawdown < 0.40, 0.7)
            .when(drawdown <= 0.60, 1.0)
            .when(drawdown <= 0.70, 0.5)
            .when(drawdown > 0.70, 0.0))


def band_score(drawdown: Column, low: Column | float, high: Column | float) -> Column:
    """1 inside [low, high], 0 outside, NULL when the drawdown is missing."""
    return F.when(drawdown.isNotNull(), drawdown.between(low, high).cast("double"))


def reversal_score(recent: list[Column], prior: list[Column]) -> Column:
    """Several positive short returns after mostly negative longer ones."""
    def ups(cols):
        return sum((holds(c > 0).cast("int") for c in cols), F.lit(0))

    complete = F.lit(True)
    for c in recent + prior:
        complete = complete & c.isNotNull()
    turned = complete & (ups(prior) <= 1)
    return (F.when(turned & (ups(recent) >= 3), 1.0)
            .when(turned & (ups(recent) >= 2), 0.6)
            .when(complete, 0.0))


def momentum_score(returns: list[Column], crossed_up: Column) -> Column:
    """Share of positive returns plus a bonus for crossing the average; never NULL."""
    share = sum((holds(r > 0).cast("double") for r in returns), F.lit(0.0)) / len(returns)
    return F.least(F.lit(1.0), share + holds(crossed_up).cast("double") * 0.15)


def volume_score(vol_ratio: Column) -> Column:
    return (F.when(vol_ratio >= 2.0, 1.0)
            .when(vol_ratio >= 1.5, 0.8)
            .when(vol_ratio >= 1.0, 0.5)
            .when(vol_ratio >= 0.8, 0.3)
            .when(vol_ratio < 0.8, 0.1))


def trend_score(close: Column, sma_short: Column, sma_long: Column, long_rising: Column,
                long_not_rising: Column) -> Column:
    """The below-short-average rule is tested first because it overrides the others."""
    over_short, over_long = above(close, sma_short), above(close, sma_long)
    return (F.when(~over_short, 0.0)
            .when(over_short & ~over_long, 0.4)
            .when(over_long & long_not_rising, 0.7)
            .when(over_long & long_rising, 1.0))


def rsi_score(rsi: Column) -> Column:
    return (F.when(rsi < 30, 1.0).when(rsi < 45, 0.8).when(rsi < 60, 0.6)
            .when(rsi < 70, 0.3).when(rsi >= 70, 0.0))


def weighted_sum(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted sum that is NULL as soon as one part is NULL."""
    total = None
    for name, weight in weights.items():
        term = F.lit(float(weight)) * parts[name]
        total = term if total is None else total + term
    return total


def ablated_sum(parts: Mapping[str, Column], weights: Mapping[str, float], disabled: Column,
                neutral: float = 0.5) -> Column:
    """Weighted sum in which the part named by `disabled` is replaced by a neutral value."""
    swapped = {k: F.when(disabled == k, F.lit(neutral)).otherwise(v) for k, v in parts.items()}
    return weighted_sum(swapped, weights)


def entry_signal(composite: Column, buy: float = ENTRY_BUY) -> Column:
    return (F.when(composite.isNull(), "INSUFFICIENT_DATA")
            .when(composite >= buy, "BUY").otherwise("WAIT"))


def recovery_signal(composite: Column, gate: Column, buy: float | Column = RECOVERY_BUY,
                    below: str = "WAIT") -> Column:
    """Fail-closed: an unknown gate counts as failed."""
    return (F.when(composite.isNull(), "INSUFFICIENT_DATA")
            .when(~F.coalesce(gate, F.lit(False)), "SKIP")
            .when(composite >= buy, "BUY").otherwise(below))


def quality_gate(growth: Column, debt_to_equity: Column, margin: Column) -> Column:
    """TRUE / FALSE / NULL (unknown). Missing debt-to-equity fails."""
    return (F.when(growth.isNull() | margin.isNull(), F.lit(None).cast("boolean"))
            .when(debt_to_equity.isNull(), F.lit(False))
            .otherwise((growth > 0) & (debt_to_equity < MAX_DEBT_TO_EQUITY) & (margin > 0)))


def gate_explanation(growth: Column, debt_to_equity: Column, margin: Column) -> dict[str, Column]:
    return {"growth_ok": holds(growth > 0),
            "debt_ok": holds(debt_to_equity < MAX_DEBT_TO_EQUITY),
            "margin_ok": holds(margin > 0)}


def score_bucket(composite: Column) -> Column:
    return (F.when(composite < 0.60, F.lit(None).cast("string"))
            .when(composite < 0.65, "0.60-0.65").when(composite < 0.70, "0.65-0.70")
            .when(composite < 0.75, "0.70-0.75").when(composite < 1.01, "0.75-1.00"))


def size_weight(composite: Column) -> Column:
    return F.when(composite >= 0.70, 0.12).when(composite < 0.70, 0.10)
