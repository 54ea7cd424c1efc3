"""Normal-distribution helpers, applied to one-row summaries only."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType
from statistics import NormalDist

EULER_GAMMA = 0.5772156649015329


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(NormalDist().cdf, na_action="ignore")


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return p.map(NormalDist().inv_cdf, na_action="ignore")


def sharpe_z(sharpe: Column, target: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Test statistic of a per-observation Sharpe ratio against a target;
    `kurt` is the plain fourth moment ratio (3 for a normal)."""
    spread = F.sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe)
    return (sharpe - target) * F.sqrt(n - 1) / spread


def probabilistic_sharpe(sharpe: Column, target: Column, n: Column, skew: Column, kurt: Column) -> Column:
    return normal_cdf(sharpe_z(sharpe, target, n, skew, kurt))


def expected_max_sharpe(variance: Column, trials: Column) -> Column:
    """Expected best Sharpe ratio among `trials` worthless strategies."""
    trials = trials.cast("double")
    first = normal_quantile(1 - 1 / trials)
    second = normal_quantile(1 - 1 / (trials * F.lit(math.e)))
    return F.sqrt(variance) * ((1 - EULER_GAMMA) * first + EULER_GAMMA * second)
