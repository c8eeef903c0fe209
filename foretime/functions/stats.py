"""Intervals and exact tests as expressions over rows that are already aggregated.

The t and binomial tails have no built-in; they are small helpers that see the
aggregated rows of a report, never the rows behind them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from foretime.functions.scalar import col

Z95 = 1.959964
_PANELS = 1000


def wilson(k, n, z: float = Z95) -> Column:
    """Struct (low, high) of the score interval for k of n."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p, z2 = F.try_divide(k, n), z * z
    scale = F.try_divide(n, n + z2)
    centre = (p + F.try_divide(F.lit(z2), 2 * n)) * scale
    half = F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n)) * scale * z
    return F.struct((centre - half).alias("low"), (centre + half).alias("high"))


def _tail(t: float, df: float) -> float:
    """P(T > t): Simpson's rule on the angle form of the density."""
    if not (df >= 1 and t == t):
        return math.nan
    edge = math.atan(t / math.sqrt(df))
    grid = np.linspace(0.0, edge, 2 * _PANELS + 1)
    height = np.cos(grid) ** (df - 1.0)
    area = (height[0] + height[-1] + 4 * height[1:-1:2].sum() + 2 * height[2:-1:2].sum()) * (
        edge / (6 * _PANELS))
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return min(1.0, max(0.0, 0.5 - scale * area))


def _point_975(df: float) -> float:
    """97.5 % point: closed forms for 1 and 2 degrees, Newton from a lower bound above."""
    if not df >= 1:
        return math.nan
    if df == 1:
        return math.tan(math.pi * 0.475)
    if df == 2:
        return 0.95 * math.sqrt(2 / (1 - 0.95**2))
    t, norm = 1.959963984540054, math.lgamma((df + 1) / 2) - math.lgamma(df / 2)
    for _ in range(12):
        density = math.exp(norm - (df + 1) / 2 * math.log1p(t * t / df)) / math.sqrt(df * math.pi)
        t += (_tail(t, df) - 0.025) / density
    return t


def _lower(k: float, n: float) -> float:
    """P(X <= k), X ~ Binomial(n, 1/2), summed down from k over the terms that matter."""
    if not (n >= 0 and k == k):
        return math.nan
    if k < 0:
        return 0.0
    steps = int(min(k, 12 * math.ceil(math.sqrt(n)) + 50))
    i = np.arange(steps, dtype="float64")
    ratios = (k - i) / (n - k + i + 1.0)
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    return min(1.0, math.exp(top) * (1.0 + np.cumprod(ratios).sum()))


def _each(fn, *columns: pd.Series) -> pd.Series:
    return pd.Series([fn(*v) for v in zip(*[c.astype("float64") for c in columns], strict=True)],
                     dtype="float64")


# Applied to aggregated rows only, a handful per query.
@F.pandas_udf(DoubleType())
def _tail_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(_tail, t, df)


@F.pandas_udf(DoubleType())
def _point_udf(df: pd.Series) -> pd.Series:
    return _each(_point_975, df)


@F.pandas_udf(DoubleType())
def _lower_udf(k: pd.Series, n: pd.Series) -> pd.Series:
    return _each(_lower, k, n)


def t_upper(t, df) -> Column:
    """P(T > t) for Student's t."""
    return F.nanvl(_tail_udf(col(t).cast("double"), col(df).cast("double")), F.lit(None))


def t_quantile_975(df) -> Column:
    return F.nanvl(_point_udf(col(df).cast("double")), F.lit(None))


def binomial_lower(k, n) -> Column:
    """P(X <= k) for X ~ Binomial(n, 1/2)."""
    return F.nanvl(_lower_udf(col(k).cast("double"), col(n).cast("double")), F.lit(None))


def mean_interval(mean, std, n) -> Column:
    """Struct (low, high) of the 95 % t interval; NULL below two values."""
    n = col(n).cast("double")
    half = F.when(n >= 2, t_quantile_975(n - 1) * col(std) / F.sqrt(n))
    return F.struct((col(mean) - half).alias("low"), (col(mean) + half).alias("high"))


def one_sided_t(mean, std, n, alternative: str) -> Column:
    """p value of mean > 0 (greater) or < 0 (less); NULL below two values or when constant."""
    n = col(n).cast("double")
    t = F.try_divide(col(mean) * F.sqrt(n), col(std))
    t = -t if alternative == "less" else t
    return F.when((n >= 2) & (col(std) > 0), t_upper(t, F.greatest(n - 1, F.lit(1.0))))


def sign_test_two_sided(k, n) -> Column:
    """Exact two-sided binomial p at one half; 1 when there is nothing to compare."""
    k, n = col(k).cast("double"), col(n).cast("double")
    low = F.least(k, n - k)
    return F.when(n == 0, 1.0).when(low * 2 == n, 1.0).otherwise(
        F.least(F.lit(1.0), 2.0 * binomial_lower(low, n)))


def sign_test_at_least(k, n) -> Column:
    """P(X >= k) for k successes in n fair trials."""
    k, n = col(k).cast("double"), col(n).cast("double")
    return F.when(k <= 0, 1.0).otherwise(
        F.when(2 * k > n, binomial_lower(n - k, n)).otherwise(1.0 - binomial_lower(k - 1.0, n)))


def accuracy_band(k, n) -> Column:
    """Band of a hit count among n."""
    share = F.try_divide(col(k).cast("double"), col(n).cast("double"))
    return (F.when(share > 0.70, "above 70%").when(share > 0.68, "68-70%")
            .when(share >= 0.58, "58-68%").when(share >= 0.50, "50-58%")
            .when(share.isNotNull(), "below 50%"))


def shuffle_verdict(accuracy) -> Column:
    """Band of the mean accuracy under shuffled labels; only the middle band passes."""
    a = col(accuracy)
    return (F.when(a > 0.55, "fail: leak suspected").when(a > 0.53, "warn: borderline high")
            .when(a >= 0.47, "pass").when(a >= 0.45, "warn: borderline low")
            .when(a.isNotNull(), "fail: bug suspected"))
