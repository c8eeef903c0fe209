"""Small column expressions with the missing-value rules spelled out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rate(numerator: Column | str, denominator: Column | str) -> Column:
    """Ratio; a zero or missing denominator gives NULL."""
    return F.try_divide(col(numerator), col(denominator))


def is_one(c: Column | str) -> Column:
    """Indicator column equals 1; missing counts as false."""
    return F.coalesce(col(c) == 1, F.lit(False))


def clip(c: Column | str, low, high) -> Column:
    """Bound a value; missing stays missing."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(low)), F.lit(high)))


def recode(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Canonical code where one is listed, the value itself otherwise."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), col(c)) if pairs else col(c)


def indicator(c: Column | str, ones, zeros) -> Column:
    """1.0 / 0.0 for listed categories, NULL for anything else."""
    return F.when(col(c).isin(list(ones)), 1.0).when(col(c).isin(list(zeros)), 0.0)


def shrink(n: Column | str, mean: Column | str, prior: Column | str, fallback: Column | str,
           k: float) -> Column:
    """Blend of the sample mean (weight n) and a prior (weight k).

    The prior falls back to ``fallback``. A side that is missing drops out of
    both sums; with neither side the result is NULL.
    """
    n = F.coalesce(col(n).cast("double"), F.lit(0.0))
    prior = F.coalesce(col(prior), col(fallback))
    sampled = (n > 0) & col(mean).isNotNull()
    w_sample = F.when(sampled, n).otherwise(0.0)
    w_prior = F.when(prior.isNotNull(), float(k)).otherwise(0.0)
    total = (F.when(sampled, n * col(mean)).otherwise(0.0)
             + F.when(prior.isNotNull(), prior * float(k)).otherwise(0.0))
    return F.try_divide(total, w_sample + w_prior)


def half_open_label(value: Column | str, edges, labels, digits: int = 10) -> Column:
    """Label of the [edge, next edge) range holding the rounded value; NULL below the first."""
    v = F.round(col(value), digits)
    out = F.lit(None).cast("string")
    for edge, label in zip(edges, labels):
        out = F.when(v >= edge, F.lit(label)).otherwise(out)
    return out
