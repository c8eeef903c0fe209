"""Named queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretime.plans.proxies import Tables
from foretime.plans.sql_views import with_views

#: Means of two-decimal values over 2^k rows sit exactly on a rounding half, where
#: the last bit of a sum decides. Both sides add this offset before rounding.
OFF_LATTICE = 1.23e-8


def r6(*names: str) -> list[Column]:
    """Columns rounded to six decimals for the comparison."""
    return [round6(n).alias(n) for n in names]


def round6(c) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + OFF_LATTICE, 6)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use the named ``views``.

    ``round(x, 6)`` in the SQL is the counterpart of ``round6``.
    """

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables.of(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, views).replace(", 6)", f" + {OFF_LATTICE}::DOUBLE, 6)")
        return fn

    return register
