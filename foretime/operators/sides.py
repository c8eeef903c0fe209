"""Two-sided events: one event row and its two entity rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_sides(events: DataFrame, keep: Sequence[str], home: Mapping[str, str],
             away: Mapping[str, str]) -> DataFrame:
    """One row per (event, side): ``home``/``away`` map output names to columns."""
    sides = [F.struct(F.lit(flag).alias("is_home"), *[F.col(c).alias(n) for n, c in m.items()])
             for flag, m in ((True, home), (False, away))]
    return events.select(*keep, F.explode(F.array(*sides)).alias("s")).select(*keep, "s.*")


def to_event(rows: DataFrame, key: str, flag: str, values: Sequence[str],
             home: str = "home_", away: str = "away_") -> DataFrame:
    """Back to one wide row per event; events missing a side are left out, two rows
    for one side are an error.

    One aggregate on the key instead of joining the table with itself.
    """
    pack = F.struct(*values)
    wide = rows.groupBy(key).agg(F.max(F.when(F.col(flag), pack)).alias("h"),
                                 F.max(F.when(~F.col(flag), pack)).alias("a"),
                                 F.greatest(F.count_if(flag), F.count_if(~F.col(flag))).alias("n"))
    twice = F.raise_error(F.concat(F.lit("two rows for one side of "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    whole = F.when(F.col("n") > 1, twice.cast("boolean")).otherwise(F.col("h").isNotNull() & F.col("a").isNotNull())
    return wide.where(whole).select(
        key, *[F.col(f"h.{v}").alias(home + v) for v in values],
        *[F.col(f"a.{v}").alias(away + v) for v in values])


def next_open_event(events: DataFrame, played: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """Each entity's first open event: the smallest order tuple, one aggregate."""
    pack = F.struct(*order, *[c for c in events.columns if c not in (entity, *order)])
    return events.groupBy(entity).agg(F.min(pack).alias("e")).select(entity, "e.*")
