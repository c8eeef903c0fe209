"""Strict as-of joins: the latest right row whose key is strictly earlier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretime.operators.prior import last_known


def asof_strict(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                by: Sequence[str] = (), values: Sequence[str] = (), prefix: str = "",
                left_id: Sequence[str] = (), right_id: Sequence[str] = (),
                task_rows: int | None = None) -> DataFrame:
    """Add ``values`` of the matched right row to every left row.

    The matched row is carried whole, so a NULL inside it stays NULL instead of
    falling through to an older row. Equal keys never match: at the same key a
    left row sorts before the right rows. ``left_id``/``right_id`` break ties.
    Both sides meet in one stacked table ordered by key, which costs one shuffle
    on ``by`` and no pairing of rows.
    """
    values = list(values) or [c for c in right.columns if c not in (*by, right_on)]
    left_tie, right_tie = [f"_lt{i}" for i in range(len(left_id))], [f"_rt{i}" for i in range(len(right_id))]
    lkey = left.schema[left_on].dataType
    packed_left = left.select(
        *by, F.col(left_on).alias("_key"), F.lit(0).alias("_side"),
        *[F.col(c).alias(n) for c, n in zip(left_id, left_tie)], F.struct(*left.columns).alias("_l"))
    packed_right = right.where(F.col(right_on).isNotNull()).select(
        *by, F.col(right_on).cast(lkey).alias("_key"), F.lit(1).alias("_side"),
        *[F.col(c).alias(n) for c, n in zip(right_id, right_tie)],
        F.struct(F.col(right_on).alias("_matched"), *values).alias("_r"))
    both = packed_left.unionByName(packed_right, allowMissingColumns=True)
    matched = last_known(both, by, ["_key", "_side", *left_tie, *right_tie], {"_hit": "_r"}, task_rows=task_rows)
    # a left row without a key sorts first and can match nothing
    return matched.where(F.col("_side") == 0).select(
        "_l.*", *[F.col(f"_hit.{v}").alias(f"{prefix}{v}") for v in values])
