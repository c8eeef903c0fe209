"""Ordered computation that survives a key holding most of the rows.

A plain window sends each key to one task. That is the right plan while every
key is small, so each operator asks for the largest key first (one column, one
partial aggregate) and takes the plain window when it fits. Otherwise rows are
range-partitioned on (key, order), numbered from the partition offsets, and cut
into chunks of bounded length; an operator then needs only what crosses a chunk
border: a short halo or one carried row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from foretime.session import partitions, stable

#: Rows of one key that a single task may sort.
TASK_ROWS = 2_000_000
#: Rows per chunk once a key is over the limit.
CHUNK_ROWS = 500_000

POS = "_pos"
CHUNK = "_chunk"


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Row count of the biggest key: an aggregate that combines before its shuffle."""
    if by:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    else:
        sizes = df.select(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def over_limit(df: DataFrame, by: Sequence[str], task_rows: int | None) -> bool:
    return largest_group(df, by) > (TASK_ROWS if task_rows is None else task_rows)


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def attach(rows: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe ``keys``; ``extra`` has one row per key."""
    names = [c for c in extra.columns if c not in keys]
    renamed = extra.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *names)
    cond = [rows[k].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(keys)]
    return rows.join(renamed, reduce(lambda x, y: x & y, cond), "left").drop(
        *[f"_k{i}" for i in range(len(keys))])


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_pos``, the 0-based rank inside ``by`` along ``order``.

    No task sees more than one range partition. ``order`` must end in a column
    that makes rows of a key distinct, so the range bounds can cut inside a key.
    """
    spark = df.sparkSession
    ordered = stable(
        df.repartitionByRange(partitions(spark), *[F.col(c) for c in (*by, *order)])
        .sortWithinPartitions(*by, *order)
        .withColumn("_row", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftright("_row", 33))
    runs = ordered.groupBy(*by, "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(*by, "_part", (
        F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (attach(ordered, runs, [*by, "_part"])
            .withColumn(POS, F.col("_row") + F.col("_shift"))
            .drop("_row", "_part", "_shift"))


def chunk_rows(df: DataFrame, by: Sequence[str], order: Sequence[str],
               rows: int = CHUNK_ROWS) -> DataFrame:
    """``number_rows`` plus ``_chunk``, consecutive runs of ``rows`` rows of a key."""
    return number_rows(df, by, order).withColumn(CHUNK, F.expr(f"{POS} div {int(rows)}"))


def carry_into_chunks(rows: DataFrame, by: Sequence[str],
                      totals: dict[str, Column],
                      carried: dict[str, Callable]) -> DataFrame:
    """Give each row what the earlier chunks of its key hand over.

    ``totals`` are aggregates of one chunk, ``carried`` turns a window over the
    earlier chunks into the handed-over value. The window runs on one row per
    chunk, never on the rows themselves.
    """
    per_chunk = rows.groupBy(*by, CHUNK).agg(*[v.alias(k) for k, v in totals.items()])
    earlier = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    handed = per_chunk.select(*by, CHUNK, *[fn(earlier).alias(k) for k, fn in carried.items()])
    return attach(rows, handed, [*by, CHUNK])
