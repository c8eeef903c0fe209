"""Joins that refuse, and key comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def refuse_duplicates(df: DataFrame, keys: Sequence[str], what: str) -> None:
    bad = duplicate_keys(df, keys).take(3)
    if bad:
        raise ValueError(f"{what}: duplicate keys, for example {bad}")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that fails when a key occurs twice on either side.

    Both sides hold a row per key: a file's size says little of how many, so neither goes to the driver
    to be broadcast.
    """
    for df, what in ((left, "left side"), (right, "right side")):
        refuse_duplicates(df, keys, what)
    return left.join(right.hint("merge"), list(keys), how)


def matched_or_refuse(left: DataFrame, right: DataFrame, keys: Sequence[str],
                      equal: Sequence[str] = ()) -> DataFrame:
    """Full join whose unmatched or differing rows are returned as violations."""
    l = left.select(*keys, *[F.col(c).alias(f"{c}_l") for c in equal], F.lit(True).alias("_l"))
    r = right.select(*keys, *[F.col(c).alias(f"{c}_r") for c in equal], F.lit(True).alias("_r"))
    d = l.join(r, list(keys), "full")
    same = F.lit(True)
    for c in equal:
        same = same & F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r"))
    why = (F.when(F.col("_l").isNull(), "only right").when(F.col("_r").isNull(), "only left")
           .when(~same, "differs"))
    return d.withColumn("why", why).where("why IS NOT NULL").drop("_l", "_r")


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, both directions, from one aggregate."""
    keys = list(keys)
    both = left.select(*keys, F.lit(1).alias("_s")).unionByName(right.select(*keys, F.lit(2).alias("_s")))
    d = both.groupBy(*keys).agg(F.bit_or("_s").alias("_s")).where("_s <> 3")
    return d.select(*keys, F.when(F.col("_s") == 1, "left").otherwise("right").alias("only_in"))


def refuse_overlap(df: DataFrame, forbidden: DataFrame, keys: Sequence[str]) -> None:
    """Fails when any forbidden key is present."""
    hit = df.select(*keys).join(forbidden, list(keys), "left_semi").take(3)
    if hit:
        raise ValueError(f"forbidden keys present, for example {hit}")
