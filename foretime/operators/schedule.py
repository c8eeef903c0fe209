"""Schedule filters and the event index."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretime.functions.clock import kickoff as kickoff_of
from foretime.functions.fixed import TEAM_CODES
from foretime.functions.scalar import recode


def decided(schedule: DataFrame) -> DataFrame:
    """Regular-season events with a final score and a winner."""
    return schedule.where(
        (F.col("game_type") == "REG") & F.col("home_score").isNotNull()
        & F.col("away_score").isNotNull() & (F.col("home_score") != F.col("away_score")))


def still_open(schedule: DataFrame, season: int | None = None) -> DataFrame:
    out = schedule.where((F.col("game_type") == "REG")
                         & (F.col("home_score").isNull() | F.col("away_score").isNull()))
    return out if season is None else out.where(F.col("season") == season)


def seasons_only(df: DataFrame, first: int, last: int, forbidden: Iterable[int] = ()) -> DataFrame:
    """Season range that must not touch a forbidden season; the bounds are checked before any read."""
    clash = sorted(s for s in forbidden if first <= s <= last)
    if clash:
        raise ValueError(f"forbidden seasons inside the range: {clash}")
    return df.where(F.col("season").between(first, last))


def event_index(schedule: DataFrame, zone: str = "America/New_York",
                decided_only: bool = True) -> DataFrame:
    """Label and UTC start per event; ``fallback_kickoff`` marks a defaulted time."""
    base = decided(schedule) if decided_only else schedule
    return base.withColumns({
        "kickoff": kickoff_of("gameday", "gametime", F.lit(zone)),
        "fallback_kickoff": F.col("gametime").isNull(),
        "home_team": recode("home_team", TEAM_CODES),
        "away_team": recode("away_team", TEAM_CODES),
        "home_win": F.when(F.col("home_score").isNotNull() & F.col("away_score").isNotNull(),
                           (F.col("home_score") > F.col("away_score")).cast("int"))})


def home_rate(games: DataFrame) -> DataFrame:
    """Share of decided events won at home, with the span of seasons."""
    return games.agg(
        F.count(F.lit(1)).alias("n"), F.sum("home_win").cast("bigint").alias("home_wins"),
        F.avg("home_win").alias("accuracy"), F.min("season").alias("first_season"),
        F.max("season").alias("last_season"))
