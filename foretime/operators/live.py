"""Live state: features and ratings for events still open, gates before publishing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretime.functions import fixed
from foretime.operators.features import assemble, rolled
from foretime.operators.sides import to_sides
from foretime.operators.team_log import METRICS


def open_rows(log: DataFrame, open_events: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One metric-less row per (open event, entity)."""
    rows = to_sides(open_events, ["game_id", "season", "week", "kickoff"],
                    {"team": "home_team", "opponent": "away_team"},
                    {"team": "away_team", "opponent": "home_team"})
    types = dict(log.dtypes)
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(types[c]).alias(c)
                         for c in log.columns])


def as_if_next(log: DataFrame, open_events: DataFrame, metrics: Sequence[str] = METRICS,
               **options) -> DataFrame:
    """Features of every open event as if it were its entity's next row.

    The state an entity is in now is read off one placeholder row behind its
    last played row in that season, and handed to all its open events of the
    season. One pass serves every open week: nothing is recomputed per week, and
    open rows can never feed each other.
    """
    rows = open_rows(log, open_events, metrics)
    nxt = rows.groupBy("team", "season").agg(F.min(F.struct("kickoff", "game_id")).alias("n"))
    first = rows.join(nxt, ["team", "season"]).where(
        (F.col("kickoff") == F.col("n.kickoff")) & (F.col("game_id") == F.col("n.game_id"))).drop("n")
    both = log.withColumn("_open", F.lit(False)).unionByName(first.withColumn("_open", F.lit(True)))
    features = rolled(both, metrics=metrics, **options).where("_open")
    state = [c for c in features.columns if c.endswith(("_shrunk", "_sd", "_sd_n", "_ewm"))]
    state = [*dict.fromkeys([*state, "games_played_sd"])]
    return rows.select("game_id", "team", "season", "week", "kickoff", "is_home", "opponent").join(
        features.select("team", "season", *state), ["team", "season"])


def unplayed_frame(log: DataFrame, unplayed: DataFrame, facts: DataFrame, ratings: DataFrame) -> DataFrame:
    """Every model column of every open event, without a label: one pass for all open weeks.

    ``facts`` is the context of the open events, ``ratings`` theirs before each of them.
    """
    rows = as_if_next(log, unplayed)
    return assemble(rows, unplayed.withColumn("home_win", F.lit(None).cast("double")), facts, ratings)


def without_result(events: DataFrame) -> DataFrame:
    """Events as they stand before the start: whatever score they carry is no result."""
    return events.withColumns({c: F.lit(None).cast("double") for c in ("home_score", "away_score")})


def live_frame(played: DataFrame, unplayed: DataFrame) -> DataFrame:
    """Played and open rows under one schema; open rows carry no label."""
    out = played.withColumn("is_played", F.lit(True)).unionByName(
        unplayed.withColumn("is_played", F.lit(False)), allowMissingColumns=True)
    return out


def history_view(frame: DataFrame) -> DataFrame:
    """Played rows in the stored table's shape."""
    return frame.where("is_played").drop("is_played")


def labelled(frame: DataFrame, label: str = "home_win") -> DataFrame:
    return frame.where(F.col("is_played") & F.col(label).isNotNull()).withColumn(label, F.col(label).cast("int"))


def outcome_leaks(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Open rows that carry a value in a column they must not have."""
    hit = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns]))
    return frame.where(~F.col("is_played")).select("game_id", F.explode(hit).alias("column"))


def split_at(events: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Events not started and unscored at ``now``, and the rest."""
    ahead = (F.col("kickoff") > now) & F.col("home_score").isNull() & F.col("away_score").isNull()
    ahead = F.coalesce(ahead, F.lit(False))
    return events.where(ahead), events.where(~ahead)


def before_week(df: DataFrame, season: int, week: int) -> DataFrame:
    """Everything earlier than a week: the masked side of a replay."""
    return df.where((F.col("season") < season) | ((F.col("season") == season) & (F.col("week") < week)))


def snapshot_due(schedule: DataFrame, snapshots: DataFrame, now: Column,
                 ahead_hours: int = 4, quiet_minutes: int = 90) -> DataFrame:
    """One row: does an unscored event start soon and is the newest snapshot too old?

    Snapshots from the future count as fresh.
    """
    soon = (F.col("home_score").isNull() & (F.col("kickoff") > now)
            & (F.unix_micros("kickoff") - F.unix_micros(now) <= ahead_hours * 3_600_000_000))
    e = schedule.agg(F.min(F.when(soon, F.col("kickoff"))).alias("next_start")).withColumn("_k", F.lit(1))
    s = snapshots.agg(F.max("pulled_at").alias("newest")).withColumn("_k", F.lit(1))
    d = e.join(s, "_k").drop("_k")
    recent = F.coalesce(F.unix_micros(now) - F.unix_micros("newest") < quiet_minutes * 60_000_000, F.lit(False))
    reason = (F.when(F.col("next_start").isNull(), "no event starts soon")
              .when(recent, "a recent snapshot exists").otherwise("due"))
    return d.select("next_start", "newest", (reason == "due").alias("fire"), reason.alias("reason"))


def freshness(pulls: DataFrame, snapshots: DataFrame, now: Column, max_age_hours: float = 6.0) -> DataFrame:
    """Newest snapshot against newest pull: at least as new, same content, not too old.

    Both tables: ``pulled_at`` and ``digest``.
    """
    last = lambda df, p: df.agg(F.max_by("digest", "pulled_at").alias(f"{p}_digest"),
                                F.max("pulled_at").alias(f"{p}_at")).withColumn("_k", F.lit(1))
    d = last(pulls, "pull").join(last(snapshots, "snap"), "_k").drop("_k")
    age = (F.unix_micros(now) - F.unix_micros("snap_at")) / 3_600_000_000.0
    status = (F.when(F.col("pull_at").isNull(), "no pull recorded").when(F.col("snap_at").isNull(), "no snapshot")
              .when(F.col("snap_at") < F.col("pull_at"), "snapshot older than pull")
              .when(F.col("snap_digest") != F.col("pull_digest"), "content differs")
              .when(age > max_age_hours, "snapshot too old").otherwise("fresh"))
    return d.select("pull_at", "snap_at", age.alias("age_hours"), status.alias("status"))


def completeness(schedule: DataFrame, plays: DataFrame, season: int, week: int, now: Column) -> DataFrame:
    """Earlier events of the season with a problem: scored without detail, past start without a
    score, or postponed into the future (listed, not fatal)."""
    earlier = schedule.where((F.col("season") == season) & (F.col("week") < week) & (F.col("game_type") == "REG"))
    seen = plays.where(F.col("season") == season).select("game_id").distinct().withColumn("_seen", F.lit(True))
    d = earlier.join(seen, "game_id", "left")
    scored = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    problem = (F.when(scored & F.col("_seen").isNull(), "scored without detail rows")
               .when(~scored & (F.col("kickoff") <= now), "past start without a score")
               .when(~scored, "postponed"))
    return d.select("game_id", "week", problem.alias("problem")).where("problem IS NOT NULL")
