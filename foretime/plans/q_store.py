"""Stores written from the given tables and read back: snapshots, season upserts, write-once weeks, text."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from foretime.plans.q_score import logged
from foretime.plans.registry import query, r6
from foretime.session import shared_folder
from foretime.sources import seasons, snapshots
from foretime.sources.tables import read_seasons

PULLS = tuple(datetime(2001, m, 1, 15, 30, tzinfo=timezone.utc) for m in (1, 3))
#: The second pull brings only these seasons.
AGAIN = (1997, 2001)
COLUMNS = ("game_id", "season", "week", "home_team", "home_score")


def new_base(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def pulled(t):
    """A folder of snapshots: every season at the first pull, some again at the second; scores not yet known are missing."""
    base = new_base(t, "snapshots")
    s = t.schedule().select("kickoff", *COLUMNS)
    years = sorted(r[0] for r in s.select("season").distinct().collect())
    for at in PULLS:
        seen = s.withColumn("home_score", F.when(F.col("kickoff") < F.lit(at).cast("timestamp"), F.col("home_score"))).select(*COLUMNS)
        for season in years if at == PULLS[0] else AGAIN:
            snapshots.write_snapshot(seen, base, season, at)
    return base


@query("snapshot_files_catalogue", """
SELECT season, p AS pulled_us, count(*) AS rows FROM schedule, (SELECT unnest([epoch_us(timestamp '2001-01-01 15:30'), epoch_us(timestamp '2001-03-01 15:30')]) AS p)
WHERE p = epoch_us(timestamp '2001-01-01 15:30') OR season IN (1997, 2001) GROUP BY ALL""", ("schedule",))
def snapshot_files_catalogue(t):
    """Snapshots are written once, and their times read from the names of the files."""
    d = snapshots.catalogue(snapshots.read_snapshots(t.spark, pulled(t)))
    return d.select("season", F.unix_micros("pulled_at").alias("pulled_us"), "rows")


@query("newest_snapshot_rows", """
SELECT game_id, season, week, home_team, CASE WHEN kickoff < CASE WHEN season IN (1997, 2001) THEN timestamp '2001-03-01 15:30' ELSE timestamp '2001-01-01 15:30' END
  THEN home_score END AS home_score FROM schedule""", ("schedule",))
def newest_snapshot_rows(t):
    """A10: each season's newest snapshot, older files pruned by name."""
    return snapshots.read_newest(t.spark, pulled(t)).select("game_id", "season", "week", "home_team", "home_score")


@query("upserted_seasons", """
SELECT season, game_id, CASE WHEN season >= 2000 THEN 'refreshed' WHEN season = 1996 THEN 'forced' ELSE 'first' END AS pull FROM schedule
WHERE season BETWEEN 1995 AND 1997 OR season >= 2000 AND week <= 8 OR season = 1998""", ("schedule",))
def upserted_seasons(t):
    """A1, A2, A5: missing seasons are loaded, stored ones are left, the moving ones refreshed, one rewritten by force."""
    base, meta = new_base(t, "seasons"), new_base(t, "pulls")
    s = t.schedule().select("season", "week", "game_id")
    up = lambda d, tag, k, **how: seasons.upsert_seasons(d.withColumn("pull", F.lit(tag)), base, "schedule", PULLS[k], 2000, meta, **how)
    up(s.where("season BETWEEN 1995 AND 1997 OR season >= 2000"), "first", 0)
    up(s.where("season BETWEEN 1996 AND 1998"), "first", 1)  # only 1998 is missing
    up(s.where("season >= 2000 AND week <= 8"), "refreshed", 1, refresh=True)
    up(s.where("season = 1996"), "forced", 1, force=True)
    return read_seasons(t.spark, base, sorted(seasons.stored_seasons(t.spark, base)), ["game_id", "pull"]).select("season", "game_id", "pull")


@query("recorded_pulls", """
SELECT CAST(season AS BIGINT) AS season, count(*) AS stored_rows, count(*) AS recorded_rows, 'recorded' AS status, epoch_us(CASE WHEN season = 1998 THEN timestamp '2001-03-01 15:30' ELSE timestamp '2001-01-01 15:30' END) AS pulled_us
FROM schedule WHERE season BETWEEN 1995 AND 1998 GROUP BY season""", ("schedule",))
def recorded_pulls(t):
    """Every written season has its newest pull on record, with the rows that it stored."""
    base, meta = new_base(t, "seasons"), new_base(t, "pulls")
    s = t.schedule().select("season", "week", "game_id")
    seasons.upsert_seasons(s.where("season BETWEEN 1995 AND 1997"), base, "schedule", PULLS[0], 2001, meta)
    seasons.upsert_seasons(s.where("season BETWEEN 1995 AND 1998"), base, "schedule", PULLS[1], 2001, meta)
    d = seasons.inventory(t.spark.read.parquet(base), seasons.latest_metadata(t.spark, meta), "schedule")
    return d.select("season", "stored_rows", "recorded_rows", "status", F.unix_micros("pulled_at").alias("pulled_us"))


@query("weeks_published_once", """
SELECT week, game_id, model, round(p_home, 6) AS p_home, week = 3 AS refused FROM logged WHERE season = 1999 AND week IN (2, 3)""", ("logged",))
def weeks_published_once(t):
    """A week's results are written once; a second write of a week is refused and changes nothing."""
    base = new_base(t, "weeks")
    rows = logged(t).where("season = 1999").select("season", "week", "game_id", "model", "p_home")
    for week in (2, 3):
        snapshots.publish_once(rows.where(F.col("week") == week), base, 1999, week)
    try:
        snapshots.publish_once(rows.where("week = 3").withColumn("p_home", F.lit(0.5)), base, 1999, 3)
        refused = -1
    except AnalysisException:
        refused = 3
    return t.spark.read.parquet(base).select("week", "game_id", "model", *r6("p_home"), (F.col("week") == refused).alias("refused"))


@query("weeks_republished", """
SELECT season, week, count(*) AS n, round(avg(CASE WHEN week = 4 THEN 1 - p_home ELSE p_home END), 6) AS p_home FROM logged WHERE season >= 1999 GROUP BY 1, 2""", ("logged",))
def weeks_republished(t):
    """Weeks that can be made again replace exactly their own partitions."""
    base = new_base(t, "weeks")
    rows = logged(t).where("season >= 1999").select("season", "week", "game_id", "model", "p_home")
    snapshots.republish(rows, base)
    snapshots.republish(rows.where("week = 4").withColumn("p_home", 1 - F.col("p_home")), base)
    return t.spark.read.parquet(base).groupBy("season", "week").agg(F.count(F.lit(1)).alias("n"), F.avg("p_home").alias("p_home")).select("season", "week", "n", *r6("p_home"))


@query("weekly_text_read_back", """
SELECT season, week, game_id, model, round(p_home, 6) AS p_home, round(edge_home, 6) AS edge_home FROM logged""", ("logged",))
def weekly_text_read_back(t):
    """Weekly text files with ten digits, read back under the schema; missing numbers stay missing."""
    base = new_base(t, "text")
    rows = logged(t).select("game_id", "model", "p_home", "edge_home", "season", "week")
    snapshots.write_weekly_csv(rows, base)
    return snapshots.read_weekly_csv(t.spark, base, rows.schema).select("season", "week", "game_id", "model", *r6("p_home", "edge_home"))
