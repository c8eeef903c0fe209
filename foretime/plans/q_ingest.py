"""Scans, contracts, catalogues and documents on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretime.functions import fixed
from foretime.functions.scalar import recode
from foretime.operators.schedule import seasons_only
from foretime.plans.q_score import logged
from foretime.plans.registry import query, round6
from foretime.sources.document import export_pages, nested_documents
from foretime.sources.seasons import inventory
from foretime.sources.snapshots import predicted_ids
from foretime.sources.tables import normalise


@query("normalised_types", """
SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_discount <> 0 THEN l_discount END AS discount, l_returnflag AS flag FROM lineitem""")
def normalised_types(t):
    """Casts to the contract, NaN to NULL."""
    raw = t.raw("lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).otherwise(F.lit(float("nan"))).alias("discount"), F.col("l_returnflag").alias("flag"), "l_tax")
    return normalise(raw, T.StructType.fromDDL("order_id bigint, line bigint, discount double, flag string"))


@query("season_range_scan", "SELECT season, count(*) AS n, round(avg(epa), 6) AS epa FROM plays WHERE season BETWEEN 1997 AND 1999 GROUP BY 1", ("plays",))
def season_range_scan(t):
    """A season range that may not touch forbidden seasons."""
    d = seasons_only(t.plays(), 1997, 1999, forbidden=(2001,))
    return d.groupBy("season").agg(F.count(F.lit(1)).alias("n"), round6(F.avg("epa")).alias("epa"))


@query("season_inventory", """
SELECT CAST(season AS BIGINT) AS season, count(*) AS stored_rows, CASE WHEN season < 1998 THEN count(*) END AS recorded_rows,
 CASE WHEN season < 1998 THEN 'recorded' ELSE 'legacy' END AS status FROM schedule GROUP BY season""", ("schedule",))
def season_inventory(t):
    """Stored seasons beside recorded pulls."""
    meta = t.schedule().where("season < 1998").groupBy("season").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("schedule").alias("kind"), F.col("season").cast("bigint").alias("season"), F.lit(None).cast("timestamp").alias("pulled_at"), "rows")
    return inventory(t.schedule(), meta, "schedule").drop("pulled_at")


@query("snapshot_catalogue", "SELECT epoch_us(pulled_at) AS pulled_us, count(*) AS rows FROM quotes GROUP BY 1", ("quotes",))
def snapshot_catalogue(t):
    """Pull times and their row counts."""
    return t.quotes().groupBy(F.unix_micros("pulled_at").alias("pulled_us")).agg(F.count(F.lit(1)).alias("rows"))


@query("predicted_per_week", "SELECT season, week, count(DISTINCT game_id) AS n FROM logged GROUP BY 1, 2", ("logged",))
def predicted_per_week(t):
    """A14."""
    return predicted_ids(logged(t)).groupBy("season", "week").agg(F.count(F.lit(1)).alias("n"))


@query("canonical_codes", """
SELECT c_mktsegment AS code, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS canonical, count(*) AS n FROM customer GROUP BY 1, 2""")
def canonical_codes(t):
    """B4."""
    d = t.raw("customer").select(F.col("c_mktsegment").alias("code"))
    return d.withColumn("canonical", recode("code", {"BUILDING": "B", "MACHINERY": "M"})).groupBy("code", "canonical").agg(F.count(F.lit(1)).alias("n"))


@query("export_pages", """
WITH p AS (SELECT season, game_id, (row_number() OVER (PARTITION BY season ORDER BY kickoff, game_id) - 1) // 500 AS page,
  row_number() OVER (PARTITION BY season ORDER BY kickoff, game_id) AS r FROM schedule)
SELECT season, CAST(page AS BIGINT) AS page, count(*) AS n, CAST(arg_min(game_id, r) AS VARCHAR) AS first_game FROM p GROUP BY 1, 2""", ("schedule",))
def export_documents(t):
    """Nested documents of bounded size, rows in a fixed order."""
    d = export_pages(t.schedule(), ["season"], ["kickoff", "game_id"],
                     ["game_id", "week", "home_team", "away_team", "home_score", "away_score", "spread_line"], page_rows=500)
    return d.select("season", "page", "n", F.get_json_object("document", "$.games[0].game_id").alias("first_game"))


def _object(*pairs: tuple[str, str]) -> str:
    """JSON object in SQL, without what is missing: (name, text of the value)."""
    return "'{' || concat_ws(',', " + ", ".join(f"CASE WHEN ({v}) IS NOT NULL THEN '\"{k}\":' || {v} END" for k, v in pairs) + ") || '}'"


def _text(c: str) -> str:
    return f"'\"' || {c} || '\"'"


@query("week_documents", f"""
WITH l AS (SELECT game_id, '[' || string_agg({_object(("away_moneyline", "away_moneyline::VARCHAR"), ("home_moneyline", "home_moneyline::VARCHAR"), ("pulled", _text("strftime(pulled_at, '%Y-%m-%dT%H:%M:%SZ')")))},
   ',' ORDER BY pulled_at) || ']' AS lines FROM quotes WHERE game_id % 3 <> 0 GROUP BY 1),
 g AS (SELECT season, week, '[' || string_agg({_object(("away_score", "away_score::VARCHAR"), ("away_team", _text("away_team")), ("game_id", "s.game_id::VARCHAR"), ("home_score", "home_score::VARCHAR"),
   ("home_team", _text("home_team")), ("lines", "lines"), ("spread_line", "spread_line::VARCHAR"))}, ',' ORDER BY kickoff, s.game_id) || ']' AS games FROM schedule s LEFT JOIN l USING (game_id) GROUP BY 1, 2)
SELECT season, week, length(d) AS characters, md5(d) AS digest FROM (SELECT season, week, {_object(("games", "games"), ("season", "season::VARCHAR"), ("week", "week::VARCHAR"))} AS d FROM g)""", ("schedule", "quotes"))
def week_documents(t):
    """Whole nested documents (week, its games in order, their prices in order), compared by digest."""
    quotes = t.quotes().where("game_id % 3 <> 0").withColumn("pulled", F.date_format("pulled_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    d = nested_documents(t.schedule(), ["season", "week"], ["kickoff", "game_id"], ["game_id", "home_team", "away_team", "home_score", "away_score", "spread_line"], "games",
                         quotes, "game_id", ["pulled_at"], ["pulled", "home_moneyline", "away_moneyline"], "lines")
    return d.select("season", "week", F.length("document").cast("long").alias("characters"), F.md5(F.col("document").cast("binary")).alias("digest"))


@query("late_tolerant_event_counts", "SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def late_tolerant_event_counts(t):
    """G1, G4, H13 (batch side): a table delivered twice is counted once."""
    e = t.raw("events").select("user_id", "event_id")
    return e.unionByName(e).dropDuplicates(["user_id", "event_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
