"""Strictly-prior windows, as-of joins, two-sided tables and ratings on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretime.functions import fixed
from foretime.functions.scalar import shrink
from foretime.operators import features, rating, sides
from foretime.operators.asof import asof_strict
from foretime.operators.ordered import number_rows, POS
from foretime.operators.prior import (
    fill_gaps, last_known, next_value, prior_ewm, prior_running, prior_value, prior_window)
from foretime.operators.schedule import decided
from foretime.operators.team_log import METRICS, team_log
from foretime.plans.proxies import Tables, planned
from foretime.plans.registry import query, r6, round6
from foretime.session import written


@planned
def games(t: Tables):
    return decided(t.schedule()).withColumn("home_win", (F.col("home_score") > F.col("away_score")).cast("int"))


WEEKLY = "PARTITION BY user_id, week_start ORDER BY ts, event_id ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING"


@query("prior_window_mean_count", f"""
SELECT event_id, round(avg(metric) OVER w, 6) AS sd, count(metric) OVER w AS sd_n,
  count(*) OVER w AS played FROM ev WINDOW w AS ({WEEKLY})""", ("ev",))
def prior_window_mean_count(t):
    """Mean and count of the last 22 rows before the current one, per user and week."""
    d = prior_window(t.events().withColumn("one", F.lit(1)), ["user_id", "week_start"], ["ts", "event_id"],
                     {"sd": ("metric", "mean"), "sd_n": ("metric", "count"), "played": ("one", "count")}, 22)
    return d.select("event_id", *r6("sd"), "sd_n", "played")


@query("prior_ewm_by_entity", """
SELECT event_id, round(sum(CASE WHEN metric IS NOT NULL THEN metric * pow(2.0, i / 5.0) END) OVER w
  / sum(CASE WHEN metric IS NOT NULL THEN pow(2.0, i / 5.0) END) OVER w, 6) AS ewm
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", ("ev",))
def prior_ewm_by_entity(t):
    """Exponential mean of earlier rows, half-life five rows, no reset."""
    d = prior_ewm(t.events(), ["user_id"], ["ts", "event_id"], {"ewm": "metric"}, 5.0)
    return d.select("event_id", *r6("ewm"))


@query("previous_event_time", """
SELECT event_id, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS prev_us FROM ev""", ("ev",))
def previous_event_time(t):
    """Time of the entity's previous event."""
    d = prior_value(t.events(), ["user_id"], ["ts", "event_id"], {"prev": "ts"})
    return d.select("event_id", F.unix_micros("prev").alias("prev_us"))


@query("prior_expanding_mean", """
SELECT a.event_id, round(avg(b.metric), 6) AS mean_before
FROM ev a LEFT JOIN ev b ON a.user_id = b.user_id AND (b.ts, b.event_id) < (a.ts, a.event_id) GROUP BY 1""", ("ev",))
def prior_expanding_mean(t):
    """E5: mean of all earlier rows; the oracle side joins every row with its earlier ones."""
    d = prior_running(t.events(), ["user_id"], ["ts", "event_id"], {"mean_before": ("metric", "mean")})
    return d.select("event_id", *r6("mean_before"))


@query("earlier_periods_last_time", """
SELECT user_id, epoch_us(week_start) AS week_us,
  epoch_us(max(m) OVER (PARTITION BY user_id ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS earlier_us
FROM (SELECT user_id, week_start, max(ts) AS m FROM ev GROUP BY 1, 2)""", ("ev",))
def earlier_periods_last_time(t):
    """Newest time over all strictly earlier periods."""
    per = t.events().groupBy("user_id", "week_start").agg(F.max("ts").alias("m"))
    d = prior_running(per, ["user_id"], ["week_start"], {"e": ("m", "max")})
    return d.select("user_id", F.unix_micros(F.col("week_start").cast("timestamp")).alias("week_us"),
                    F.unix_micros("e").alias("earlier_us"))


@query("fill_forward_then_back", """
SELECT event_id, coalesce(last_value(metric IGNORE NULLS) OVER f, first_value(metric IGNORE NULLS) OVER b) AS filled
FROM ev WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", ("ev",))
def fill_forward_then_back(t):
    """Gaps take the last known value, leading gaps the first known one, inside a key."""
    d = fill_gaps(t.events(), ["user_id"], ["ts", "event_id"], "metric")
    return d.select("event_id", F.col("metric").alias("filled"))


@query("fill_back_across_entities", """
WITH f AS (SELECT event_id, user_id, ts, last_value(metric IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM ev)
SELECT event_id, first_value(m IGNORE NULLS) OVER (ORDER BY user_id, ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled
FROM f""", ("ev",))
def fill_back_across_entities(t):
    """The back-fill that ignores keys, kept for parity."""
    d = fill_gaps(t.events(), ["user_id"], ["ts", "event_id"], "metric",
                  cross_key_order=["user_id", "ts", "event_id"])
    return d.select("event_id", F.col("metric").alias("filled"))


@query("next_event_gap_seconds", """
SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap_us FROM ev""", ("ev",))
def next_event_gap_seconds(t):
    """E10 helper: time until the entity's next event."""
    d = next_value(t.events(), ["user_id"], ["ts", "event_id"], {"n": "ts"})
    return d.select("event_id", (F.unix_micros("n") - F.unix_micros("ts")).alias("gap_us"))


@query("first_row_per_entity", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ev)
WHERE rn = 1""", ("ev",))
def first_row_per_entity(t):
    """Earliest row per entity as one aggregate, not a window."""
    d = t.events().groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "value")).alias("f"))
    return d.select("user_id", "f.event_id", "f.value")


@query("row_position_total_order", """
SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS pos FROM ev""", ("ev",))
def row_position_total_order(t):
    """position in a total order, numbered from range partitions without a single-task window."""
    return number_rows(t.events().select("user_id", "ts", "event_id"), [], ["user_id", "ts", "event_id"]).select(
        "event_id", F.col(POS).alias("pos"))


@query("prior_period_mean_asof", """
SELECT user_id, epoch_us(week_start) AS week_us, round(lag(m) OVER (PARTITION BY user_id ORDER BY week_start), 6) AS prior_mean
FROM (SELECT user_id, week_start, avg(metric) AS m FROM ev GROUP BY 1, 2)""", ("ev",))
def prior_period_mean_asof(t):
    """Strict as-of of each (entity, period) against the entity's period means."""
    per = t.events().groupBy("user_id", "week_start").agg(F.avg("metric").alias("prior_mean"))
    d = asof_strict(per.select("user_id", "week_start"), per, "week_start", "week_start", by=["user_id"],
                    values=["prior_mean"])
    return d.select("user_id", F.unix_micros(F.col("week_start").cast("timestamp")).alias("week_us"), *r6("prior_mean"))


@query("prior_league_mean_asof", """
SELECT epoch_us(week_start) AS week_us, round(lag(m) OVER (ORDER BY week_start), 6) AS league_mean
FROM (SELECT week_start, avg(metric) AS m FROM ev GROUP BY 1)""", ("ev",))
def prior_league_mean_asof(t):
    """C11: the same as-of without a key, over one row per period."""
    per = t.events().groupBy("week_start").agg(F.avg("metric").alias("league_mean"))
    d = asof_strict(per.select("week_start"), per, "week_start", "week_start", values=["league_mean"])
    return d.select(F.unix_micros(F.col("week_start").cast("timestamp")).alias("week_us"), *r6("league_mean"))


@query("asof_last_view_before_purchase", """
SELECT p.event_id, v.event_id AS view_id, v.metric AS view_metric FROM
 (SELECT * FROM ev WHERE event_type = 'purchase') p ASOF LEFT JOIN
 (SELECT * FROM ev WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts""", ("ev",))
def asof_last_view_before_purchase(t):
    """Keyed strict as-of that carries the matched row even where its value is missing."""
    e = t.events()
    d = asof_strict(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"),
                    e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"),
                                                          F.col("metric").alias("view_metric")),
                    "ts", "ts", by=["user_id"], right_id=["view_id"])
    return d.select("event_id", "view_id", "view_metric")


@query("shrunk_prior_mean_user_week", f"""
WITH p AS (SELECT user_id, week_start, lag(m) OVER (PARTITION BY user_id ORDER BY week_start) AS prior
   FROM (SELECT user_id, week_start, avg(metric) AS m FROM ev GROUP BY 1, 2)),
 l AS (SELECT week_start, lag(m) OVER (ORDER BY week_start) AS league FROM (SELECT week_start, avg(metric) AS m FROM ev GROUP BY 1)),
 e AS (SELECT event_id, user_id, week_start, avg(metric) OVER w AS sd, count(metric) OVER w AS n FROM ev WINDOW w AS ({WEEKLY})),
 j AS (SELECT e.event_id, CASE WHEN n > 0 THEN n * sd ELSE 0 END AS a, CASE WHEN n > 0 THEN n ELSE 0 END AS wa,
   coalesce(prior, league) AS pr FROM e LEFT JOIN p USING (user_id, week_start) LEFT JOIN l USING (week_start))
SELECT event_id, round(CASE WHEN wa + CASE WHEN pr IS NULL THEN 0 ELSE 4 END > 0 THEN
  (a + coalesce(4.0 * pr, 0)) / (wa + CASE WHEN pr IS NULL THEN 0 ELSE 4 END) END, 6) AS shrunk FROM j""", ("ev",))
def shrunk_prior_mean_user_week(t):
    """Minimum slice: E1, C10, C11 and B15 together."""
    e = t.events()
    d = prior_window(e, ["user_id", "week_start"], ["ts", "event_id"],
                     {"sd": ("metric", "mean"), "n": ("metric", "count")}, 22)
    own = features.prior_period(e, "user_id", "week_start", ["metric"])
    pooled = features.pooled_prior(e, "week_start", ["metric"])
    d = d.join(own, ["user_id", "week_start"], "left").join(F.broadcast(pooled), "week_start", "left")
    return d.select("event_id", round6(shrink("n", "sd", "metric_prior", "metric_league", 4)).alias("shrunk"))


@query("first_period_seed_last_row", """
WITH f AS (SELECT *, row_number() OVER (ORDER BY kickoff DESC, game_id DESC, team DESC) AS rn FROM team_log
  WHERE season = (SELECT min(season) FROM team_log))
SELECT season, round(avg(qb_epa_per_db), 6) AS seed FROM f WHERE rn > 1 GROUP BY 1""", ("team_log",))
def first_period_seed_last_row(t):
    """Parity seed, one value for the first season."""
    log = team_log_of(t)
    d = features.pooled_prior(log, "season", ["qb_epa_per_db"], ["kickoff", "game_id", "team"])
    first = log.agg(F.min("season").alias("first"))
    return d.join(F.broadcast(first), F.col("season") == F.col("first")).select(
        "season", round6("qb_epa_per_db_league").alias("seed"))


@query("first_period_seed_running", """
SELECT game_id, team, round(avg(qb_epa_per_db) OVER (ORDER BY kickoff, game_id, team ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS seed
FROM team_log WHERE season = (SELECT min(season) FROM team_log)""", ("team_log",))
def first_period_seed_running(t):
    """Point-in-time seed, strictly before each row."""
    d = features.seed_first_period(team_log_of(t), "season", ["kickoff", "game_id", "team"], ["qb_epa_per_db"])
    return d.select("game_id", "team", round6("qb_epa_per_db_seed").alias("seed"))


@planned
def team_log_of(t: Tables):
    return team_log(t.plays(), games(t))


def rolled_of(t: Tables, **options):
    """The log is read by five branches of the feature plan, so it is written once."""
    return features.rolled(written(team_log_of(t)), **options)


@query("team_game_log", "SELECT game_id, team, season, week, is_home, opponent, n_dropbacks, n_def_plays, "
       + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM team_log", ("team_log",))
def team_game_log(t):
    """Eleven metrics per event and team from the plays."""
    return team_log_of(t).select("game_id", "team", "season", "week", "is_home", "opponent",
                                 "n_dropbacks", "n_def_plays", *r6(*METRICS))


_ROLL = "PARTITION BY team, season ORDER BY kickoff, game_id ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING"
_PRIORS = """
own AS (SELECT team, season, {lags} FROM (SELECT team, season, {avgs} FROM team_log GROUP BY 1, 2)),
pool AS (SELECT season, {pools} FROM (SELECT season, {avgs} FROM team_log GROUP BY 1)),
seed AS (SELECT game_id, team, {seeds} FROM team_log WHERE season = (SELECT min(season) FROM team_log)
  WINDOW s AS (ORDER BY kickoff, game_id, team ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""".format(
    lags=", ".join(f"lag({m}) OVER (PARTITION BY team ORDER BY season) AS {m}_p" for m in METRICS),
    pools=", ".join(f"lag({m}) OVER (ORDER BY season) AS {m}_l" for m in METRICS),
    avgs=", ".join(f"avg({m}) AS {m}" for m in METRICS),
    seeds=", ".join(f"avg({m}) OVER s AS {m}_s" for m in METRICS))


def shrink_sql(m):
    p = f"coalesce({m}_p, {m}_l, {m}_s)"
    return (f"CASE WHEN n_{m} > 0 OR {p} IS NOT NULL THEN (coalesce(n_{m} * sd_{m}, 0) + coalesce(4.0 * {p}, 0)) / "
            f"(n_{m} + CASE WHEN {p} IS NULL THEN 0 ELSE 4 END) END")


ROLLED_SQL = f"""
WITH {_PRIORS},
pos AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY kickoff, game_id) AS i FROM team_log),
w AS (SELECT *, count(*) OVER r AS games_played_sd,
  {", ".join(f"avg({m}) OVER r AS sd_{m}, count({m}) OVER r AS n_{m}, "
             f"sum({m} * pow(2.0, i / 5.0)) OVER x / sum(CASE WHEN {m} IS NOT NULL THEN pow(2.0, i / 5.0) END) OVER x AS ewm_{m}"
             for m in METRICS)}
  FROM pos WINDOW r AS ({_ROLL}), x AS (PARTITION BY team ORDER BY kickoff, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
ROLLED_FROM = ("FROM w LEFT JOIN own USING (team, season) LEFT JOIN pool USING (season) "
                "LEFT JOIN seed USING (game_id, team)")


@query("rolled_features", ROLLED_SQL + "SELECT game_id, team, games_played_sd, "
       + ", ".join(f"round({shrink_sql(m)}, 6) AS {m}_shrunk, round(ewm_{m}, 6) AS {m}_ewm, n_{m} AS {m}_sd_n"
                   for m in METRICS) + " " + ROLLED_FROM, ("team_log",))
def rolled_features(t):
    """Every rolled feature of the entity log."""
    d = rolled_of(t)
    return d.select("game_id", "team", "games_played_sd", *[x for m in METRICS for x in (
        *r6(f"{m}_shrunk", f"{m}_ewm"), F.col(f"{m}_sd_n"))])


@query("matchup_differences", ROLLED_SQL + ", f AS (SELECT game_id, is_home, "
       + ", ".join(f"{shrink_sql(m)} AS {m}_shrunk" for m in METRICS) + " " + ROLLED_FROM + ") SELECT h.game_id, "
       + ", ".join(f"round({a[:4][0]}.{a[5:]} - {b[:4][0]}.{b[5:]}, 6) AS {n}" for n, (a, b) in features.MATCHUPS.items())
       + " FROM f h JOIN f a ON h.game_id = a.game_id AND h.is_home AND NOT a.is_home", ("team_log",))
def matchup_differences(t):
    """The two sides of an event in one row and their differences."""
    d = rolled_of(t)
    wide = sides.to_event(d, "game_id", "is_home", [f"{m}_shrunk" for m in METRICS])
    return wide.select("game_id", *[round6(F.col(a) - F.col(b)).alias(n)
                                    for n, (a, b) in features.MATCHUPS.items()])


@query("event_to_entity_rows", """
SELECT game_id, true AS is_home, home_team AS team, away_team AS opponent FROM decided_games UNION ALL
SELECT game_id, false, away_team, home_team FROM decided_games""", ("decided_games",))
def event_to_entity_rows(t):
    """One event row becomes two entity rows without reading it twice."""
    return sides.to_sides(games(t), ["game_id"], {"team": "home_team", "opponent": "away_team"},
                          {"team": "away_team", "opponent": "home_team"})


def ratings_of(t: Tables):
    g = games(t).where("pool_home <> pool_away")
    return g, rating.rating_fold(g, ["pool"], "kickoff", "game_id", "pool_home", "pool_away",
                                 "home_score", "away_score")


_GAIN = """20.0::DOUBLE * ln(abs(m) + 1) * 2.2::DOUBLE / (0.001::DOUBLE * CASE WHEN m > 0 THEN hp - ap ELSE ap - hp END + 2.2::DOUBLE)
  * ((m > 0)::INT - 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (ap - hp - 44.72586959078301::DOUBLE) / 400.0::DOUBLE)))"""
#: Ratings event by event: every pool's n-th event reads and moves two of its entities' ratings.
FOLDED = f"""
WITH RECURSIVE e AS (SELECT pool, row_number() OVER (PARTITION BY pool ORDER BY kickoff, game_id) AS n, game_id,
  substr(pool_home, 2)::INT + 1 AS h, substr(pool_away, 2)::INT + 1 AS a, home_score - away_score AS m FROM decided_games WHERE pool_home <> pool_away),
f AS (SELECT pool, 0::BIGINT AS n, list_transform(range(20), lambda x: 1500.0::DOUBLE) AS r, NULL::BIGINT AS game_id, NULL::DOUBLE AS home_pre, NULL::DOUBLE AS away_pre
   FROM (SELECT DISTINCT pool FROM e)
  UNION ALL SELECT pool, n, list_transform(r, lambda x, i: CASE i WHEN h THEN x + gain WHEN a THEN x - gain ELSE x END), game_id, hp, ap FROM (
    SELECT *, {_GAIN} AS gain
    FROM (SELECT e.*, r, r[h] AS hp, r[a] AS ap FROM f JOIN e ON e.pool = f.pool AND e.n = f.n + 1)))
"""


@query("rating_fold_by_pool", FOLDED + "SELECT game_id, pool, round(home_pre, 6) AS home_pre, round(away_pre, 6) AS away_pre FROM f WHERE n > 0", ("decided_games",))
def rating_fold_by_pool(t):
    """Ratings before each event, folded in time order inside each pool."""
    _, r = ratings_of(t)
    return r.select("game_id", "pool", *r6("home_pre", "away_pre"))


@query("rating_chain_audit", FOLDED + f""", t AS (SELECT f.pool, f.n, h, a, m, home_pre + CASE WHEN f.game_id % 97 = 0 THEN 1 ELSE 0 END AS hp, away_pre AS ap FROM f JOIN e USING (pool, n)),
u AS (SELECT *, {_GAIN} AS gain FROM t),
s AS (SELECT pool, n, h AS x, hp AS pre, hp + gain AS post FROM u UNION ALL SELECT pool, n, a, ap, ap - gain FROM u),
c AS (SELECT abs(pre - coalesce(lag(post) OVER (PARTITION BY pool, x ORDER BY n), 1500.0::DOUBLE)) > 1e-9 AS off FROM s)
SELECT count(*) AS checked, count(*) FILTER (off) AS mismatches FROM c""", ("decided_games",))
def rating_chain_audit(t):
    """Ratings that don't follow from the previous event's recomputed outcome; some are made wrong to be found."""
    g, r = ratings_of(t)
    r = r.withColumn("home_pre", F.col("home_pre") + F.when(F.col("game_id") % 97 == 0, 1.0).otherwise(0.0))
    a = rating.rating_audit(r, g.select("game_id", "kickoff", "pool", "pool_home", "pool_away", "home_score", "away_score"),
                            ["pool"], "kickoff", "game_id", "pool_home", "pool_away", "home_score", "away_score")
    return a.agg(F.count(F.lit(1)).alias("checked"),
                 F.count_if(F.abs(F.col("pre") - F.col("expected")) > 1e-9).alias("mismatches"))


@query("rating_for_open_events", FOLDED + """, played AS (SELECT DISTINCT pool, x AS entity FROM (SELECT pool, unnest([pool_home, pool_away]) AS x FROM decided_games WHERE pool_home <> pool_away)),
last AS (SELECT pool, r FROM f QUALIFY row_number() OVER (PARTITION BY pool ORDER BY n DESC) = 1)
SELECT pool, entity, round(r[substr(entity, 2)::INT + 1], 6) AS rating FROM played JOIN last USING (pool)""", ("decided_games",))
def rating_for_open_events(t):
    """H2: rating an open event of each entity would start from."""
    g, r = ratings_of(t)
    a = rating.rating_audit(r, g.select("game_id", "kickoff", "pool", "pool_home", "pool_away", "home_score", "away_score"),
                            ["pool"], "kickoff", "game_id", "pool_home", "pool_away", "home_score", "away_score")
    return rating.latest_rating(a, ["pool"], "kickoff", "game_id").select("pool", "entity", *r6("rating"))
