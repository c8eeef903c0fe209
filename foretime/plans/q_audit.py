"""Leakage audits, table diffs, live state and model operators on the given tables."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretime.functions import fixed, market as m
from foretime.operators import audit, checks, features, linear, live, metrics, models, rating, scorecard, sides
from foretime.operators.prior import prior_ewm, prior_window
from foretime.plans import sql_stats as S
from foretime.plans.proxies import Tables, planned
from foretime.plans.q_prior import FOLDED, METRICS, ROLLED_FROM, ROLLED_SQL, games, ratings_of, rolled_of, shrink_sql, team_log_of
from foretime.plans.q_report import long3
from foretime.plans.q_score import _CLOCK, graded, logged, rounded
from foretime.plans.registry import query, r6, round6
from foretime.session import keep_dealt, written

def clock():
    return F.lit(_CLOCK).cast("timestamp")


SMALL = ("qb_epa_per_db", "def_epa_per_play", "sack_rate")


@query("timestamp_audit", """
WITH p AS (SELECT team, season, kickoff, lag(kickoff) OVER (PARTITION BY team ORDER BY kickoff, game_id) AS prev FROM team_log),
 s AS (SELECT team, season, max(m) OVER (PARTITION BY team ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
   FROM (SELECT team, season, max(kickoff) AS m FROM team_log GROUP BY 1, 2))
SELECT count(*) AS rows, count(*) FILTER (coalesce(prev >= kickoff, false) OR coalesce(earlier >= kickoff, false)) AS violations,
 round(min(epoch_us(kickoff) - epoch_us(prev)) / 86400000000.0::DOUBLE, 6) AS min_lag_days FROM p JOIN s USING (team, season)""", ("team_log",))
def timestamp_audit(t):
    """I1, H12d: newest input of every row against the row's own time."""
    d = audit.newest_inputs(team_log_of(t), "team", "season", "kickoff", "game_id")
    return rounded(audit.time_summary(d, "kickoff"))


@query("window_oracle_mismatches", ROLLED_SQL + " UNION ALL ".join(
    f"SELECT '{m}_sd' AS feature, count(*) AS n, count(*) FILTER (game_id % 89 = 0 AND sd_{m} IS NOT NULL) AS mismatches FROM w" for m in METRICS), ("team_log",))
def window_oracle_mismatches(t):
    """The rolling means of all eleven metrics against differences of running sums. Means of some
    events are shifted: they must be reported, and nothing else."""
    log = written(team_log_of(t))
    f = prior_window(log, ["team", "season"], ["kickoff", "game_id"], {f"{m}_sd": (m, "mean") for m in METRICS}, fixed.IN_SEASON_ROWS)
    f = f.withColumns({f"{m}_sd": F.when(F.col("game_id") % 89 == 0, F.col(f"{m}_sd") + 0.5).otherwise(F.col(f"{m}_sd")) for m in METRICS})
    oracle = audit.window_oracle(log, ["team", "season"], ["kickoff", "game_id"], METRICS, fixed.IN_SEASON_ROWS)
    return audit.mismatches(f, oracle, ["game_id", "team"], {f"{m}_sd": f"{m}_oracle" for m in METRICS})


@query("ewm_induction_failures", """
WITH c AS (SELECT *, event_id % 101 = 0 AND count(metric) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS bad FROM ev),
 p AS (SELECT event_id, bad, coalesce(lag(bad) OVER w, false) AS before, lag(metric) OVER w AS x FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id FROM p WHERE bad <> before OR (bad AND x IS NOT NULL)""", ("ev",))
def ewm_induction_failures(t):
    """Every exponential mean must follow from the previous row's. Means of some events are
    shifted: they and their successors must be reported, and nothing else."""
    e, by, order = t.events(), ["user_id"], ["ts", "event_id"]
    f = prior_ewm(e, by, order, {"m": "metric"}, 5.0, with_weight=True)
    f = f.withColumn("m", F.when(F.col("event_id") % 101 == 0, F.col("m") + 1).otherwise(F.col("m")))
    return audit.ewm_induction(f, by, order, "metric", "m", "m_w", 5.0).select("event_id")


_VARIANTS = ("clean", "one_window", "all_windows", "ewm_only", "everything")


def negative_control(t: Tables) -> DataFrame:
    """Five builds of the same features, four of them reading the current row."""
    e, by, order = t.events(), ["user_id", "week_start"], ["ts", "event_id"]
    e = e.withColumn("other", F.col("value"))
    oracle = audit.window_oracle(e, by, order, ["metric", "other"], 22)
    rows = []
    for name in _VARIANTS:
        bad_first, bad_second = name in ("one_window", "all_windows", "everything"), name in ("all_windows", "everything")
        f = prior_window(e, by, order, {"a": ("metric", "mean")}, 22, include_current=bad_first)
        f = prior_window(f, by, order, {"b": ("other", "mean")}, 22, include_current=bad_second)
        wrong = audit.mismatches(f, oracle, ["event_id"], {"a": "metric_oracle", "b": "other_oracle"}).agg(
            F.sum("mismatches").alias("window_bad"))
        x = prior_ewm(e, ["user_id"], order, {"m": "metric"}, 5.0, with_weight=True,
                      include_current=name in ("ewm_only", "everything"))
        fails = audit.ewm_induction(x, ["user_id"], order, "metric", "m", "m_w", 5.0).agg(
            F.count(F.lit(1)).alias("ewm_bad"))
        rows.append(wrong.withColumn("variant", F.lit(name)).join(fails.withColumn("variant", F.lit(name)), "variant"))
    d = reduce(DataFrame.unionByName, rows)
    return d.select("variant", "window_bad", "ewm_bad", ((F.col("window_bad") == 0) & (F.col("ewm_bad") == 0)).alias("passed"))


@query("negative_control", """
SELECT v AS variant, v = 'clean' AS passed, v NOT IN ('clean', 'ewm_only') AS window_caught, v IN ('ewm_only', 'everything') AS ewm_caught
FROM (VALUES ('clean'), ('one_window'), ('all_windows'), ('ewm_only'), ('everything')) x(v)""")
def negative_control_query(t):
    """The checks pass the clean build and catch each leaky one."""
    return negative_control(t).select("variant", "passed", (F.col("window_bad") > 0).alias("window_caught"),
                                      (F.col("ewm_bad") > 0).alias("ewm_caught"))


@query("negative_control_gate", "SELECT true AS sound, 5::BIGINT AS variants, 1::BIGINT AS clean_variants")
def negative_control_gate(t):
    """I9, I23."""
    return audit.control_gate(negative_control(t))


@query("feature_tripwire", ROLLED_SQL + " UNION ALL ".join(
    f"SELECT '{m}_{kind}' AS feature, round(corr({kind}_{m}, {m}), 6) AS r, abs(corr({kind}_{m}, {m})) > 0.95 AS trips FROM w" for m in METRICS for kind in ("sd", "ewm"))
    + f" UNION ALL SELECT 'leak', round(corr({METRICS[0]} * 2 + CASE WHEN game_id % 10 = 0 THEN 0.01 ELSE 0 END, {METRICS[0]}), 6), true FROM w", ("team_log",))
def feature_tripwire(t):
    """No rolled or exponential mean of the eleven metrics may track the row's own raw value; a column that does, trips."""
    log = written(team_log_of(t))
    f = features.rolled(log).select("game_id", "team", *[f"{m}_{kind}" for m in METRICS for kind in ("sd", "ewm")]).join(log.select("game_id", "team", *METRICS), ["game_id", "team"])
    f = f.withColumn("leak", F.col(METRICS[0]) * 2 + F.when(F.col("game_id") % 10 == 0, 0.01).otherwise(0.0))
    return rounded(audit.tripwire(f, {**{f"{m}_{kind}": m for m in METRICS for kind in ("sd", "ewm")}, "leak": METRICS[0]}))


@query("perturbation_by_week", """
WITH u AS (SELECT user_id, week_start, lag(week_start) OVER (PARTITION BY user_id ORDER BY week_start) AS prev FROM (SELECT DISTINCT user_id, week_start FROM ev)),
 m AS (SELECT user_id FROM ev WHERE week_start = timestamp '2024-01-08' GROUP BY 1 HAVING count(metric) > 0)
SELECT epoch_us(week_start) AS week_us, round(max(CASE WHEN prev = timestamp '2024-01-08' AND user_id IN (FROM m) THEN 100.0 ELSE 0.0 END)::DOUBLE, 6) AS change,
 week_start > timestamp '2024-01-08' AS later FROM u GROUP BY 1, 3""", ("ev",))
def perturbation_by_week(t):
    """Shifting one week's inputs moves no prior-period feature up to that week, and those of
    entities whose previous week it is."""
    e = t.events().withColumn("week_start", F.col("week_start").cast("timestamp"))
    hit = F.col("week_start") == F.lit("2024-01-08").cast("timestamp")
    f = features.prior_period(e, "user_id", "week_start", ["metric"])
    g = features.prior_period(e.withColumn("metric", F.when(hit, F.col("metric") + 100).otherwise(F.col("metric"))),
                              "user_id", "week_start", ["metric"])
    d = audit.largest_change(f, g, ["user_id"], "week_start", ["metric_prior"])
    return d.select(F.unix_micros("week_start").alias("week_us"), round6(F.coalesce("max_change", F.lit(0.0))).alias("change"),
                    (F.col("week_start") > F.lit("2024-01-08").cast("timestamp")).alias("later"))


@query("table_diff_by_season", """
SELECT season, 'home_score' AS "column", count(*) AS compared, count(*) FILTER (game_id % 101 = 0 AND home_score IS NOT NULL) AS mismatches,
 max(CASE WHEN game_id % 101 = 0 AND home_score IS NOT NULL THEN 1.0 WHEN home_score IS NOT NULL THEN 0.0 END::DOUBLE) AS max_abs_diff,
 0::BIGINT AS only_left, 0::BIGINT AS only_right FROM schedule GROUP BY 1""", ("schedule",))
def table_diff_by_season(t):
    """Two versions of a table compared column by column and season by season."""
    a = t.schedule().select("season", "game_id", "home_score")
    b = a.withColumn("home_score", F.when(F.col("game_id") % 101 == 0, F.col("home_score") + 1).otherwise(F.col("home_score")))
    return audit.table_diff(a, b, ["season", "game_id"], by=["season"])


@query("table_fingerprint", None)
def table_fingerprint(t):
    """I14, A7."""
    return audit.fingerprint(t.schedule())


@query("reconciled_reports", """
SELECT model || '/' || season AS block, 'k' AS metric, round(sum(correct), 6) AS value, sum(correct) + 1 AS recorded FROM graded
WHERE season % 2 = 0 AND correct IS NOT NULL GROUP BY 1""", ("graded",))
def reconciled_reports(t):
    """Hit counts recomputed from the prediction log equal the scorecard's, but for even
    seasons, where one was added to what is recorded."""
    g = graded(t)
    mine = audit.long_metrics(scorecard.weekly_rows(g, ["model", "season"]).withColumn("k", F.col("correct") * F.col("n")), ["model", "season"], ["n", "k"])
    again = logged(t).join(games(t).select("game_id", "home_win"), "game_id").groupBy("model", "season").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("p_home") > 0.5) == (F.col("home_win") == 1)).alias("k"))
    again = again.withColumn("k", F.when(F.col("season") % 2 == 0, F.col("k") + 1).otherwise(F.col("k")))
    d = audit.reconcile(mine, audit.long_metrics(again, ["model", "season"], ["n", "k"]))
    return d.withColumn("value", round6("value"))


@query("parts_that_do_not_add_up", """
SELECT 'wins' AS metric, (count(*) + 1)::DOUBLE AS whole, count(*)::DOUBLE AS parts FROM graded
WHERE paper_bet IN ('home', 'away') AND bet_status = 'official' AND bet_outcome = 'win'""", ("graded",))
def parts_that_do_not_add_up(t):
    """Tiers sum to all calls; one win too many in the total must be the only finding."""
    report = scorecard.wins_over_expected(graded(t)).withColumn(
        "wins", F.col("wins") + (F.col("tier") == "all").cast("long"))
    return audit.parts_add_up(report, "tier", "all",
                              ["calls", "wins", "losses", "pushes", "n", "vegas_expected", "woe"])


@query("bet_rule_second_opinion", f"""
SELECT season, count(*) AS rows, 0::BIGINT AS bet_mismatches, 0::BIGINT AS outcome_mismatches FROM graded GROUP BY 1""", ("graded",))
def bet_rule_second_opinion(t):
    """The bet rule and its settlement restated from price ratios agree on every row."""
    g = graded(t)
    other = F.expr("""CASE WHEN home_moneyline IS NULL OR away_moneyline IS NULL THEN 'none' ELSE
      CASE WHEN round(p_home - 1 / (1 + away_dec_inv / home_dec_inv), 10) >= 0.04D THEN 'home'
           WHEN round(1 / (1 + away_dec_inv / home_dec_inv) - p_home, 10) >= 0.04D THEN 'away' ELSE 'none' END END""")
    dec = lambda c: F.expr(f"1 / CASE WHEN {c} > 0 THEN 1 + {c} / 100 ELSE 1 - 100 / {c} END")
    d = g.withColumns({"home_dec_inv": dec("home_moneyline"), "away_dec_inv": dec("away_moneyline")}).withColumn("_b", other)
    margin = F.expr("home_score - away_score") * F.when(F.col("_b") == "home", 1).otherwise(-1)
    outcome = (F.when(F.col("_b") == "none", "none").when(margin.isNull(), "pending").when(margin > 0, "win")
               .when(margin < 0, "loss").otherwise("void"))
    return d.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_b") != F.col("paper_bet")).alias("bet_mismatches"),
                                   F.count_if(outcome != F.col("bet_outcome")).alias("outcome_mismatches"))


@query("row_rule_violations", """
SELECT game_id, 'fallback time' AS rule FROM schedule WHERE gametime IS NULL UNION ALL
SELECT game_id, 'prices present' FROM schedule WHERE home_moneyline IS NULL""", ("schedule",))
def row_rule_violations(t):
    """Constraints as columns, one row per broken rule."""
    return audit.rule_violations(t.schedule(), {
        "fallback time": F.col("gametime").isNotNull(), "prices present": F.col("home_moneyline").isNotNull(),
        "two teams": F.col("home_team") != F.col("away_team"), "week in range": F.col("week").between(1, 19)}, ["game_id"])


@query("predicted_without_schedule", """
SELECT game_id, CASE WHEN game_id % 101 = 0 THEN 'only right' ELSE 'differs' END AS why FROM schedule
WHERE game_type = 'REG' AND (game_id % 101 = 0 OR game_id % 103 = 0)""", ("schedule",))
def predicted_without_schedule(t):
    """Logged events missing from the schedule or differing in week or teams; some are
    taken out of the log and some moved by a week, and exactly those must be reported."""
    cols = ["season", "week", "home_team", "away_team"]
    p = logged(t).where("model = 'champion' AND game_id % 101 <> 0").select("game_id", *cols)
    p = p.withColumn("week", F.when(F.col("game_id") % 103 == 0, F.col("week") + 1).otherwise(F.col("week")))
    d = checks.matched_or_refuse(p, t.schedule().where("game_type = 'REG'"), ["game_id"], cols)
    return d.select("game_id", "why")


@query("keys_on_one_side", """
SELECT game_id, 'left' AS only_in FROM schedule WHERE game_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""", ("schedule",))
def keys_on_one_side(t):
    """G2, C7."""
    right = t.plays().join(t.raw("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("game_id")).distinct(), "game_id", "left_semi")
    return checks.key_difference(t.schedule().select("game_id").distinct(), right.select("game_id").distinct(), ["game_id"])


@query("duplicate_line_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_line_keys(t):
    """G4."""
    return checks.duplicate_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("exception_counts_drift", """
WITH n AS (SELECT roof, count(*) AS n FROM schedule GROUP BY 1)
SELECT roof, 'differs' AS why FROM n WHERE roof = 'open' UNION ALL SELECT roof, 'only left' FROM n WHERE roof = 'dome' UNION ALL SELECT 'glass', 'only right'""", ("schedule",))
def exception_counts_drift(t):
    """I8: documented exception counts match to the integer. One documented count is off by one, one is
    not documented and one is of nothing: these are reported, and no other."""
    found = t.schedule().groupBy("roof").agg(F.count(F.lit(1)).alias("n"))
    lines = t.first_lines().join(t.schedule().select(F.col("game_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    roofs = F.element_at(F.array(*[F.lit(x) for x in ("dome", "closed", "outdoors", "open", "tent")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    documented = lines.groupBy(roofs.alias("roof")).agg(F.count(F.lit(1)).alias("n"))
    documented = documented.select(F.when(F.col("roof") == "dome", "glass").otherwise(F.col("roof")).alias("roof"),
                                   (F.col("n") + F.when(F.col("roof") == "open", 1).otherwise(0)).alias("n"))
    return audit.exceptions_drift(found, documented, ["roof"], ["n"]).select("roof", "why")


@query("seeded_sample", "SELECT game_id, team FROM team_log ORDER BY md5(game_id || '|' || team || '|7'), game_id, team LIMIT 200", ("team_log",))
def seeded_sample(t):
    """a reproducible sample of rows to check, drawn by hashing the key."""
    return team_log_of(t).select("game_id", "team").orderBy(F.md5(F.concat_ws("|", "game_id", "team", F.lit("7"))), "game_id", "team").limit(200)


@query("top_edges", "SELECT game_id, round(greatest(edge_home, edge_away), 6) AS edge FROM logged WHERE model = 'champion' AND edge_home IS NOT NULL ORDER BY greatest(edge_home, edge_away) DESC, game_id LIMIT 15", ("logged",))
def top_edges(t):
    """top fifteen."""
    d = logged(t).where("model = 'champion' AND edge_home IS NOT NULL").withColumn("edge", F.greatest("edge_home", "edge_away"))
    return rounded(d.select("game_id", "edge").orderBy(F.desc("edge"), "game_id").limit(15))


# --- full frame and live state -------------------------------------------------

@planned
def proxy_venues(t: Tables):
    """Coordinates and zone per proxy venue, from the schedule's venue ids."""
    n = F.expr("cast(substring(stadium_id, 2) AS int)")
    zones = ("America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles")
    return t.schedule().select("stadium_id").distinct().select(
        "stadium_id", (F.lit(25.0) + n * 0.5).alias("lat"), (F.lit(-120.0) + n * 1.2).alias("lon"),
        F.element_at(F.array(*[F.lit(z) for z in zones]), n % 4 + 1).alias("tz"))


def context_of(t: Tables):
    return features.context(games(t), features.home_base(t.schedule()), proxy_venues(t))


_CONTEXT = """
base AS (SELECT team, season, stadium_id FROM (SELECT home_team AS team, season, stadium_id,
   row_number() OVER (PARTITION BY home_team, season ORDER BY count(*) DESC, stadium_id) AS rn
   FROM schedule WHERE game_type = 'REG' AND location = 'Home' GROUP BY 1, 2, 3) WHERE rn = 1),
venue AS (SELECT DISTINCT stadium_id, 25.0::DOUBLE + CAST(substring(stadium_id, 2) AS INT) * 0.5::DOUBLE AS lat, -120.0::DOUBLE + CAST(substring(stadium_id, 2) AS INT) * 1.2::DOUBLE AS lon,
   ['America/New_York', 'America/Chicago', 'America/Denver', 'America/Los_Angeles'][CAST(substring(stadium_id, 2) AS INT) % 4 + 1] AS tz FROM schedule),
places AS (SELECT g.*, radians(gv.lat) AS gla, radians(gv.lon) AS glo, radians(hv.lat) AS hla, radians(hv.lon) AS hlo, radians(av.lat) AS ala, radians(av.lon) AS alo,
   (epoch_us(kickoff) - epoch_us(timezone('UTC', timezone(hv.tz, kickoff)))) / 3600000000.0::DOUBLE AS tz_home_offset,
   (epoch_us(kickoff) - epoch_us(timezone('UTC', timezone(av.tz, kickoff)))) / 3600000000.0::DOUBLE AS tz_away_offset
  FROM decided_games g LEFT JOIN venue gv ON gv.stadium_id = g.stadium_id LEFT JOIN base hb ON hb.team = g.home_team AND hb.season = g.season
  LEFT JOIN venue hv ON hv.stadium_id = hb.stadium_id LEFT JOIN base ab ON ab.team = g.away_team AND ab.season = g.season LEFT JOIN venue av ON av.stadium_id = ab.stadium_id),
travel AS (SELECT *, 2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((gla - hla) / 2), 2) + cos(hla) * cos(gla) * pow(sin((glo - hlo) / 2), 2))) AS dh,
  2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((gla - ala) / 2), 2) + cos(ala) * cos(gla) * pow(sin((glo - alo) / 2), 2))) AS da FROM places),
facts AS (SELECT game_id, CASE WHEN location = 'Neutral' THEN 1 ELSE 0 END AS is_neutral, least(greatest(home_rest, 3), 20) AS home_rest, least(greatest(away_rest, 3), 20) AS away_rest,
  least(greatest(home_rest, 3), 20) - least(greatest(away_rest, 3), 20) AS rest_diff, CAST(div_game AS DOUBLE) AS div_game,
  CASE WHEN roof IN ('dome','closed') THEN 1.0 WHEN roof IN ('outdoors','open') THEN 0.0 END::DOUBLE AS roof_indoor,
  dh AS travel_dist_home, da AS travel_dist_away, da - dh AS travel_diff, tz_home_offset, tz_away_offset, tz_home_offset - tz_away_offset AS tz_diff FROM travel)
"""


@query("context_features", "WITH " + _CONTEXT + "SELECT game_id, "
       + ", ".join(f"round({c}, 6) AS {c}" if c.startswith(("travel", "tz")) else c for c in features.CONTEXT) + " FROM facts", ("schedule", "decided_games"))
def context_features(t):
    """Facts known before the event."""
    return rounded(context_of(t).select("game_id", *features.CONTEXT), keep=("home_rest", "away_rest", "rest_diff", "div_game", "roof_indoor"))


_REQUIRED = ("home_rest", "away_rest", "rest_diff", "div_game", "travel_diff", "tz_diff", "is_neutral")


@query("context_columns_populated", "WITH " + _CONTEXT + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing FROM facts" for c in _REQUIRED), ("schedule", "decided_games"))
def context_columns_populated(t):
    """I16: the seven context columns that every event must have."""
    return audit.null_counts(context_of(t), _REQUIRED)


def frame_parts(t: Tables) -> tuple[DataFrame, ...]:
    """What ``features.assemble`` makes the model frame of."""
    keep_dealt(t.spark)
    g, r = ratings_of(t)
    return rolled_of(t), games(t), context_of(t), r


def model_frame(t: Tables):
    """The full feature frame on the proxy tables."""
    return features.assemble(*frame_parts(t))


COLUMNS = features.feature_columns()
#: Stored bytes of input for each slice of events in which the frame is written.
SLICE_BYTES = 3 << 30


def slices_of(t: Tables) -> int:
    return max(-(-t.bytes // SLICE_BYTES), 1)


@planned
def stored_frame(t: Tables):
    """The model frame without the columns that are differences of others, written once. A large one is written slice
    of events by slice: what one slice shuffled is gone when the next one starts."""
    parts = frame_parts(t)
    slices = slices_of(t)
    if slices > 1:
        parts = (*parts[:2], *map(written, parts[2:]))
    kept = [F.col(c).cast("double").alias(c) for c in COLUMNS if c not in features.DIFFERENCES]

    def slice_of(i: int) -> DataFrame:
        mine = [d.where(F.expr(f"pmod(xxhash64(game_id), {slices}) = {i}")) if slices > 1 else d for d in parts]
        return features.assemble(*mine).select("game_id", "season", "week", "home_win", *kept)

    return written(*map(slice_of, range(slices)))


def frame_of(t: Tables):
    """The whole model frame, stored for the operators that read it several times."""
    keep_dealt(t.spark)
    f = stored_frame(t)
    made = {n: F.col(a) - F.col(b) for n, (a, b) in features.DIFFERENCES.items()}
    return f.select("game_id", "season", "week", "home_win", *[made[c].alias(c) if c in made else c for c in COLUMNS])


_SIDE = ["games_played_sd", *[f"{m}_{kind}" for m in METRICS for kind in ("shrunk", "ewm")]]
#: The model frame in SQL: ``frame``, one row per event with all 67 columns.
FRAME_SQL = FOLDED + ", " + ROLLED_SQL.strip()[5:] + ", " + _CONTEXT.strip() + f""",
sides AS (SELECT game_id, is_home, games_played_sd, {", ".join(f"{shrink_sql(m)} AS {m}_shrunk, ewm_{m} AS {m}_ewm" for m in METRICS)} {ROLLED_FROM}),
pair AS (SELECT h.game_id, {", ".join(f"h.{c} AS home_{c}, a.{c} AS away_{c}" for c in _SIDE)} FROM sides h JOIN sides a ON h.game_id = a.game_id AND h.is_home AND NOT a.is_home),
frame AS (SELECT pair.*, {", ".join(f"{a} - {b} AS {n}" for n, (a, b) in features.MATCHUPS.items())}, facts.* EXCLUDE (game_id),
  home_pre AS home_elo_pre, away_pre AS away_elo_pre, home_pre - away_pre AS elo_diff, g.season, g.week, g.home_win
  FROM pair JOIN facts USING (game_id) JOIN f USING (game_id) JOIN decided_games g USING (game_id) WHERE f.n > 0)
"""
FRAME_VIEWS = ("schedule", "decided_games", "team_log")


@query("model_frame_full", FRAME_SQL + "SELECT game_id, season, week, home_win, "
       + ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in features.feature_columns()) + " FROM frame", FRAME_VIEWS)
def model_frame_full(t):
    """The whole frame, 67 model columns, guarded against raw and priced columns."""
    f = frame_of(t)
    return f.select("game_id", "season", "week", "home_win", *[round6(c).alias(c) for c in COLUMNS])


@query("frame_correlations", FRAME_SQL + ", c AS (SELECT unnest([" + ", ".join(
    f"{{'a': '{a}', 'b': '{b}', 'n': count(CASE WHEN {b} IS NOT NULL THEN {a} END), 'r': corr({a}, {b})}}"
    for i, a in enumerate(features.feature_columns()) for b in features.feature_columns()[i + 1:])
    + "]) AS x FROM frame) SELECT x.a AS a, x.b AS b, x.n AS n, round(CASE WHEN isnan(x.r) THEN NULL ELSE x.r END, 6) AS r FROM c", FRAME_VIEWS)
def frame_correlations(t):
    """All 2,211 pairs of the 67 model columns, pairwise complete, from one pass."""
    return rounded(metrics.correlation_matrix(model_frame(t), features.feature_columns()))


_LABELLED = [*features.feature_columns(), "home_win"]


def _cells(names, pairs):
    """Correlations of ``pairs`` of columns of ``frame``, as rows x.a, x.b, x.r."""
    return "SELECT unnest([" + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': corr({a}, {b})}}" for a, b in pairs) + "]) AS x FROM frame"


_EVERY_PAIR = [(a, b) for i, a in enumerate(_LABELLED) for b in _LABELLED[i + 1:]]


def label_weights(pairs):
    """Correlation with the label as a feature's weight, and its rank by size."""
    w = pairs.where("b = 'home_win'").select(F.col("a").alias("feature"), F.col("r").alias("coef"))
    # one row per feature
    return w.withColumn("avg_rank", F.rank().over(Window.orderBy(F.desc_nulls_last(F.round(F.abs("coef"), 9)))).cast("double"))


@query("redundant_features", FRAME_SQL + ", cell AS (" + _cells(_LABELLED, _EVERY_PAIR) + """), cors AS (SELECT x.a AS a, x.b AS b, x.r AS r FROM cell),
placed AS (SELECT a AS feature, r AS coef, rank() OVER (ORDER BY round(abs(r), 9) DESC NULLS LAST) AS place FROM cors WHERE b = 'home_win'),
coupled AS (SELECT a, b, cors.r, u.coef AS ca, v.coef AS cb, (u.place, a) > (v.place, b) AS a_is_worse FROM cors JOIN placed u ON u.feature = a JOIN placed v ON v.feature = b)
SELECT feature, round(coef, 6) AS coef, place::BIGINT AS place,
  feature IN (SELECT CASE WHEN a_is_worse THEN a ELSE b END FROM coupled WHERE abs(r) >= 0.8) AS dropped,
  (SELECT count(*) FROM coupled WHERE feature IN (a, b) AND abs(r) > 0.5 AND ca * cb < 0) AS opposed FROM placed""", FRAME_VIEWS)
def redundant_features(t):
    """Per model column its correlation with the label, whether a better ranked column that moves
    with it makes it redundant, and with how many columns it moves together but points the other way."""
    pairs = written(metrics.correlation_matrix(model_frame(t), _LABELLED))
    w = written(label_weights(pairs))
    drop = models.redundant(pairs, w, 0.8).withColumn("dropped", F.lit(True))
    odd = models.opposed_pairs(pairs, w).select(F.explode(F.array("a", "b")).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("opposed"))
    d = w.join(drop, "feature", "left").join(odd, "feature", "left")
    return d.select("feature", round6("coef").alias("coef"), F.col("avg_rank").cast("long").alias("place"), F.coalesce("dropped", F.lit(False)).alias("dropped"),
                    F.coalesce("opposed", F.lit(0)).alias("opposed"))


@query("feature_manifest", FRAME_SQL + "SELECT unnest([" + ", ".join(
    "{'feature': '%s', 'pattern': '%s', 'known': count(%s), 'first_season': min(CASE WHEN %s IS NOT NULL THEN season END)}" % (c, (
        "A+B" if c.endswith("_shrunk") else "C" if c.endswith("_ewm") else "A" if c.endswith("games_played_sd") else "A+B difference" if c.startswith("mu_")
        else "D" if "elo" in c else "context"), c, c) for c in features.feature_columns()) + "], recursive := true) FROM frame", FRAME_VIEWS)
def feature_manifest(t):
    """How each model column is made, in how many events it is known and since which season."""
    frame = model_frame(t)
    row = frame.agg(*[x for i, c in enumerate(features.feature_columns()) for x in (F.count(c).alias(f"n{i}"), F.min(F.when(F.col(c).isNotNull(), F.col("season"))).alias(f"s{i}"))])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("known"), F.col(f"s{i}").alias("first_season")) for i, c in enumerate(features.feature_columns())]
    found = row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return features.feature_manifest(t.spark).join(found, "feature").select("feature", "pattern", "known", "first_season")


def open_events(t: Tables):
    return t.schedule().where("game_type = 'REG' AND season = 2001 AND home_score IS NULL")


@planned
def stored_log(t: Tables):
    """The team log, written once for the builds that start from it."""
    return written(team_log_of(t))


_RATED = ("game_id", "kickoff", "pool", "pool_home", "pool_away", "home_score", "away_score")


def open_frame(t: Tables, placeholder=None, masked: bool = True) -> DataFrame:
    """The model frame of the open events. ``placeholder`` scores stand in for their results; a build that
    doesn't mask them lets them into the ratings."""
    opened = open_events(t)
    if placeholder is not None:
        opened = opened.withColumns({"home_score": F.lit(placeholder[0]).cast("double"), "away_score": F.lit(placeholder[1]).cast("double")})
    rated = live.without_result(opened) if masked else opened
    both = games(t).select(*_RATED).unionByName(rated.select(*_RATED)).where("pool_home <> pool_away")
    r = rating.rating_fold(both, ["pool"], "kickoff", "game_id", "pool_home", "pool_away", "home_score", "away_score")
    facts = features.context(opened, features.home_base(t.schedule()), proxy_venues(t))
    return live.unplayed_frame(stored_log(t), opened, facts, r)


#: The frame of the open events in SQL: one more row per team, without metrics, behind its last one.
OPEN_SQL = (FOLDED + """, opens AS (SELECT * FROM schedule WHERE game_type = 'REG' AND season = 2001 AND home_score IS NULL),
open_rows AS (SELECT game_id, true AS is_home, home_team AS team, season, kickoff FROM opens UNION ALL SELECT game_id, false, away_team, season, kickoff FROM opens),
log_open AS (SELECT *, false AS ahead FROM team_log UNION ALL BY NAME SELECT *, true AS ahead FROM open_rows QUALIFY row_number() OVER (PARTITION BY team, season ORDER BY kickoff, game_id) = 1),
""" + ROLLED_SQL.strip()[5:].replace("team_log", "log_open") + ", " + _CONTEXT.strip().replace("decided_games", "opens") + f""",
state AS (SELECT team, games_played_sd, {", ".join(f"{shrink_sql(m)} AS {m}_shrunk, ewm_{m} AS {m}_ewm" for m in METRICS)} {ROLLED_FROM} WHERE ahead),
pair AS (SELECT h.game_id, {", ".join(f"hs.{c} AS home_{c}, s.{c} AS away_{c}" for c in _SIDE)} FROM open_rows h JOIN open_rows a ON h.game_id = a.game_id AND h.is_home AND NOT a.is_home
  JOIN state hs ON hs.team = h.team JOIN state s ON s.team = a.team),
held AS (SELECT pool, r FROM f QUALIFY row_number() OVER (PARTITION BY pool ORDER BY n DESC) = 1),
rated AS (SELECT game_id, coalesce(r[substr(pool_home, 2)::INT + 1], 1500.0) AS home_pre, coalesce(r[substr(pool_away, 2)::INT + 1], 1500.0) AS away_pre
  FROM opens LEFT JOIN held USING (pool) WHERE pool_home <> pool_away),
frame AS (SELECT pair.*, {", ".join(f"{a} - {b} AS {n}" for n, (a, b) in features.MATCHUPS.items())}, facts.* EXCLUDE (game_id),
  home_pre AS home_elo_pre, away_pre AS away_elo_pre, home_pre - away_pre AS elo_diff, opens.season, opens.week
  FROM pair JOIN facts USING (game_id) JOIN rated USING (game_id) JOIN opens USING (game_id))
""")


@query("open_model_frame", OPEN_SQL + "SELECT game_id, season, week, " + ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in features.feature_columns()) + " FROM frame", FRAME_VIEWS)
def open_model_frame(t):
    """H1, H2, H5: all 67 columns of every open event, all open weeks in one pass."""
    f = open_frame(t)
    return f.select("game_id", "season", "week", *[round6(F.col(c).cast("double")).alias(c) for c in features.feature_columns()])


@query("open_frame_invariance", """
WITH o AS (SELECT game_id, kickoff, pool, pool_home AS x, true AS home FROM schedule WHERE game_type = 'REG' AND season = 2001 AND home_score IS NULL AND pool_home <> pool_away
   UNION ALL SELECT game_id, kickoff, pool, pool_away, false FROM schedule WHERE game_type = 'REG' AND season = 2001 AND home_score IS NULL AND pool_home <> pool_away),
 q AS (SELECT game_id, home, row_number() OVER (PARTITION BY pool, x ORDER BY kickoff, game_id) > 1 AS moved FROM o)
SELECT build, c AS "column", CASE WHEN build = 'masked' THEN 0 WHEN c = 'home_elo_pre' THEN count(DISTINCT game_id) FILTER (home AND moved)
  WHEN c = 'away_elo_pre' THEN count(DISTINCT game_id) FILTER (NOT home AND moved) WHEN c = 'elo_diff' THEN count(DISTINCT game_id) FILTER (moved) ELSE 0 END AS mismatches
FROM q, (SELECT unnest(['masked', 'unmasked']) AS build), (SELECT unnest([""" + ", ".join(f"'{c}'" for c in features.feature_columns()) + """]) AS c) GROUP BY build, c""", ("schedule",))
def open_frame_invariance(t):
    """H3: two opposite placeholder results give the same open rows, in all 67 columns; a build that doesn't
    mask them is reported in the rating columns, row by row."""
    keep_dealt(t.spark)
    rows = []
    for name, masked in (("masked", True), ("unmasked", False)):
        a, b = (open_frame(t, p, masked).select("game_id", *features.feature_columns()) for p in ((21.0, 20.0), (20.0, 21.0)))
        # the builds add up the same doubles in another order: their last bits may differ
        d = audit.table_diff(a, b, ["game_id"], rtol=1e-9, atol=1e-9)
        # one pair of builds after the other: what the first one shuffled is gone then
        rows.append(written(d.select(F.lit(name).alias("build"), "column", "mismatches")))
    return reduce(DataFrame.unionByName, rows)


@query("open_event_features", f"""
WITH rows AS (SELECT game_id, home_team AS team, season, kickoff FROM schedule WHERE game_type = 'REG' AND season = 2001 AND home_score IS NULL
   UNION ALL SELECT game_id, away_team, season, kickoff FROM schedule WHERE game_type = 'REG' AND season = 2001 AND home_score IS NULL),
 last AS (SELECT team, metric_rows, row_number() OVER (PARTITION BY team ORDER BY kickoff DESC, game_id DESC) AS back, qb_epa_per_db AS x FROM
   (SELECT *, 1 AS metric_rows FROM team_log WHERE season = 2001)),
 s AS (SELECT team, count(*) AS played, avg(x) AS sd, count(x) AS n FROM last WHERE back <= 22 GROUP BY 1),
 w AS (SELECT team, sum(qb_epa_per_db * pow(2.0, -b / 5.0)) / sum(CASE WHEN qb_epa_per_db IS NOT NULL THEN pow(2.0, -b / 5.0) END) AS ewm FROM
   (SELECT *, row_number() OVER (PARTITION BY team ORDER BY kickoff DESC, game_id DESC) AS b FROM team_log) GROUP BY 1)
SELECT game_id, team, coalesce(played, 0) AS games_played_sd, round(sd, 6) AS qb_epa_per_db_sd, round(ewm, 6) AS qb_epa_per_db_ewm
FROM rows LEFT JOIN s USING (team) LEFT JOIN w USING (team)""", ("team_log", "schedule"))
def open_event_features(t):
    """H1: state as of now, handed to every open event in one pass."""
    d = live.as_if_next(written(team_log_of(t).drop(*[x for x in METRICS if x not in SMALL])), open_events(t), SMALL)
    return rounded(d.select("game_id", "team", "games_played_sd", "qb_epa_per_db_sd", "qb_epa_per_db_ewm"))


@query("masked_replay_differences", "SELECT 'x' AS \"column\", 0::BIGINT AS mismatches WHERE false")
def masked_replay_differences(t):
    """H4: hiding a week and everything later, then building that week as open, equals history."""
    log = written(team_log_of(t).drop(*[x for x in METRICS if x not in SMALL]))
    season, week = 1999, 5
    truth = features.rolled(log, metrics=SMALL)
    masked = live.before_week(log, season, week)
    nxt = games(t).where((F.col("season") == season) & (F.col("week") == week))
    cols = ["games_played_sd", *[f"{x}_{s}" for x in SMALL for s in ("sd", "ewm", "shrunk")]]
    # the first event of the week per team is the one both builds must agree on
    rebuilt = live.as_if_next(masked, nxt, SMALL)
    firsts = log.where((F.col("season") == season) & (F.col("week") == week)).groupBy("team").agg(
        F.min(F.struct("kickoff", "game_id")).alias("f")).select("team", F.col("f.game_id").alias("game_id"))
    a = truth.join(firsts, ["team", "game_id"], "left_semi").select("game_id", "team", *cols)
    b = rebuilt.join(firsts, ["team", "game_id"], "left_semi").select("game_id", "team", *cols)
    d = audit.table_diff(a, b, ["game_id", "team"], rtol=1e-9, atol=1e-12)
    return d.where("mismatches > 0 OR only_left > 0 OR only_right > 0").select("column", "mismatches")


@query("live_frame_check", """
SELECT count(*) AS rows, count(*) FILTER (home_score IS NULL) AS open_rows, 0::BIGINT AS leaks FROM schedule
WHERE game_type = 'REG' AND ((home_score IS NOT NULL AND home_score <> away_score) OR (season = 2001 AND home_score IS NULL))""", ("schedule",))
def live_frame_check(t):
    """Played and open rows under one schema, open rows without outcome."""
    cols = ["game_id", "season", "week", "kickoff", "home_team", "away_team"]
    f = live.live_frame(games(t).select(*cols, "home_win"), open_events(t).select(*cols))
    leaks = live.outcome_leaks(f, ["home_win"]).groupBy().agg(F.count(F.lit(1)).alias("leaks")).withColumn("_k", F.lit(1))
    d = f.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("is_played")).alias("open_rows")).withColumn("_k", F.lit(1))
    return d.join(leaks, "_k").drop("_k")


@query("split_at_clock", "SELECT kickoff > timestamp '2001-06-15' AND home_score IS NULL AND away_score IS NULL AS ahead, count(*) AS n FROM schedule GROUP BY 1", ("schedule",))
def split_at_clock(t):
    """H6."""
    ahead, rest = live.split_at(t.schedule(), clock())
    return ahead.withColumn("ahead", F.lit(True)).unionByName(rest.withColumn("ahead", F.lit(False))).groupBy("ahead").agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_trigger", """
WITH d AS (SELECT epoch_us((SELECT min(kickoff) FROM schedule WHERE home_score IS NULL AND kickoff > timestamp '2001-06-15' AND kickoff <= timestamp '2001-06-15 04:00')) AS next_us,
 epoch_us((SELECT max(pulled_at) FROM quotes)) AS newest_us),
 r AS (SELECT *, CASE WHEN next_us IS NULL THEN 'no event starts soon' WHEN epoch_us(timestamp '2001-06-15') - newest_us < 5400000000 THEN 'a recent snapshot exists' ELSE 'due' END AS reason FROM d)
SELECT *, reason = 'due' AS fire FROM r""", ("quotes",))
def snapshot_trigger(t):
    """H10, F4, A10."""
    d = live.snapshot_due(t.schedule(), t.quotes(), clock())
    return d.select(F.unix_micros("next_start").alias("next_us"), F.unix_micros("newest").alias("newest_us"), "fire", "reason")


@query("completeness_before_week", """
SELECT s.game_id, s.week, CASE WHEN home_score IS NOT NULL THEN 'scored without detail rows' WHEN kickoff <= timestamp '2001-06-15' THEN 'past start without a score' ELSE 'postponed' END AS problem
FROM schedule s LEFT JOIN (SELECT DISTINCT game_id FROM plays WHERE qb_dropback = 1) p ON s.game_id = p.game_id
WHERE s.season = 2001 AND s.week < 10 AND game_type = 'REG' AND (home_score IS NULL OR p.game_id IS NULL)""", ("schedule", "plays"))
def completeness_before_week(t):
    """Earlier events with a problem (detail = dropback rows)."""
    return live.completeness(t.schedule(), t.plays().where("qb_dropback = 1"), 2001, 10, clock())


# --- models ---------------------------------------------------------------------

FEATURES = ["d_qb_epa_per_db", "d_def_epa_per_play", "d_sack_rate", "rest_gap", "elo_gap"]


@planned
def small_frame(t: Tables):
    """A frame of five differences for the model operators, written once."""
    log = written(team_log_of(t).drop(*[x for x in METRICS if x not in SMALL]))
    wide = sides.to_event(features.rolled(log, metrics=SMALL), "game_id", "is_home", [f"{x}_shrunk" for x in SMALL])
    g, r = ratings_of(t)
    d = wide.join(games(t).select("game_id", "season", "home_win", (F.col("home_rest") - F.col("away_rest")).alias("rest_gap")), "game_id")
    d = d.join(r.select("game_id", (F.col("home_pre") - F.col("away_pre")).alias("elo_gap")), "game_id", "left")
    return written(d.select("game_id", "season", "home_win", "rest_gap", "elo_gap",
                           *[(F.col(f"home_{x}_shrunk") - F.col(f"away_{x}_shrunk")).alias(f"d_{x}") for x in SMALL]))


def known_weights(t, f: DataFrame, columns: Sequence[str] = FEATURES) -> tuple[linear.Scaling, list[float]]:
    """Scaling and weights of the logistic model of the seasons before 2000."""
    scaling, beta = linear.fold_models(f, columns, "home_win", [2000], {"logistic": 1.0})[2000]
    return scaling, beta[0, :-1].tolist()


def filled(scaling: linear.Scaling) -> dict[str, float]:
    return dict(zip(scaling.features, scaling.fill, strict=True))


@query("coefficient_report", None)
def coefficient_report(t):
    """Weights, shares, expected signs."""
    _, weights = known_weights(t, small_frame(t))
    c = models.weighed(t.spark, weights, FEATURES)
    signs = models.sign_check(c, {"d_qb_epa_per_db": "+", "d_def_epa_per_play": "-"})
    return c.join(signs.select("feature", "expected", "matches"), "feature", "left")


def forest_and_boosting(t, f: DataFrame | None = None, columns: Sequence[str] = FEATURES, last: int | None = 1,
                        trees: Sequence[int] = (20, 5), rounds: Sequence[int] = (5, 3)) -> DataFrame:
    """Tree models beside the logistic one and the home baseline, over the last ``last`` seasons' folds. ``f`` and
    ``columns``: the frame and its features; ``trees`` and ``rounds``: the arguments of ``models.forest`` and ``models.boosting``."""
    f = small_frame(t) if f is None else f
    s = models.season_folds(f, last)
    fits = linear.fold_models(f, columns, "home_win", s, {"logistic": 1.0})

    def scored(fold: tuple[int, str]) -> DataFrame:
        season, name = fold
        med = filled(fits[season][0])
        kind = models.forest(*trees, med=med) if name == "forest" else models.boosting(*rounds, med=med)
        return models.walk_forward(f, columns, "home_win", [season], kind, name)

    # the trees of a fold grow level by level in many small jobs: those of two models run side by side
    with ThreadPoolExecutor(2) as pool:
        grown = list(pool.map(scored, [(x, n) for x in s for n in ("forest", "boosting")]))
    long = written(reduce(DataFrame.unionByName, grown, linear.walk_forward(f, fits, ["logistic"], "home_win")))
    base = f.where(F.col("season").isin(s)).agg(F.count(F.lit(1)).alias("n"), F.avg("home_win").alias("acc")).withColumn("model", F.lit("home_baseline"))
    return models.comparison(metrics.model_metrics(long), base)


def ablation_report(t, f: DataFrame | None = None, columns: Sequence[str] = FEATURES) -> DataFrame:
    """The logistic model without its feature of the largest weight. ``f`` and ``columns``: the frame and its features."""
    f = small_frame(t) if f is None else f
    full = linear.fold_models(f, columns, "home_win", [2000], {"full": 1.0})
    scaling, beta = full[2000]
    _, drop = max(zip(np.abs(beta[0, :-1]), columns, strict=True))
    _, without = linear.fold_models(f, columns, "home_win", [2000], {"ablated": 1.0}, {"ablated": [drop]}, {2000: scaling})[2000]
    fits = {2000: (scaling, np.vstack((beta, without)))}
    return models.ablated(linear.walk_forward(f, fits, ["full", "ablated"], "home_win"), drop)


def feature_pruning(t, f: DataFrame | None = None, columns: Sequence[str] = FEATURES, trees: Sequence[int] = (10, 4)) -> DataFrame:
    """Ranks from two models, worse member of each correlated pair dropped. ``f`` and ``columns``: the
    frame and its features; ``trees``: the arguments of ``models.forest``."""
    f = small_frame(t) if f is None else f
    train = f.where("season < 2000")
    scaling, weights = known_weights(t, f, columns)
    forest = models.forest(*trees, med=filled(scaling))(train, columns, "home_win")
    ranks = models.average_rank([models.weighed(t.spark, weights, columns), models.coefficients(t.spark, forest, columns)])
    drop = models.redundant(metrics.correlation_matrix(train, columns), ranks, 0.05)
    return ranks.join(drop.withColumn("dropped", F.lit(True)), "feature", "left").fillna(False)


@query("rotating_holdout", None)
def rotating_holdout(t):
    """With and without a feature over rotating seasons."""
    f, names = small_frame(t), {"with": 1.0, "without": 1.0}
    fits = linear.fold_models(f, FEATURES, "home_win", models.season_folds(f, 2), names, {"without": ["elo_gap"]})
    return models.flips(linear.walk_forward(f, fits, list(names), "home_win"))
