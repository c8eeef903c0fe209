"""Prices, bets, grading and scorecards on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretime.functions import market as m
from foretime.functions import stats
from foretime.functions.clock import broadcast_slot, iso_utc, kickoff, local_start, utc_offset_hours
from foretime.functions.geo import great_circle_km
from foretime.functions.scalar import clip, indicator
from foretime.operators import features, grading, metrics, scorecard
from foretime.operators.schedule import decided, home_rate, still_open
from foretime.plans import sql_stats as S
from foretime.plans.q_prior import games
from foretime.plans.proxies import Tables, planned
from foretime.plans.registry import query, r6, round6
from foretime.session import ALL_KEYS


@planned
def logged(t: Tables):
    return grading.log_predictions(t.predictions())


@planned
def _graded(t: Tables):
    return grading.grade(logged(t), t.schedule(), t.quotes())


def graded(t: Tables):
    """Quotes are dealt by game, of which each has few: their join by game and time needs no shuffle of its own."""
    t.spark.conf.set(ALL_KEYS, "false")
    return _graded(t)


@planned
def long_eval(t: Tables):
    return graded(t).where(scorecard.DECIDED).select(
        "game_id", "season", "model", F.col("p_home").alias("p"), F.col("home_win").cast("int").alias("y"), "vegas_fav")


def rounded(df, keep=()):
    """Round every double column, keep the rest."""
    return df.select(*[round6(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query("decided_regular_season", "SELECT game_id, season, home_win FROM decided_games", ("decided_games",))
def decided_regular_season(t):
    """B1, B8."""
    return games(t).select("game_id", "season", "home_win")


@query("open_events_of_season", """
SELECT game_id, week, home_team FROM schedule WHERE game_type = 'REG' AND (home_score IS NULL OR away_score IS NULL) AND season = 2001""", ("schedule",))
def open_events_of_season(t):
    """B2."""
    return still_open(t.schedule(), 2001).select("game_id", "week", "home_team")


@query("home_baseline", """
SELECT count(*) AS n, CAST(sum(home_win) AS BIGINT) AS home_wins, round(avg(home_win), 6) AS accuracy,
  min(season) AS first_season, max(season) AS last_season FROM decided_games""", ("decided_games",))
def home_baseline(t):
    """D2."""
    return rounded(home_rate(games(t)))


@query("kickoff_utc", """
SELECT game_id, gametime IS NULL AS fallback_kickoff, CASE
  WHEN timezone('America/New_York', timezone('America/New_York', w)) <> w THEN epoch(date_trunc('hour', timezone('America/New_York', w)))::BIGINT
  WHEN timezone('America/New_York', timezone('America/New_York', w) + INTERVAL 1 HOUR) = w
    OR timezone('America/New_York', timezone('America/New_York', w) - INTERVAL 1 HOUR) = w THEN NULL
  ELSE epoch(timezone('America/New_York', w))::BIGINT END AS kickoff_s
FROM (SELECT game_id, gametime, strptime(gameday || ' ' || coalesce(gametime, '13:00'), '%Y-%m-%d %H:%M') AS w FROM schedule)""", ("schedule",))
def kickoff_utc(t):
    """Local date and time to UTC, twice-occurring times NULL, skipped ones moved forward."""
    return t.schedule().select("game_id", F.col("gametime").isNull().alias("fallback_kickoff"), F.unix_timestamp(
        kickoff("gameday", "gametime", F.lit("America/New_York"))).alias("kickoff_s"))


def _offset_sql(zone: str) -> str:
    # of two instants with this wall clock the earlier one counts
    u = f"timezone('{zone}', kickoff)"
    first = f"CASE WHEN timezone('{zone}', {u} - INTERVAL 1 HOUR) = kickoff THEN {u} - INTERVAL 1 HOUR ELSE {u} END"
    return f"(epoch(kickoff) - epoch({first}))::DOUBLE / 3600"


@query("utc_offset_at_start", f"""
SELECT game_id, {_offset_sql('America/New_York')} AS ny, {_offset_sql('Europe/London')} AS london FROM schedule""", ("schedule",))
def utc_offset_at_start(t):
    """Offset hours with the UTC wall clock read as local time."""
    return t.schedule().select("game_id", utc_offset_hours("kickoff", F.lit("America/New_York")).alias("ny"),
                               utc_offset_hours("kickoff", F.lit("Europe/London")).alias("london"))


@query("local_start_and_slot", """
SELECT game_id, strftime(p, '%a %-m/%-d %-I:%M %p') AS pacific,
  CASE WHEN dayofweek(e) = 1 THEN 'MNF' WHEN dayofweek(e) = 4 AND hour(e) >= 19 THEN 'TNF'
       WHEN dayofweek(e) = 0 AND hour(e) >= 19 THEN 'SNF' END AS slot,
  strftime(kickoff, '%Y-%m-%dT%H:%M:%SZ') AS iso
FROM (SELECT game_id, kickoff, timezone('America/Los_Angeles', timezone('UTC', kickoff)) AS p,
  timezone('America/New_York', timezone('UTC', kickoff)) AS e FROM schedule)""", ("schedule",))
def local_start_and_slot(t):
    """Local start text, prime-time slot, ISO text."""
    return t.schedule().select("game_id", local_start("kickoff", "America/Los_Angeles").alias("pacific"),
                               broadcast_slot("kickoff").alias("slot"), iso_utc("kickoff").alias("iso"))


_LAT = "CASE WHEN {0} % 2 = 0 THEN 25.0 + {0} ELSE 48.0 - {0} * 0.5 END::DOUBLE"


def nation_coordinates(t: Tables):
    k = F.col("n_nationkey")
    return t.raw("nation").select(k, F.when(k % 2 == 0, 25.0 + k).otherwise(48.0 - k * 0.5).alias("lat"),
                                  (k * 7.5 - 90.0).alias("lon"))


@query("travel_distance", """
WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 25.0::DOUBLE + n_nationkey ELSE 48.0::DOUBLE - n_nationkey * 0.5 END AS lat,
  n_nationkey * 7.5::DOUBLE - 90 AS lon FROM nation)
SELECT c_nationkey, count(*) AS orders, round(avg(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 6) AS km
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN n a ON a.k = c_nationkey JOIN n b ON b.k = s_nationkey GROUP BY 1""")
def travel_distance(t):
    """Great-circle distance between two looked-up places, averaged per origin."""
    n = F.broadcast(nation_coordinates(t))
    pair = lambda p: n.select(F.col("n_nationkey").alias(f"{p}k"), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"))
    d = (t.raw("lineitem").select("l_orderkey", "l_suppkey")
         .join(t.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t.raw("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
         .join(t.raw("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")))
    # lines per pair of places first, distances on the few pairs afterwards
    pairs = d.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("c"))
    pairs = pairs.join(pair("a"), F.col("c_nationkey") == F.col("ak")).join(pair("b"), F.col("s_nationkey") == F.col("bk"))
    km = great_circle_km("alat", "alon", "blat", "blon")
    return pairs.groupBy("c_nationkey").agg(
        F.sum("c").alias("orders"), round6(F.sum(km * F.col("c")) / F.sum("c")).alias("km"))


@query("clip_and_indicators", """
SELECT game_id, CASE WHEN home_rest IS NOT NULL THEN least(greatest(home_rest, 3), 20) END AS home_rest,
 CASE WHEN roof IN ('dome','closed') THEN 1.0 WHEN roof IN ('outdoors','open') THEN 0.0 END::DOUBLE AS roof_indoor FROM schedule""", ("schedule",))
def clip_and_indicators(t):
    """B9, B10."""
    return t.schedule().select("game_id", clip("home_rest", 3.0, 20.0).alias("home_rest"),
                               indicator("roof", ("dome", "closed"), ("outdoors", "open")).alias("roof_indoor"))


@query("home_base_by_season", """
SELECT team, season, stadium_id FROM (SELECT home_team AS team, season, stadium_id,
  row_number() OVER (PARTITION BY home_team, season ORDER BY count(*) DESC, stadium_id) AS rn
  FROM schedule WHERE game_type = 'REG' AND location = 'Home' GROUP BY 1, 2, 3) WHERE rn = 1""", ("schedule",))
def home_base_by_season(t):
    """D3: most used venue per team and season, smallest on ties."""
    return features.home_base(t.schedule())


@query("price_to_probability", f"""
SELECT game_id, round({S.odds_prob('home_moneyline')}, 6) AS raw_home, round({S.fair_home('home_moneyline','away_moneyline')}, 6) AS fair_home,
 round({S.odds_prob('home_moneyline')} + {S.odds_prob('away_moneyline')} - 1, 6) AS vig,
 round(CASE WHEN home_moneyline > 0 THEN home_moneyline / 100 ELSE 100 / abs(home_moneyline) END, 6) AS profit
FROM schedule WHERE home_moneyline IS NOT NULL""", ("schedule",))
def price_to_probability(t):
    """B16, B17, B18."""
    return t.schedule().where("home_moneyline IS NOT NULL").select(
        "game_id", round6(m.implied_prob("home_moneyline")).alias("raw_home"),
        round6(m.fair_home_prob("home_moneyline", "away_moneyline")).alias("fair_home"),
        round6(m.overround("home_moneyline", "away_moneyline") - 1.0).alias("vig"),
        round6(m.win_profit("home_moneyline")).alias("profit"))


@query("prediction_log", """
SELECT game_id, model, round(p_home, 6) AS p_home, pick, paper_bet, no_bet_reason, bet_price, stake, bet_status,
 round(implied_p_home, 6) AS implied_p_home, round(edge_home, 6) AS edge_home, round(edge_away, 6) AS edge_away FROM logged""", ("logged",))
def prediction_log(t):
    """Scored rows with pick and bet."""
    d = logged(t)
    return d.select("game_id", "model", *r6("p_home"), "pick", "paper_bet", "no_bet_reason", "bet_price", "stake",
                    "bet_status", *r6("implied_p_home", "edge_home", "edge_away"))


@query("graded_log", """
SELECT game_id, model, result, correct, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, vegas_fav, vegas_correct,
 round(vegas_log_loss, 6) AS vegas_log_loss, bet_outcome, round(units, 6) AS units, clv_status,
 round(p_late_home, 6) AS p_late_home, round(bet_clv, 6) AS bet_clv, round(line_move_toward_model, 6) AS move FROM graded""", ("graded",))
def graded_log(t):
    """Every logged prediction against scores and the last snapshot before the start."""
    return graded(t).select(
        "game_id", "model", "result", "correct", *r6("log_loss", "brier"), "vegas_fav", "vegas_correct",
        *r6("vegas_log_loss"), "bet_outcome", *r6("units"), "clv_status", *r6("p_late_home", "bet_clv"),
        round6("line_move_toward_model").alias("move"))


@query("line_value_statuses", "SELECT model, clv_status, count(*) AS n FROM graded GROUP BY 1, 2", ("graded",))
def line_value_statuses(t):
    """How many rows ended in each measurement status."""
    return graded(t).groupBy("model", "clv_status").agg(F.count(F.lit(1)).alias("n"))


@query("picked_side_view", """
SELECT game_id, CASE pick WHEN 'home' THEN home_team ELSE away_team END AS team,
 round(CASE pick WHEN 'home' THEN p_home ELSE 1 - p_home END, 6) AS model_p,
 round(CASE pick WHEN 'home' THEN implied_p_home ELSE 1 - implied_p_home END, 6) AS market_p,
 round(CASE pick WHEN 'home' THEN edge_home ELSE edge_away END, 6) AS gap,
 CASE paper_bet WHEN 'home' THEN home_team WHEN 'away' THEN away_team END AS bet_team
FROM logged WHERE model = 'champion'""", ("logged",))
def picked_side_view(t):
    """B23, B31."""
    d = logged(t).where("model = 'champion'")
    return d.select("game_id", m.side_value("pick", "home_team", "away_team").alias("team"),
                    round6(m.side_prob("pick", "p_home")).alias("model_p"),
                    round6(m.side_prob("pick", "implied_p_home")).alias("market_p"),
                    round6(m.side_value("pick", "edge_home", "edge_away")).alias("gap"),
                    F.when(F.col("paper_bet") != "none", m.side_value("paper_bet", "home_team", "away_team")).alias("bet_team"))


_SIDE_EDGE = "CASE WHEN paper_bet = 'home' THEN edge_home ELSE edge_away END"


@query("edge_tiers_and_tossups", f"""
SELECT game_id, {S.tier(_SIDE_EDGE)} AS tier, {S.bucket(_SIDE_EDGE)} AS bucket,
 round(greatest(p_home, 1 - p_home), 10) <= 0.55::DOUBLE AS toss_up FROM logged WHERE model = 'champion'""", ("logged",))
def edge_tiers_and_tossups(t):
    """B21, B22, B30."""
    e = m.side_value("paper_bet", "edge_home", "edge_away")
    return logged(t).where("model = 'champion'").select(
        "game_id", m.tier(e).alias("tier"), m.edge_bucket(e).alias("bucket"), m.toss_up("p_home").alias("toss_up"))


@query("card_status_and_grade", """
SELECT game_id, CASE WHEN result <> 'pending' THEN 'final' WHEN kickoff > timestamp '2001-06-15' THEN 'upcoming' ELSE 'score-pending' END AS status,
 CASE WHEN result = 'pending' THEN 'open' WHEN result = 'tie' THEN 'push' WHEN result = pick THEN 'win' ELSE 'loss' END AS pick_grade
FROM graded WHERE model = 'champion'""", ("graded",))
def card_status_and_grade(t):
    """Status at a clock and the pick's grade."""
    d = logged(t).where("model = 'champion'").join(t.schedule().select("game_id", "home_score", "away_score"), "game_id")
    d = d.withColumn("result", m.result("home_score", "away_score"))
    status = F.when(F.col("result") != "pending", "final").when(
        F.col("kickoff") > F.lit("2001-06-15").cast("timestamp"), "upcoming").otherwise("score-pending")
    return d.select("game_id", status.alias("status"), m.grade_side("pick", "result").alias("pick_grade"))


@query("predictor_scorecard", f"""
WITH x AS (SELECT model AS predictor, correct AS hit, log_loss AS ll, brier AS br FROM graded WHERE result IN ('home','away')
 UNION ALL SELECT 'home_baseline', home_correct, NULL, NULL FROM graded WHERE result IN ('home','away') AND model = 'champion'
 UNION ALL SELECT 'vegas_favorite', vegas_correct, NULL, NULL FROM graded WHERE vegas_correct IS NOT NULL AND model = 'champion'
 UNION ALL SELECT 'vegas_implied', NULL, vegas_log_loss, vegas_brier FROM graded WHERE vegas_log_loss IS NOT NULL AND model = 'champion'),
 a AS (SELECT predictor, count(*) AS n, CAST(sum(hit) AS BIGINT) AS k, avg(ll) AS ll_mean, stddev_samp(ll) AS lls, count(ll) AS lln,
  avg(br) AS br_mean, stddev_samp(br) AS brs FROM x GROUP BY 1),
 q AS (SELECT *, {S.t_steps('(n-1)', 'q')} FROM a)
SELECT predictor, n, k, {S.wilson('k', 'n')}, round(ll_mean, 6) AS ll_mean, round(br_mean, 6) AS br_mean,
 round(ll_mean - q_t*lls/sqrt(n::DOUBLE), 6) AS ll_low, round(ll_mean + q_t*lls/sqrt(n::DOUBLE), 6) AS ll_high,
 round(br_mean - q_t*brs/sqrt(n::DOUBLE), 6) AS br_low, round(br_mean + q_t*brs/sqrt(n::DOUBLE), 6) AS br_high FROM q""", ("graded",))
def predictor_scorecard(t):
    """Five predictors with accuracy, log loss and Brier intervals."""
    return rounded(scorecard.predictor_rows(graded(t)))


def _bets_sql(source: str, keys: str, move: bool) -> str:
    b = "paper_bet IN ('home','away')"
    mv = (f", avg(CASE WHEN clv_status = 'measured' AND counts_move THEN line_move_toward_model END) AS mm,"
          f" stddev_samp(CASE WHEN clv_status = 'measured' AND counts_move THEN line_move_toward_model END) AS ms,"
          f" count(CASE WHEN clv_status = 'measured' AND counts_move THEN line_move_toward_model END) AS move_n") if move else ""
    return f"""a AS (SELECT {keys}, count(*) FILTER ({b}) AS bets, count(*) FILTER ({b} AND bet_outcome = 'win') AS w,
  count(*) FILTER ({b} AND bet_outcome = 'loss') AS l, count(*) FILTER ({b} AND bet_outcome = 'void') AS void,
  count(*) FILTER ({b} AND bet_outcome = 'pending') AS pending,
  coalesce(sum(units) FILTER ({b} AND bet_outcome IN ('win','loss')), 0.0::DOUBLE) AS units,
  count(*) FILTER (paper_bet = 'home') AS home_bets, count(*) FILTER ({b} AND clv_status <> 'measured') AS clv_excluded,
  avg(units) FILTER ({b} AND bet_outcome IN ('win','loss')) AS rm, stddev_samp(units) FILTER ({b} AND bet_outcome IN ('win','loss')) AS rs,
  count(*) FILTER ({b} AND bet_outcome IN ('win','loss')) AS rn,
  avg(bet_clv) FILTER ({b} AND clv_status = 'measured') AS cm, stddev_samp(bet_clv) FILTER ({b} AND clv_status = 'measured') AS cs,
  count(*) FILTER ({b} AND clv_status = 'measured') AS clv_n {mv} FROM {source} GROUP BY ALL)"""


_BET_STEPS = f"q AS (SELECT *, {S.t_steps('(rn-1)', 'roi')}, {S.t_steps('(clv_n-1)', 'clv')} FROM a)"
_BET_COLS = (f"bets, w, l, void, pending, round(units, 6) AS units, home_bets, clv_excluded, round(rm, 6) AS roi_mean, "
             f"{S.interval('rm', 'rs', 'rn', 'roi')}, round(cm, 6) AS clv_mean, {S.interval('cm', 'cs', 'clv_n', 'clv')}, "
             f"clv_n, {S.one_sided('cm', 'cs', 'clv_n')} AS clv_p")


@query("betting_scorecard", f"""
WITH src AS (SELECT *, model AS label, true AS counts_move FROM graded UNION ALL
  SELECT *, 'official', false FROM graded WHERE bet_status = 'official'), {_bets_sql('src', 'label', True)},
 q AS (SELECT *, {S.t_steps('(rn-1)', 'roi')}, {S.t_steps('(clv_n-1)', 'clv')}, {S.t_steps('(greatest(move_n,3)-1)', 'move')} FROM a)
SELECT label, {_BET_COLS}, round(mm, 6) AS move_mean, {S.interval('mm', 'ms', 'move_n', 'move')}, move_n FROM q""", ("graded",))
def betting_scorecard(t):
    """Record, units, return and line value per model and for the official bets."""
    return rounded(scorecard.betting_rows(graded(t)))


@query("edge_bucket_scorecard", f"""
WITH src AS (SELECT *, {S.bucket(_SIDE_EDGE)} AS bucket FROM graded WHERE paper_bet IN ('home','away')), {_bets_sql('src', 'model, bucket', False)},
 {_BET_STEPS} SELECT model, bucket, {_BET_COLS}, bets < 30 AS small_sample FROM q""", ("graded",))
def edge_bucket_scorecard(t):
    """D15."""
    return rounded(scorecard.edge_breakdown(graded(t)))


@query("wins_over_expected", f"""
WITH c AS (SELECT *, {S.tier(_SIDE_EDGE)} AS tier0, {_SIDE_EDGE} AS e, CASE WHEN paper_bet = 'home' THEN implied_p_home ELSE 1 - implied_p_home END AS i
  FROM graded WHERE paper_bet IN ('home','away') AND bet_status = 'official'),
 a AS (SELECT coalesce(tier0, 'all') AS tier, count(*) AS calls, count(*) FILTER (bet_outcome = 'win') AS wins,
  count(*) FILTER (bet_outcome = 'loss') AS losses, count(*) FILTER (bet_outcome = 'void') AS pushes, count(*) FILTER (bet_outcome = 'pending') AS pending,
  count(*) FILTER (bet_outcome IN ('win','loss')) AS n, coalesce(sum(i) FILTER (bet_outcome IN ('win','loss')), 0) AS ve,
  coalesce(sum(e) FILTER (bet_outcome IN ('win','loss')), 0) AS me FROM c GROUP BY ROLLUP (tier0))
SELECT tier, calls, wins, losses, pushes, pending, n, round(ve, 6) AS vegas_expected, round(me, 6) AS model_expected, round(wins - ve, 6) AS woe,
 round((wins - ve) / n, 6) AS woe_per_call, round(me / n, 6) AS model_expected_per_call FROM a""", ("graded",))
def wins_over_expected(t):
    """Rollup over tiers of the official calls."""
    return rounded(scorecard.wins_over_expected(graded(t)))


@query("official_calls_without_tier", """
SELECT game_id FROM graded WHERE paper_bet IN ('home', 'away') AND bet_status = 'official' AND game_id % 53 = 0""", ("graded",))
def official_calls_without_tier(t):
    """D16 rule: no official bet lacks a tier. The edges of some are taken away: those bets are reported, and no other."""
    edges = {c: F.when(F.col("game_id") % 53 != 0, F.col(c)) for c in ("edge_home", "edge_away")}
    return scorecard.calls_without_tier(graded(t).withColumns(edges)).select("game_id")


@query("confidence_scorecard", f"""
WITH a AS (SELECT coalesce(b, 'all') AS block, count(*) AS logged, count(correct) AS n, CAST(coalesce(sum(correct), 0) AS BIGINT) AS k
 FROM (SELECT *, CASE WHEN round(greatest(p_home, 1 - p_home), 10) <= 0.55::DOUBLE THEN 'toss_up' ELSE 'confident' END AS b FROM graded WHERE model = 'champion')
 GROUP BY ROLLUP (b)) SELECT block, logged, n, k, {S.wilson('k', 'n')} FROM a""", ("graded",))
def confidence_scorecard(t):
    """D17."""
    return rounded(scorecard.confidence_rows(graded(t)))


@query("weekly_scorecard", """
SELECT season, week, model, count(correct) AS n, round(avg(correct), 6) AS correct, round(avg(log_loss), 6) AS log_loss, round(avg(brier), 6) AS brier,
 round(avg(home_correct), 6) AS home_correct, round(avg(vegas_correct), 6) AS vegas_correct, count(*) FILTER (paper_bet <> 'none') AS bets,
 round(coalesce(sum(units) FILTER (bet_outcome IN ('win','loss')), 0.0::DOUBLE), 6) AS units,
 round(avg(bet_clv), 6) AS clv_mean, count(bet_clv) AS clv_n FROM graded GROUP BY 1, 2, 3""", ("graded",))
def weekly_scorecard(t):
    """D18."""
    return rounded(scorecard.weekly_rows(graded(t)))


@query("paired_loss_difference", """
SELECT a.game_id, round(a.log_loss, 6) AS champion, round(b.log_loss, 6) AS challenger, round(b.log_loss - a.log_loss, 6) AS diff
FROM graded a JOIN graded b ON a.game_id = b.game_id AND a.model = 'champion' AND b.model = 'challenger' WHERE a.log_loss IS NOT NULL""", ("graded",))
def paired_loss_difference(t):
    """Pivot without a self-join."""
    return rounded(scorecard.paired(graded(t)))


def _checkpoint_inputs(t):
    g = graded(t)
    return g, logged(t), t.schedule().where("game_type = 'REG'").select("season", "week", "game_id", "kickoff")


_CLOCK = "2001-06-15"


@query("checkpoint_week_status", """
SELECT s.season, s.week, scheduled, coalesce(g.n, 0) AS predicted, coalesce(g.pending, 0) AS pending,
  CASE WHEN g.pending > 0 THEN 'pending games' ELSE 'graded' END AS status, coalesce(g.pending, 0) = 0 AS done
FROM (SELECT season, week, count(*) AS scheduled FROM schedule WHERE game_type = 'REG' AND week BETWEEN 4 AND 9 GROUP BY 1, 2) s
LEFT JOIN (SELECT season, week, count(DISTINCT game_id) AS n, count(*) FILTER (model = 'champion' AND result = 'pending') AS pending
  FROM graded GROUP BY 1, 2) g ON s.season = g.season AND s.week = g.week""", ("graded",))
def checkpoint_week_status(t):
    """Completeness of each week of the window."""
    g, p, s = _checkpoint_inputs(t)
    return scorecard.checkpoint_weeks(g, p, s, F.lit(_CLOCK).cast("timestamp"))


@query("checkpoint_decision", f"""
WITH d AS (SELECT a.season, b.log_loss - a.log_loss AS diff FROM graded a JOIN graded b ON a.game_id = b.game_id AND a.model = 'champion' AND b.model = 'challenger'
   WHERE a.log_loss IS NOT NULL AND a.week BETWEEN 4 AND 9),
 m AS (SELECT season, avg(diff) AS mu, stddev_samp(diff) AS sd, count(*) AS n FROM d GROUP BY 1),
 w AS (SELECT season, count(*) FILTER (result = 'pending') = 0 AS evaluable FROM graded WHERE week BETWEEN 4 AND 9 GROUP BY 1),
 p AS (SELECT *, {S.one_sided('mu', 'sd', 'n', '-')} AS p FROM m)
SELECT season, evaluable, n AS diff_n, round(mu, 6) AS diff_mean, p, CASE WHEN NOT evaluable THEN 'not yet evaluable'
  WHEN mu < -0.01 AND p < 0.05 THEN 'swap' ELSE 'no swap' END AS decision FROM w LEFT JOIN p USING (season)""", ("graded",))
def checkpoint_decision(t):
    """Margin and paired test, once every week of the window is done."""
    g, p, s = _checkpoint_inputs(t)
    weeks = scorecard.checkpoint_weeks(g, p, s, F.lit(_CLOCK).cast("timestamp"))
    return rounded(scorecard.checkpoint(g, weeks))


@query("season_verdict", f"""
WITH src AS (SELECT *, 'official' AS label FROM graded WHERE bet_status = 'official'), {_bets_sql('src', 'label', False)}, {_BET_STEPS},
 r AS (SELECT {_BET_COLS} FROM q)
SELECT bets, clv_n, clv_mean, clv_low, clv_high, clv_p, roi_mean, roi_low, roi_high,
 clv_n >= 2 AND clv_mean > 0 AND clv_p < 0.05 AS evidence FROM r""", ("graded",))
def season_verdict(t):
    """D21."""
    return rounded(scorecard.verdict(graded(t)))


@query("logged_and_graded_tiers", f"""
WITH c AS (SELECT {S.tier(_SIDE_EDGE)} AS t0, bet_outcome FROM graded WHERE bet_status = 'official')
SELECT coalesce(t0, 'all') AS tier, count(*) AS calls_logged, count(*) AS calls_graded, count(*) FILTER (bet_outcome = 'win') AS wins,
 count(*) FILTER (bet_outcome = 'loss') AS losses, count(*) FILTER (bet_outcome = 'void') AS pushes FROM c GROUP BY ROLLUP (t0)""", ("graded",))
def logged_and_graded_tiers(t):
    """D34."""
    return scorecard.logged_beside_graded(logged(t), graded(t))
