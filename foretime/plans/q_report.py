"""Model metrics, paired tests and report tables on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretime.functions import fixed, market as m, stats
from foretime.operators import metrics, scorecard, tables
from foretime.plans import sql_stats as S
from foretime.plans.q_prior import METRICS, games
from foretime.plans.q_score import _CLOCK, graded, logged, long_eval, rounded
from foretime.plans.proxies import planned
from foretime.plans.registry import query, r6, round6
from foretime.plans.sql_views import view

view("long3", """
  SELECT game_id, season, model, p, y, vegas_fav FROM long_eval UNION ALL
  SELECT game_id, season, 'market', implied_p_home, CAST(home_win AS INTEGER), vegas_fav FROM graded
  WHERE model = 'champion' AND result IN ('home','away') AND implied_p_home IS NOT NULL""", ("long_eval", "graded"))


@planned
def long3(t):
    """Champion, challenger and market probability per decided event."""
    g = graded(t).where(scorecard.DECIDED).select(
        "game_id", "season", "vegas_fav", F.col("home_win").cast("int").alias("y"), F.explode(F.array_compact(F.array(
            F.struct(F.col("model").alias("model"), F.col("p_home").alias("p")),
            F.when((F.col("model") == "champion") & F.col("implied_p_home").isNotNull(),
                   F.struct(F.lit("market").alias("model"), F.col("implied_p_home").alias("p")))))).alias("r"))
    return g.select("game_id", "season", "r.model", "r.p", "y", "vegas_fav")


_METRIC = f"count(*) AS n, count(*) FILTER ((p > 0.5)::INT = y) AS k, avg({S.log_loss('y', 'p')}) AS ll, avg(pow(p - y, 2)) AS br"


@query("model_metrics", f"""
WITH r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS rk FROM long3),
 a AS (SELECT model, {_METRIC}, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * sum(1 - y)) AS auc FROM r GROUP BY 1)
SELECT model, n, k, {S.wilson('k', 'n')}, round(ll, 6) AS log_loss, round(br, 6) AS brier, round(auc, 6) AS auc FROM a""", ("long3",))
def model_metrics(t):
    """Accuracy, log loss, Brier, exact AUC per model; the oracle takes AUC from mid-ranks."""
    return rounded(metrics.model_metrics(long3(t)))


@query("evaluation_blocks", f"""
WITH a AS (SELECT model, coalesce(CAST(season AS VARCHAR), 'pooled') AS block, {_METRIC} FROM long3
  GROUP BY GROUPING SETS ((model, season), (model)))
SELECT model, block, n, k, {S.wilson('k', 'n')}, round(ll, 6) AS log_loss, round(br, 6) AS brier FROM a""", ("long3",))
def evaluation_blocks(t):
    """Per model and season and pooled."""
    return rounded(metrics.evaluation_block(long3(t)))


_PAIRS = """pr AS (SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (((a.p > 0.5)::INT = a.y) AND NOT ((b.p > 0.5)::INT = b.y)) AS only_a,
  count(*) FILTER (NOT ((a.p > 0.5)::INT = a.y) AND ((b.p > 0.5)::INT = b.y)) AS only_b
  FROM long3 a JOIN long3 b ON a.game_id = b.game_id AND a.model < b.model GROUP BY 1, 2)"""


@query("exact_mcnemar_pairs", f"WITH {_PAIRS} SELECT *, {S.binom_two_sided('only_a', '(only_a + only_b)')} AS p FROM pr", ("long3",))
def exact_mcnemar_pairs(t):
    """Every pair of models, discordant counts and the exact p."""
    return rounded(metrics.discordant(long3(t)))


@query("market_agreement", f"""
WITH x AS (SELECT *, (p > 0.5) = (vegas_fav = 'home') AS same, (p > 0.5) = (y = 1) AS hit FROM long3 WHERE vegas_fav <> 'unresolved' AND model <> 'market'),
 a AS (SELECT model, count(*) FILTER (same) AS agree_n, avg(hit::INT) FILTER (same) AS aa, count(*) FILTER (NOT same) AS disagree_n,
  count(*) FILTER (NOT same AND hit) AS model_right, count(*) FILTER (NOT same AND NOT hit) AS vegas_right, count(*) FILTER (NOT same AND p > 0.5) AS picked_home FROM x GROUP BY 1)
SELECT model, agree_n, round(aa, 6) AS agree_acc, disagree_n, model_right, vegas_right, picked_home, {S.wilson('model_right', 'disagree_n', 'disagree_acc')},
 {S.binom_two_sided('model_right', 'disagree_n')} AS p FROM a""", ("long3",))
def market_agreement(t):
    """D11."""
    return rounded(metrics.agreement(long3(t).where("model <> 'market'")))


@query("reliability_bins", """
WITH b AS (SELECT *, CAST(list_sum(list_transform(range(1, 10), lambda i: (p >= i * 0.1::DOUBLE)::INT)) AS INTEGER) AS bin FROM long3),
 g AS (SELECT m.model, CAST(i.i AS INTEGER) AS bin FROM (SELECT DISTINCT model FROM long3) m, range(10) i(i))
SELECT g.model, g.bin, count(b.p) AS n, round(avg(p), 6) AS mean_pred, round(avg(y), 6) AS observed
FROM g LEFT JOIN b ON g.model = b.model AND g.bin = b.bin GROUP BY 1, 2""", ("long3",))
def reliability_bins(t):
    """Ten equal-width bins, empty ones kept."""
    return rounded(metrics.reliability(long3(t)))


@query("null_share_by_season", "SELECT season, " + ", ".join(f"round(avg(({m} IS NULL)::INT), 6) AS {m}" for m in METRICS) + " FROM team_log GROUP BY 1", ("team_log",))
def null_share_by_season(t):
    """Of all eleven metrics."""
    from foretime.plans.q_prior import team_log_of
    return rounded(metrics.null_shares(team_log_of(t), METRICS, ["season"]))


@query("price_distribution", """
SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std, min(l_extendedprice) AS min,
 max(l_extendedprice) AS max, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
 round(quantile_cont(l_extendedprice, 0.75), 6) AS q75 FROM lineitem GROUP BY 1""")
def price_distribution(t):
    """Exact quartiles from ranked value counts, few keys holding all rows."""
    return rounded(metrics.summary(t.raw("lineitem"), "l_extendedprice", ["l_returnflag"]), keep=("min", "max"))


@query("metric_distribution_overall", """
SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
 round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events""")
def metric_distribution_overall(t):
    """D23 without a key."""
    return rounded(metrics.summary(t.raw("events"), "value"), keep=("min", "max"))


@query("means_by_down_and_type", """
SELECT season, down, pass, count(*) AS n, round(avg(epa), 6) AS epa, round(avg(success), 6) AS success FROM plays WHERE pass = 1 OR rush = 1 GROUP BY 1, 2, 3""", ("plays",))
def means_by_down_and_type(t):
    """D24."""
    d = t.plays().where("pass = 1 OR rush = 1").groupBy("season", "down", "pass").agg(
        F.count(F.lit(1)).alias("n"), F.avg("epa").alias("epa"), F.avg("success").alias("success"))
    return d.select("season", "down", "pass", "n", *r6("epa", "success"))


@planned
def edges(t):
    return logged(t).where("model = 'champion' AND implied_p_home IS NOT NULL").select(
        "game_id", F.greatest("edge_home", "edge_away").alias("edge"))


view("edges", "SELECT game_id, greatest(edge_home, edge_away) AS edge FROM logged WHERE model = 'champion' AND implied_p_home IS NOT NULL", ("logged",))


@query("edge_histogram", """
WITH b AS (SELECT CASE WHEN round(edge, 10) >= 0.04::DOUBLE THEN CASE WHEN edge * 100 < 5 THEN 4 ELSE least(floor(edge * 100), 20) END END::INT AS bin FROM edges)
SELECT r.bin::INT AS bin, count(b.bin) AS n, round(count(b.bin)::DOUBLE / (SELECT count(*) FROM b), 6) AS share FROM range(4, 21) r(bin) LEFT JOIN b ON b.bin = r.bin GROUP BY 1""", ("edges",))
def edge_histogram(t):
    """Every bin, empty ones too, with its share of all events."""
    return rounded(tables.edge_histogram(edges(t)))


@query("predictions_with_grades", """
WITH g AS (SELECT * FROM graded WHERE model = 'champion' AND game_id % 7 <> 0)
SELECT l.game_id, l.season, l.week, l.paper_bet IN ('home', 'away') AS bet, coalesce(g.result, 'pending') AS result, g.correct, CASE WHEN l.paper_bet IN ('home', 'away') AND g.result IN ('home', 'away', 'tie') THEN g.bet_outcome END AS bet_outcome,
 round(CASE WHEN l.paper_bet IN ('home', 'away') AND g.result IN ('home', 'away', 'tie') THEN g.units END, 6) AS units
FROM logged l LEFT JOIN g USING (game_id) WHERE l.model = 'champion'""", ("logged", "graded"))
def predictions_with_grades(t):
    """C17: all predictions with their grades; those without one are pending."""
    g = graded(t).where("model = 'champion' AND game_id % 7 <> 0")
    d = tables.with_grades(logged(t).where("model = 'champion'"), g)
    return rounded(d.select("game_id", "season", "week", "bet", "result", "correct", "bet_outcome", "units"), keep=("correct",))


@query("edge_cutoff_shares", """
SELECT CAST(c AS INTEGER) AS cutoff, round(avg((round(edge * 100, 8) >= c)::INT), 6) AS share FROM edges, range(4, 19) r(c) GROUP BY 1""", ("edges",))
def edge_cutoff_shares(t):
    """D25."""
    return rounded(tables.cutoff_shares(edges(t)))


@query("edge_top_quantiles", """
SELECT round(quantile_cont(edge, 0.75), 6) AS q75, round(quantile_cont(edge, 0.9), 6) AS q90 FROM edges""", ("edges",))
def edge_top_quantiles(t):
    """Edges of the top quarter and tenth."""
    return rounded(metrics.exact_quantiles(edges(t), "edge", (0.75, 0.9)))


_CORR = METRICS


@query("correlation_pairs", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM team_log"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]), ("team_log",))
def correlation_pairs(t):
    """Every column pair in one aggregate."""
    from foretime.plans.q_prior import team_log_of
    return rounded(metrics.correlation_pairs(team_log_of(t), _CORR))


@query("home_advantage_points", """
SELECT count(*) AS n, round(avg(home_win), 6) AS p, round(400 * log10(avg(home_win) / (1 - avg(home_win))), 6) AS advantage FROM decided_games""", ("decided_games",))
def home_advantage_points(t):
    """D27."""
    return rounded(metrics.home_advantage(games(t)))


@query("season_sign_test", """
WITH s AS (SELECT season, avg((p > 0.5)::INT = y) FILTER (model = 'challenger') > avg((p > 0.5)::INT = y) FILTER (model = 'champion') AS better FROM
   (SELECT season, model, p, y FROM long3) GROUP BY 1), c AS (SELECT count(*) AS n, count(*) FILTER (better) AS k FROM s)
SELECT n, k, round(list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(n - i + 1.0::DOUBLE) - n * ln(2.0::DOUBLE)))), 6) AS p_at_least FROM c""".replace("avg((p > 0.5)::INT = y)", "avg(((p > 0.5)::INT = y)::INT)"), ("long3",))
def season_sign_test(t):
    """Seasons in which the challenger hits more often, and the chance of that many."""
    hit = F.when((F.col("p") > 0.5).cast("int") == F.col("y"), 1.0).otherwise(0.0)
    s = long3(t).groupBy("season").agg(*[F.avg(F.when(F.col("model") == x, hit)).alias(x) for x in ("champion", "challenger")])
    d = s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("challenger") > F.col("champion")).alias("k"))
    return d.withColumn("p_at_least", round6(stats.sign_test_at_least("k", "n")))


@query("pick_crosstab", """
SELECT a.pick AS champion_pick, count(*) FILTER (b.pick = 'away') AS away, count(*) FILTER (b.pick = 'home') AS home
FROM logged a JOIN logged b ON a.game_id = b.game_id AND a.model = 'champion' AND b.model = 'challenger' GROUP BY 1""", ("logged",))
def pick_crosstab(t):
    """D29."""
    both = logged(t).groupBy("game_id").agg(*[F.max(F.when(F.col("model") == x, F.col("pick"))).alias(x)
                                              for x in ("champion", "challenger")])
    return tables.two_way_counts(both.withColumnRenamed("champion", "champion_pick"), "champion_pick", "challenger", ["away", "home"])


@query("model_disagreements", """
SELECT a.season, a.week, a.game_id, a.pick AS pick_a, b.pick AS pick_b, a.paper_bet AS bet_a, b.paper_bet AS bet_b
FROM logged a JOIN logged b ON a.game_id = b.game_id AND a.model = 'champion' AND b.model = 'challenger'
WHERE a.pick <> b.pick OR a.paper_bet <> b.paper_bet""", ("logged",))
def model_disagreements(t):
    """C16."""
    return tables.model_disagreements(logged(t))


@query("current_week", """
SELECT season, coalesce(min(week) FILTER (home_score IS NULL OR away_score IS NULL), 18) AS current_week FROM schedule GROUP BY 1""", ("schedule",))
def current_week(t):
    """D30."""
    return tables.current_week(t.schedule())


_WEEK_STATUS = """ws AS (SELECT s.season, s.week, scheduled, coalesce(g.predicted, 0) AS predicted, coalesce(g.pending, 0) AS pending,
  coalesce(g.n, 0) AS graded, started, CASE WHEN g.n IS NULL THEN CASE WHEN started THEN 'missed' ELSE 'pending' END
   WHEN g.pending > 0 THEN 'pending' WHEN g.predicted < scheduled THEN CASE WHEN started THEN 'partial' ELSE 'pending' END ELSE 'graded' END AS status
 FROM (SELECT season, week, count(*) AS scheduled, bool_and(kickoff < timestamp '2001-06-15') AS started FROM schedule GROUP BY 1, 2) s
 LEFT JOIN (SELECT season, week, count(*) AS n, count(DISTINCT game_id) AS predicted, count(*) FILTER (result = 'pending') AS pending
   FROM graded WHERE model = 'champion' GROUP BY 1, 2) g ON s.season = g.season AND s.week = g.week)"""


@query("week_status_and_kind", f"""
WITH {_WEEK_STATUS} SELECT *, CASE WHEN week < 3 THEN 'before-tracking' WHEN status IN ('missed', 'partial') THEN status
  WHEN predicted > 0 THEN 'tracked' ELSE 'future' END AS kind FROM ws""", ("graded",))
def week_status_and_kind(t):
    """B38."""
    g = graded(t).where("model = 'champion'")
    d = tables.week_status(t.schedule(), logged(t).where("model = 'champion'"), g, F.lit(_CLOCK).cast("timestamp"))
    return tables.week_kind(d, 3)


_STAR = S.tier("CASE WHEN paper_bet = 'home' THEN edge_home ELSE edge_away END")


@query("week_page_summary", f"""
SELECT season, week, count(*) FILTER (result IN ('home','away') AND result = pick) AS pick_win, count(*) FILTER (result IN ('home','away') AND result <> pick) AS pick_loss,
 count(*) FILTER (result = 'tie') AS pick_push, count(*) FILTER (star AND bet_outcome = 'win') AS call_win, count(*) FILTER (star AND bet_outcome = 'loss') AS call_loss,
 count(*) FILTER (star AND bet_outcome = 'void') AS call_push
FROM (SELECT *, paper_bet <> 'none' AND {_STAR} IN ('one_star', 'two_star') AS star FROM graded WHERE model = 'champion') GROUP BY 1, 2""", ("graded",))
def week_page_summary(t):
    """D31."""
    return tables.week_pages(graded(t).where("model = 'champion'"))


@query("result_table", """
SELECT season, week, game_id, 'champion' AS model, round(p_home, 6) AS model_home_prob, round(implied_p_home, 6) AS vegas_implied_home_prob, pick AS model_pick,
 vegas_fav AS vegas_favorite, paper_bet <> 'none' AS bet, CASE WHEN paper_bet <> 'none' THEN paper_bet END AS bet_side, bet_price AS bet_odds, result,
 pick = result AS pick_correct, round(CASE WHEN paper_bet <> 'none' THEN units END, 6) AS bet_units, bet_outcome
FROM graded WHERE model = 'champion' AND result IN ('home','away')""", ("graded",))
def result_table(t):
    """Decided events joined one to one with the model's probability."""
    from foretime.operators.checks import join_one_to_one
    p = t.predictions().where("model = 'champion'").select("game_id", "p_home")
    d = tables.result_rows(join_one_to_one(games(t), p, ["game_id"]), "champion", "p_home")
    return rounded(d)


@query("evaluation_notes", f"""
WITH {_PAIRS}, pp AS (SELECT {S.binom_two_sided('only_a', '(only_a + only_b)')} AS p FROM pr),
 a AS (SELECT model, avg(((p > 0.5)::INT = y)::INT) AS acc FROM long3 GROUP BY 1)
SELECT (SELECT model FROM a ORDER BY acc DESC, model DESC LIMIT 1) AS best_model, (SELECT round(max(acc), 6) FROM a) AS best_acc,
 (SELECT min(p) FROM pp) AS min_p, (SELECT count(*) FROM pp) AS n_pairs""", ("long3",))
def evaluation_notes(t):
    """Extremes over models and pairs."""
    l = long3(t)
    return rounded(tables.evaluation_notes(metrics.evaluation_block(l), metrics.discordant(l)))


@query("coverage_by_week", """
SELECT season, week, count(*) AS games, count(*) FILTER (home_score IS NOT NULL) AS scored,
 count(*) FILTER (home_score IS NOT NULL AND p.game_id IS NOT NULL) AS with_plays, count(*) FILTER (home_score IS NULL) AS open_games,
 count(*) FILTER (home_score IS NULL AND home_moneyline IS NOT NULL) AS open_priced
FROM schedule s LEFT JOIN (SELECT DISTINCT game_id FROM plays) p ON s.game_id = p.game_id GROUP BY 1, 2""", ("schedule", "plays"))
def coverage_by_week(t):
    """A18."""
    return tables.coverage_report(t.schedule(), t.plays())


@query("accuracy_bands", """
WITH a AS (SELECT model, season, count(*) AS n, count(*) FILTER ((p > 0.5)::INT = y) AS k FROM long3 GROUP BY 1, 2)
SELECT model, season, n, k, CASE WHEN k / n > 0.70 THEN 'above 70%' WHEN k / n > 0.68 THEN '68-70%' WHEN k / n >= 0.58 THEN '58-68%'
 WHEN k / n >= 0.5 THEN '50-58%' ELSE 'below 50%' END AS band, CASE WHEN k / n > 0.55 THEN 'fail: leak suspected' WHEN k / n > 0.53 THEN 'warn: borderline high'
 WHEN k / n >= 0.47 THEN 'pass' WHEN k / n >= 0.45 THEN 'warn: borderline low' ELSE 'fail: bug suspected' END AS shuffle_band FROM a""", ("long3",))
def accuracy_bands(t):
    """B36, B37."""
    d = long3(t).groupBy("model", "season").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("p") > 0.5).cast("int") == F.col("y")).alias("k"))
    return d.select("model", "season", "n", "k", stats.accuracy_band("k", "n").alias("band"),
                    stats.shuffle_verdict(F.col("k") / F.col("n")).alias("shuffle_band"))


@query("calibration_transform", """
SELECT game_id, model, round(1 / (1 + exp(-(0.9::DOUBLE * ln(q / (1 - q)) - 0.05::DOUBLE))), 6) AS p_cal
FROM (SELECT *, least(greatest(p_home, 1e-6), 1 - 1e-6) AS q FROM logged)""", ("logged",))
def calibration_transform(t):
    """Sigmoid of a rescaled logit."""
    return logged(t).select("game_id", "model", round6(m.sigmoid(m.logit("p_home") * 0.9 - 0.05)).alias("p_cal"))


@query("deployment_rule", f"""
WITH d AS (SELECT a.game_id, b.log_loss - a.log_loss AS diff, a.correct AS ca, b.correct AS cb FROM graded a JOIN graded b
   ON a.game_id = b.game_id AND a.model = 'champion' AND b.model = 'challenger' WHERE a.log_loss IS NOT NULL),
 x AS (SELECT count(*) AS n, avg(diff) AS mu, stddev_samp(diff) AS sd, avg(ca) AS acc_a, avg(cb) AS acc_b,
  count(*) FILTER (ca = 1 AND cb = 0) AS oa, count(*) FILTER (ca = 0 AND cb = 1) AS ob FROM d),
 y AS (SELECT *, {S.binom_two_sided('oa', '(oa+ob)')} AS mcnemar_p, {S.one_sided('mu', 'sd', 'n', '-')} AS t_p FROM x)
SELECT n, round(acc_a, 6) AS champion_acc, round(acc_b, 6) AS challenger_acc, mcnemar_p, round(mu, 6) AS mean_diff, t_p,
  mcnemar_p < 0.05 AND acc_b > acc_a AS by_accuracy, mu < -0.01 AND t_p < 0.05 AS by_loss FROM y""", ("graded",))
def deployment_rule(t):
    """Exact test on hits or margin plus paired test on log loss."""
    wide = graded(t).where(scorecard.DECIDED).groupBy("game_id").agg(*[
        F.avg(F.when(F.col("model") == x, F.col(c))).alias(f"{c}_{x}")
        for x in scorecard.MODELS for c in ("log_loss", "correct")])
    a, b = F.col("correct_champion") == 1, F.col("correct_challenger") == 1
    d = wide.agg(F.count(F.lit(1)).alias("n"), F.avg("correct_champion").alias("champion_acc"),
                 F.avg("correct_challenger").alias("challenger_acc"),
                 F.count_if(a & ~b).alias("oa"), F.count_if(~a & b).alias("ob"),
                 *scorecard.moments("d", F.col("log_loss_challenger") - F.col("log_loss_champion")))
    d = d.withColumns({"mcnemar_p": stats.sign_test_two_sided("oa", F.col("oa") + F.col("ob")),
                       "t_p": stats.one_sided_t("d_mean", "d_std", "d_n", "less")})
    return rounded(d.select(
        "n", "champion_acc", "challenger_acc", "mcnemar_p", F.col("d_mean").alias("mean_diff"), "t_p",
        ((F.col("mcnemar_p") < fixed.ALPHA) & (F.col("challenger_acc") > F.col("champion_acc"))).alias("by_accuracy"),
        ((F.col("d_mean") < -fixed.LOSS_MARGIN) & (F.col("t_p") < fixed.ALPHA)).alias("by_loss")))
