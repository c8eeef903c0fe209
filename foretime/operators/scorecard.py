"""Scorecard tables over graded predictions: each is one aggregate over tagged rows.

Row counts never reach the driver or one task: rows are tagged with the block
they belong to (a row may belong to several), combined per partition, and
intervals and tests are expressions on the few aggregated rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretime.functions import fixed, market as m, stats

MODELS = ("champion", "challenger")
DECIDED = "result IN ('home', 'away')"
SIDES = "paper_bet IN ('home', 'away')"


def moments(name: str, c: Column) -> list[Column]:
    return [F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_std"),
            F.count(c).alias(f"{name}_n")]


def with_interval(df: DataFrame, name: str) -> DataFrame:
    """Replace the standard deviation by the 95 % t interval of the mean."""
    return df.withColumn("_i", stats.mean_interval(f"{name}_mean", f"{name}_std", f"{name}_n")).select(
        *df.columns, F.col("_i.low").alias(f"{name}_low"), F.col("_i.high").alias(f"{name}_high"))


def with_wilson(df: DataFrame, k: str, n: str, name: str = "acc") -> DataFrame:
    return df.withColumn("_w", stats.wilson(k, n)).select(
        *df.columns, F.try_divide(F.col(k), F.col(n)).alias(name),
        F.col("_w.low").alias(f"{name}_low"), F.col("_w.high").alias(f"{name}_high"))


def predictor_rows(graded: DataFrame) -> DataFrame:
    """Both models, home baseline, market favourite and market probability side by side."""
    row = lambda name, hit, ll, br: F.struct(
        F.lit(name).alias("predictor"), hit.alias("hit"), ll.alias("ll"), br.alias("br"))
    none = F.lit(None).cast("double")
    champ = F.col("model") == "champion"
    tags = F.array_compact(F.array(
        F.when(F.col("model").isin(*MODELS), F.struct(
            F.col("model").alias("predictor"), F.col("correct").alias("hit"),
            F.col("log_loss").alias("ll"), F.col("brier").alias("br"))),
        F.when(champ, row("home_baseline", F.col("home_correct"), none, none)),
        F.when(champ & F.col("vegas_correct").isNotNull(),
               row("vegas_favorite", F.col("vegas_correct"), none, none)),
        F.when(champ & F.col("vegas_log_loss").isNotNull(),
               row("vegas_implied", none, F.col("vegas_log_loss"), F.col("vegas_brier")))))
    d = graded.where(DECIDED).select(F.explode(tags).alias("t")).select("t.*")
    d = d.groupBy("predictor").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").cast("bigint").alias("k"),
        *moments("ll", F.col("ll")), *moments("br", F.col("br")))
    d = with_wilson(d, "k", "n")
    for c in ("ll", "br"):
        d = with_interval(d, c)
    return d.drop("ll_std", "br_std", "ll_n", "br_n")


def bet_aggregates(with_move: bool = True) -> list[Column]:
    """Counts, units, return and line value of a group of rows; bets are rows with a side."""
    bet = F.expr(SIDES)
    outcome = lambda o: F.count_if(bet & (F.col("bet_outcome") == o))
    settled = F.when(bet & F.col("bet_outcome").isin("win", "loss"), F.col("units"))
    measured = F.col("clv_status") == fixed.LINE_MEASURED
    out = [F.count_if(bet).alias("bets"), outcome("win").alias("w"), outcome("loss").alias("l"),
           outcome("void").alias("void"), outcome("pending").alias("pending"),
           F.coalesce(F.sum(settled), F.lit(0.0)).alias("units"),
           F.count_if(bet & (F.col("paper_bet") == "home")).alias("home_bets"),
           F.count_if(bet & ~measured).alias("clv_excluded"),
           *moments("roi", settled), *moments("clv", F.when(bet & measured, F.col("bet_clv")))]
    if with_move:
        out += moments("move", F.when(measured & F.col("counts_move"), F.col("line_move_toward_model")))
    return out


def finish_bets(d: DataFrame, names: Sequence[str] = ("roi", "clv", "move")) -> DataFrame:
    d = d.withColumn("clv_p", stats.one_sided_t("clv_mean", "clv_std", "clv_n", "greater"))
    for n in names:
        d = with_interval(d, n)
    return d.drop(*[f"{n}_std" for n in names], "roi_n")


def betting_rows(graded: DataFrame) -> DataFrame:
    """Per model all rows, plus the official record by what was logged."""
    official = F.expr(SIDES) & (F.col("bet_status") == "official")
    tag = lambda label, move: F.struct(label.alias("label"), F.lit(move).alias("counts_move"))
    tags = F.array_compact(F.array(
        F.when(F.col("model").isin(*MODELS), tag(F.col("model"), True)),
        F.when(official, tag(F.lit("official"), False))))
    d = graded.withColumn("_t", F.explode(tags)).select("*", "_t.*")
    return finish_bets(d.groupBy("label").agg(*bet_aggregates()))


def edge_breakdown(graded: DataFrame) -> DataFrame:
    """Bets per model and edge bucket; empty buckets stay, small ones are marked."""
    edge = m.side_value("paper_bet", "edge_home", "edge_away")
    d = graded.where(SIDES).withColumn("bucket", m.edge_bucket(edge))
    d = d.groupBy("model", "bucket").agg(*bet_aggregates(with_move=False))
    spark = graded.sparkSession
    grid = spark.createDataFrame([(a, b) for a in MODELS for b in m.BUCKETS], "model string, bucket string")
    counts = ["bets", "w", "l", "void", "pending", "home_bets", "clv_excluded", "roi_n", "clv_n"]
    d = grid.join(d, ["model", "bucket"], "left").fillna(0, counts).fillna(0.0, ["units"])
    d = finish_bets(d, ("roi", "clv"))
    return d.withColumn("small_sample", F.col("bets") < m.SMALL_BUCKET)


def official_calls(graded: DataFrame) -> DataFrame:
    calls = graded.where(SIDES).where("bet_status = 'official'").withColumns({
        "side_edge": m.side_value("paper_bet", "edge_home", "edge_away"),
        "side_implied": m.side_prob("paper_bet", "implied_p_home")})
    return calls.withColumn("tier", m.tier("side_edge"))


def calls_without_tier(graded: DataFrame) -> DataFrame:
    """Rule violations: an official bet must have a tier. Empty when all is well."""
    return official_calls(graded).where("tier IS NULL")


def wins_over_expected(graded: DataFrame) -> DataFrame:
    """Per tier and for all official calls, ties left out of the sums.

    Probabilities and edges are added up as decimals, so no sum depends on the order of its rows.
    """
    total = lambda c: F.coalesce(F.sum(F.when(live, F.col(c)).cast("decimal(28,18)")).cast("double"), F.lit(0.0))
    live = F.col("bet_outcome").isin("win", "loss")
    d = official_calls(graded).where("tier IS NOT NULL").rollup("tier").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("bet_outcome") == "win").alias("wins"),
        F.count_if(F.col("bet_outcome") == "loss").alias("losses"),
        F.count_if(F.col("bet_outcome") == "void").alias("pushes"),
        F.count_if(F.col("bet_outcome") == "pending").alias("pending"),
        F.count_if(live).alias("n"),
        total("side_implied").alias("vegas_expected"), total("side_edge").alias("model_expected"))
    over = F.col("wins") - F.col("vegas_expected")
    return d.select(F.coalesce("tier", F.lit("all")).alias("tier"), "calls", "wins", "losses", "pushes",
                    "pending", "n", "vegas_expected", "model_expected", over.alias("woe"),
                    F.try_divide(over, F.col("n")).alias("woe_per_call"),
                    F.try_divide(F.col("model_expected"), F.col("n")).alias("model_expected_per_call"))


def confidence_rows(graded: DataFrame, model: str = "champion") -> DataFrame:
    """Logged and decided picks for confident games, toss-ups and all of them."""
    d = graded.where(F.col("model") == model).withColumn(
        "block", F.when(m.toss_up("p_home"), "toss_up").otherwise("confident"))
    d = d.rollup("block").agg(
        F.count(F.lit(1)).alias("logged"), F.count("correct").alias("n"),
        F.coalesce(F.sum("correct").cast("bigint"), F.lit(0)).alias("k"))
    return with_wilson(d.withColumn("block", F.coalesce("block", F.lit("all"))), "k", "n")


def weekly_rows(graded: DataFrame, keys: Sequence[str] = ("season", "week", "model")) -> DataFrame:
    bet = F.expr(SIDES)
    clv = F.when(bet & (F.col("clv_status") == fixed.LINE_MEASURED), F.col("bet_clv"))
    return graded.groupBy(*keys).agg(
        F.count("correct").alias("n"), *[F.avg(c).alias(c) for c in (
            "correct", "log_loss", "brier", "home_correct", "vegas_correct")],
        F.count_if(bet).alias("bets"),
        F.coalesce(F.sum(F.when(bet & F.col("bet_outcome").isin("win", "loss"), F.col("units"))),
                   F.lit(0.0)).alias("units"),
        F.avg(clv).alias("clv_mean"), F.count(clv).alias("clv_n"))


def paired(graded: DataFrame, value: str = "log_loss", key: str = "game_id",
           extra: Sequence[str] = ()) -> DataFrame:
    """Both models' value per commonly graded event, in one aggregate."""
    wide = graded.where(DECIDED).groupBy(key, *extra).agg(
        *[F.avg(F.when(F.col("model") == x, F.col(value))).alias(x) for x in MODELS])
    return wide.where("champion IS NOT NULL AND challenger IS NOT NULL").withColumn(
        "diff", F.col("challenger") - F.col("champion"))


def paired_test(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean difference, one-sided p that it is below zero, and the swap rule."""
    d = pairs.groupBy(*keys).agg(F.avg("champion").alias("champion"), F.avg("challenger").alias("challenger"),
                                 *moments("diff", F.col("diff")))
    d = d.withColumn("p", stats.one_sided_t("diff_mean", "diff_std", "diff_n", "less"))
    swap = (F.col("diff_mean") < -fixed.LOSS_MARGIN) & (F.col("p") < fixed.ALPHA)
    return d.withColumn("swap", F.coalesce(swap, F.lit(False))).drop("diff_std")


def checkpoint_weeks(graded: DataFrame, predicted: DataFrame, schedule: DataFrame, now: Column,
                     keys: Sequence[str] = ("season", "week"),
                     window: tuple[int, int] = fixed.CHECKPOINT_WEEKS) -> DataFrame:
    """Status of each week of the window: graded, missed, or what it waits for.

    ``predicted``: keys and game_id of logged predictions; ``schedule``: keys,
    game_id and kickoff.
    """
    keys = list(keys)
    inside = F.col("week").between(*window)
    g = graded.where(inside).groupBy(*keys, "game_id").agg(
        *[F.max(F.col("model") == x).alias(f"has_{x}") for x in MODELS],
        F.max((F.col("model") == "champion") & (F.col("result") == "pending")).alias("pending"))
    p = predicted.where(inside).select(*keys, "game_id").distinct().withColumn("wanted", F.lit(True))
    per_game = p.join(g, [*keys, "game_id"], "full")
    want = F.coalesce("wanted", F.lit(False))
    counts = per_game.groupBy(*keys).agg(
        F.count_if(want).alias("predicted"),
        F.count_if(F.col("has_champion").isNotNull()).alias("graded_rows"),
        *[F.count_if(want & ~F.coalesce(f"has_{x}", F.lit(False))).alias(f"missing_{x}") for x in MODELS],
        F.count_if(want & F.coalesce("pending", F.lit(False))).alias("pending"))
    s = schedule.where(inside).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scheduled"),
        F.count_if(F.col("kickoff") >= now).alias("not_started"),
        F.count_if(F.col("kickoff").isNull()).alias("undated"))
    d = s.join(counts, keys, "full").fillna(0)
    has = F.col("predicted") > 0
    status = (F.when(has & (F.col("missing_champion") > 0), "awaiting grading: champion")
              .when(has & (F.col("missing_challenger") > 0), "awaiting grading: challenger")
              .when(has & (F.col("pending") > 0), "pending games")
              .when(has, "graded")
              .when(F.col("graded_rows") > 0, "graded rows without a prediction file")
              .when(F.col("scheduled") == 0, "week not in the schedule")
              .when((F.col("not_started") > 0) | (F.col("undated") > 0), "not predicted, still open")
              .otherwise("missed"))
    return d.withColumn("status", status).withColumn("done", F.col("status").isin("graded", "missed")).select(
        *keys, "scheduled", "predicted", "pending", "status", "done")


def checkpoint(graded: DataFrame, weeks: DataFrame, period: Sequence[str] = ("season",),
               window: tuple[int, int] = fixed.CHECKPOINT_WEEKS) -> DataFrame:
    """Decision per period: not evaluable until every week of the window is done."""
    period = list(period)
    ready = weeks.groupBy(*period).agg(
        F.bool_and("done").alias("all_done"), F.countDistinct("week").alias("n_weeks"))
    ready = ready.withColumn("evaluable", F.col("all_done") & (
        F.col("n_weeks") == window[1] - window[0] + 1))
    test = paired_test(paired(graded.where(F.col("week").between(*window)), extra=period), period)
    d = ready.join(test, period, "left")
    decision = (F.when(~F.col("evaluable"), "not yet evaluable")
                .when(F.col("swap"), "swap").otherwise("no swap"))
    return d.select(*period, "evaluable", "diff_n", "diff_mean", "p", decision.alias("decision"))


def verdict(graded: DataFrame) -> DataFrame:
    """Evidence only when the official mean line value is above zero with p below alpha."""
    d = betting_rows(graded).where("label = 'official'")
    found = (F.col("clv_n") >= 2) & (F.col("clv_mean") > 0) & (F.col("clv_p") < fixed.ALPHA)
    return d.select("bets", "clv_n", "clv_mean", "clv_low", "clv_high", "clv_p", "roi_mean",
                    "roi_low", "roi_high", F.coalesce(found, F.lit(False)).alias("evidence"))


def logged_beside_graded(logged: DataFrame, graded: DataFrame) -> DataFrame:
    """Tier counts of everything logged (pending too) beside the graded ones."""
    t = official_calls(logged).rollup("tier").agg(F.count(F.lit(1)).alias("calls_logged")).select(
        F.coalesce("tier", F.lit("all")).alias("tier"), "calls_logged")
    return t.join(wins_over_expected(graded).select("tier", F.col("calls").alias("calls_graded"),
                                                    "wins", "losses", "pushes"), "tier", "left")
