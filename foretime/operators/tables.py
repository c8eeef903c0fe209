"""Report tables over schedule, predictions and grades: one aggregate each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretime.functions import market as m, stats
from foretime.operators.checks import join_one_to_one


def current_week(schedule: DataFrame, keys: Sequence[str] = ("season",), last_week: int = 18) -> DataFrame:
    """Earliest week with an event that has no final score, else the last week."""
    open_ = F.col("home_score").isNull() | F.col("away_score").isNull()
    return schedule.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(open_, F.col("week"))), F.lit(last_week)).alias("current_week"))


def week_status(schedule: DataFrame, predicted: DataFrame, graded: DataFrame, now: Column,
                keys: Sequence[str] = ("season", "week")) -> DataFrame:
    """graded, partial, missed or pending, from counts per week."""
    keys = list(keys)
    s = schedule.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scheduled"), F.bool_and(F.col("kickoff") < now).alias("started"))
    p = predicted.groupBy(*keys).agg(F.countDistinct("game_id").alias("predicted"))
    g = graded.groupBy(*keys).agg(F.count(F.lit(1)).alias("graded"),
                                  F.count_if(F.col("result") == "pending").alias("pending"))
    d = s.join(p, keys, "left").join(g, keys, "left").fillna(0, ["predicted", "graded", "pending"])
    status = (F.when((F.col("predicted") == 0) & F.col("started"), "missed")
              .when(F.col("predicted") == 0, "pending")
              .when((F.col("graded") < F.col("predicted")) | (F.col("pending") > 0), "pending")
              .when((F.col("predicted") < F.col("scheduled")) & F.col("started"), "partial")
              .when(F.col("predicted") < F.col("scheduled"), "pending").otherwise("graded"))
    return d.withColumn("status", status)


def week_kind(status: DataFrame, first_week: int) -> DataFrame:
    kind = (F.when(F.col("week") < first_week, "before-tracking")
            .when(F.col("status").isin("missed", "partial"), F.col("status"))
            .when(F.col("predicted") > 0, "tracked").otherwise("future"))
    return status.withColumn("kind", kind)


def week_pages(graded: DataFrame, keys: Sequence[str] = ("season", "week")) -> DataFrame:
    """Records of all picks and of starred calls per week."""
    pick = m.grade_side("pick", "result")
    call = F.when(F.col("paper_bet") != "none", m.grade_side("paper_bet", "result"))
    starred = m.tier(m.side_value("paper_bet", "edge_home", "edge_away")).isin("one_star", "two_star")
    d = graded.withColumns({"_pick": pick, "_call": F.when(starred, call)})
    return d.groupBy(*keys).agg(*[F.count_if(F.col(f"_{w}") == g).alias(f"{w}_{g}")
                                  for w in ("pick", "call") for g in ("win", "loss", "push")])


def result_rows(games: DataFrame, model: str, p: str) -> DataFrame:
    """Per decided event: pick, market favourite, bet, units and whether the pick held."""
    d = games.withColumns({
        "_bet": m.place_bet(p, "home_moneyline", "away_moneyline"),
        "vegas_favorite": m.favourite("spread_line", "home_moneyline", "away_moneyline"),
        "model_pick": m.pick(p), "result": m.result("home_score", "away_score")})
    d = d.withColumn("_set", m.settle("_bet.paper_bet", "_bet.bet_price", "home_score", "away_score"))
    bet = F.col("_bet.paper_bet") != "none"
    return d.select(
        "season", "week", "game_id", F.lit(model).alias("model"), F.col(p).alias("model_home_prob"),
        F.col("_bet.implied_p_home").alias("vegas_implied_home_prob"), "model_pick", "vegas_favorite",
        bet.alias("bet"), F.when(bet, F.col("_bet.paper_bet")).alias("bet_side"),
        F.col("_bet.bet_price").alias("bet_odds"), "result",
        (F.col("model_pick") == F.col("result")).alias("pick_correct"),
        F.when(bet, F.col("_set.units")).alias("bet_units"), F.col("_set.bet_outcome").alias("bet_outcome"))


def with_grades(predictions: DataFrame, graded: DataFrame, key: str = "game_id") -> DataFrame:
    """Every prediction with what its grading says; an ungraded one is ``pending``. Units count only for
    settled bets. Two grades of one prediction are refused."""
    g = graded.select(key, "result", "correct", "bet_outcome", "units")
    d = join_one_to_one(predictions.drop("result", "correct", "bet_outcome", "units"), g, [key], "left")
    bet = F.col("paper_bet").isin("home", "away")
    result = F.coalesce("result", F.lit("pending"))
    settled = bet & result.isin("home", "away", "tie")
    return d.withColumns({"result": result, "bet": bet, "bet_outcome": F.when(settled, F.col("bet_outcome")), "units": F.when(settled, F.col("units"))})


def edge_histogram(edges: DataFrame, first: int = 4, last: int = 20) -> DataFrame:
    """Whole-point bins of the positive edge, the first and last open-ended; only qualifying edges.

    Every bin comes out, empty ones with 0, with its share of all events, qualifying or not.
    """
    points = F.col("edge") * 100
    bin = F.when(points < first + 1, F.lit(first)).otherwise(F.least(F.floor(points), F.lit(last)))
    held = F.when(m.qualifies("edge"), bin).cast("int")
    row = edges.agg(F.count(F.lit(1)).alias("of"), *[F.count_if(held == b).alias(f"b{b}") for b in range(first, last + 1)])
    cells = [F.struct(F.lit(b).alias("bin"), F.col(f"b{b}").alias("n"), F.try_divide(F.col(f"b{b}"), F.col("of")).alias("share")) for b in range(first, last + 1)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def cutoff_shares(edges: DataFrame, first: int = 4, last: int = 18) -> DataFrame:
    """Share of all events at or above each whole-point cutoff, in one pass."""
    e = F.round(F.col("edge") * 100, 6)
    row = edges.agg(*[F.avg((e >= c).cast("double")).alias(f"c{c}") for c in range(first, last + 1)])
    cells = [F.struct(F.lit(c).alias("cutoff"), F.col(f"c{c}").alias("share")) for c in range(first, last + 1)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def model_disagreements(logged: DataFrame, a: str = "champion", b: str = "challenger") -> DataFrame:
    """Events where two models pick or bet differently, from one aggregate per event."""
    view = F.struct("pick", "paper_bet", "p_home")
    wide = logged.groupBy("season", "week", "game_id").agg(*[
        F.max(F.when(F.col("model") == x, view)).alias(n) for x, n in ((a, "a"), (b, "b"))])
    return wide.where((F.col("a.pick") != F.col("b.pick")) | (F.col("a.paper_bet") != F.col("b.paper_bet"))).select(
        "season", "week", "game_id", F.col("a.pick").alias("pick_a"), F.col("b.pick").alias("pick_b"),
        F.col("a.paper_bet").alias("bet_a"), F.col("b.paper_bet").alias("bet_b"))


def two_way_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().fillna(0)


def evaluation_notes(block: DataFrame, pairs: DataFrame) -> DataFrame:
    """Best accuracy among models and the smallest pairwise p value."""
    best = block.where("block = 'pooled'").agg(F.max_by("model", F.struct("acc", "model")).alias("best_model"),
                                               F.max("acc").alias("best_acc"))
    least = pairs.agg(F.min("p").alias("min_p"), F.count(F.lit(1)).alias("n_pairs"))
    return best.withColumn("_one", F.lit(1)).join(least.withColumn("_one", F.lit(1)), "_one").drop("_one")


def coverage_report(schedule: DataFrame, plays: DataFrame) -> DataFrame:
    """Per week: scored events, those with detail rows, open events with prices."""
    seen = plays.select("game_id").distinct().withColumn("has_plays", F.lit(True))
    d = schedule.join(seen, "game_id", "left")
    scored = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    priced = F.col("home_moneyline").isNotNull() & F.col("away_moneyline").isNotNull()
    return d.groupBy("season", "week").agg(
        F.count(F.lit(1)).alias("games"), F.count_if(scored).alias("scored"),
        F.count_if(scored & F.coalesce("has_plays", F.lit(False))).alias("with_plays"),
        F.count_if(~scored).alias("open_games"), F.count_if(~scored & priced).alias("open_priced"))
