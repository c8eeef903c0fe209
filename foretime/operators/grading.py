"""Betting, scoring and grading of logged predictions against scores and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretime.functions import fixed, market as m
from foretime.operators.asof import asof_strict


def log_predictions(scored: DataFrame) -> DataFrame:
    """Add pick, implied probability, edges and the bet to rows holding ``p_home`` and prices."""
    bet = m.place_bet("p_home", "home_moneyline", "away_moneyline")
    out = scored.withColumns({"pick": m.pick("p_home"), "_bet": bet}).select("*", "_bet.*").drop("_bet")
    return out.withColumn("bet_status", F.when(F.col("paper_bet") == "none", "")
                          .otherwise(F.col("bet_status")))


def snapshot_before(events: DataFrame, snapshots: DataFrame, time: str = "kickoff",
                    pulled: str = "pulled_at", task_rows: int | None = None) -> DataFrame:
    """Each event with ``last_pulled``, the latest catalogue time strictly before it.

    Only distinct event times meet the distinct catalogue times, so the ordered
    step never sees the event rows.
    """
    times = events.select(time).where(F.col(time).isNotNull()).distinct()
    catalogue = snapshots.select(F.col(pulled).alias("last_pulled")).distinct()
    catalogue = catalogue.withColumn("_at", F.col("last_pulled"))
    found = asof_strict(times, catalogue, time, "_at", values=["last_pulled"], task_rows=task_rows)
    return events.join(found, time, "left")


def grade(logged: DataFrame, scores: DataFrame, quotes: DataFrame) -> DataFrame:
    """Outcome columns for every logged prediction; no row loop, three joins.

    ``scores``: game_id, home_score, away_score. ``quotes``: game_id, pulled_at
    and both prices, unique per (game_id, pulled_at).
    """
    g = logged.join(scores.select("game_id", "home_score", "away_score"), "game_id", "left")
    g = g.withColumn("result", m.result("home_score", "away_score"))
    won = F.when(F.col("result") == "home", 1.0).when(F.col("result") == "away", 0.0)
    g = g.withColumns({"home_win": won, "vegas_fav": m.favourite(
        "spread_line", "home_moneyline", "away_moneyline")})
    hit = lambda side: F.when(F.col("home_win").isNotNull(), (
        F.col(side) == F.col("result")).cast("double"))
    g = g.withColumns({
        "correct": hit("pick"),
        "log_loss": m.log_loss("home_win", "p_home"), "brier": m.brier("home_win", "p_home"),
        "home_correct": F.col("home_win"),
        "vegas_correct": F.when(F.col("vegas_fav") != "unresolved", hit("vegas_fav")),
        "vegas_log_loss": m.log_loss("home_win", "implied_p_home"),
        "vegas_brier": m.brier("home_win", "implied_p_home"),
        "_set": m.settle("paper_bet", "bet_price", "home_score", "away_score"),
    }).select("*", "_set.*").drop("_set")

    g = snapshot_before(g, quotes)
    late = quotes.select("game_id", F.col("pulled_at").alias("last_pulled"),
                         m.fair_home_prob("home_moneyline", "away_moneyline").alias("_late"))
    g = g.join(late, ["game_id", "last_pulled"], "left")
    gap = F.unix_micros("last_pulled") - F.unix_micros("predicted_from")
    status = (F.when(F.col("implied_p_home").isNull(), fixed.LINE_MISSING_THEN)
              .when(F.col("last_pulled").isNull() | (gap <= 0), fixed.LINE_NO_LATER)
              .when(gap < fixed.MIN_LINE_GAP_HOURS * 3_600_000_000, fixed.LINE_TOO_SOON)
              .when(F.col("_late").isNull(), fixed.LINE_MISSING_LATE).otherwise(fixed.LINE_MEASURED))
    g = g.withColumn("clv_status", status).withColumn(
        "p_late_home", F.when(F.col("clv_status") == fixed.LINE_MEASURED, F.col("_late")))
    return g.withColumns({
        "bet_clv": m.line_value("paper_bet", "implied_p_home", "p_late_home"),
        "line_move_toward_model": m.move_toward_model("p_home", "implied_p_home", "p_late_home"),
    }).drop("_late")
