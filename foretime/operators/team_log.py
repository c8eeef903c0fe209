"""Per-event entity metrics from detail rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretime.functions.scalar import is_one, rate

OFFENCE = ("qb_epa_per_db", "qb_success_rate", "cpoe", "sack_rate", "int_rate", "air_yards_per_att")
DEFENCE = ("def_epa_per_play", "def_success_allowed", "def_pressure_rate", "def_epa_early", "def_epa_money")
METRICS = OFFENCE + DEFENCE


def play_flags(plays: DataFrame) -> DataFrame:
    """Dropback, throw, scramble and scrimmage flags; an absent scramble column means none."""
    scramble = is_one("qb_scramble") if "qb_scramble" in plays.columns else F.lit(False)
    flagged = plays.withColumns({
        "is_dropback": is_one("qb_dropback"), "is_sack": is_one("sack"), "is_scramble": scramble,
        "is_play": (is_one("pass") | is_one("rush")) & F.col("epa").isNotNull()})
    return flagged.withColumn(
        "is_throw", F.col("is_dropback") & ~F.col("is_sack") & ~F.col("is_scramble"))


def team_log(plays: DataFrame, games: DataFrame) -> DataFrame:
    """One row per (event, team): counts and eleven metrics, with the event's context.

    Each play is read once as an offence row and once as a defence row, so a
    single partial-then-final aggregate yields what a full outer join of two
    aggregates would.
    """
    p = play_flags(plays.join(games.select("game_id"), "game_id", "left_semi"))
    used = ["epa", "qb_epa", "success", "sack", "cpoe", "interception", "air_yards", "down",
            "qb_hit", "is_dropback", "is_throw", "is_play"]
    rows = p.where("is_dropback OR is_play").select(
        "game_id", *used, F.explode(F.array(
            F.struct(F.col("posteam").alias("team"), F.lit(True).alias("offence")),
            F.struct(F.col("defteam").alias("team"), F.lit(False).alias("offence")))).alias("s"),
    ).select("game_id", "s.*", *used)
    off = F.col("offence")
    drop, throw, play = (F.col(c) for c in ("is_dropback", "is_throw", "is_play"))
    avg_if = lambda cond, c: F.avg(F.when(cond, F.col(c)))
    faced = ~off & drop
    log = rows.where(F.col("team").isNotNull()).groupBy("game_id", "team").agg(
        F.nullif(F.count_if(off & drop), F.lit(0)).alias("n_dropbacks"),
        F.nullif(F.count_if(~off & play), F.lit(0)).alias("n_def_plays"),
        avg_if(off & drop, "qb_epa").alias("qb_epa_per_db"),
        avg_if(off & drop, "success").alias("qb_success_rate"),
        avg_if(off & throw, "cpoe").alias("cpoe"),
        avg_if(off & drop, "sack").alias("sack_rate"),
        avg_if(off & throw, "interception").alias("int_rate"),
        avg_if(off & throw, "air_yards").alias("air_yards_per_att"),
        avg_if(~off & play, "epa").alias("def_epa_per_play"),
        avg_if(~off & play, "success").alias("def_success_allowed"),
        rate(F.count_if(faced & (is_one("qb_hit") | is_one("sack"))), F.count_if(faced))
        .alias("def_pressure_rate"),
        avg_if(~off & play & F.col("down").isin(1, 2), "epa").alias("def_epa_early"),
        avg_if(~off & play & F.col("down").isin(3, 4), "epa").alias("def_epa_money"))
    log = log.where("n_dropbacks IS NOT NULL OR n_def_plays IS NOT NULL").withColumn(
        "def_pressure_rate", F.when(F.col("n_def_plays").isNotNull(), F.col("def_pressure_rate")))
    g = games.select("game_id", "season", "week", "kickoff", "home_team", "away_team")
    is_home = F.col("team") == F.col("home_team")
    return log.join(g, "game_id").select(
        "game_id", "team", "season", "week", "kickoff", is_home.alias("is_home"),
        F.when(is_home, F.col("away_team")).otherwise(F.col("home_team")).alias("opponent"),
        "n_dropbacks", "n_def_plays", *METRICS)
