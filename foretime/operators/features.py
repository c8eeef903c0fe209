"""Model-facing features from an entity log: windows, priors, shrinkage, sides, context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from foretime.functions import fixed
from foretime.functions.clock import utc_offset_hours
from foretime.functions.geo import great_circle_km
from foretime.functions.scalar import clip, indicator, recode, shrink
from foretime.operators.prior import fill_gaps, prior_ewm, prior_running, prior_window
from foretime.operators.sides import to_event
from foretime.operators.team_log import METRICS
from foretime.session import keeps_dealt

MATCHUPS = {
    "mu_qb_epa_vs_def": ("home_qb_epa_per_db_shrunk", "away_def_epa_per_play_shrunk"),
    "mu_def_vs_qb_epa": ("away_qb_epa_per_db_shrunk", "home_def_epa_per_play_shrunk"),
    "mu_success_edge_h": ("home_qb_success_rate_shrunk", "away_def_success_allowed_shrunk"),
    "mu_success_edge_a": ("away_qb_success_rate_shrunk", "home_def_success_allowed_shrunk"),
    "mu_money_down_edge": ("home_qb_epa_per_db_shrunk", "away_def_epa_money_shrunk"),
    "mu_protection_edge": ("away_def_pressure_rate_shrunk", "home_sack_rate_shrunk"),
}
CONTEXT = ("is_neutral", "home_rest", "away_rest", "rest_diff", "div_game", "roof_indoor",
           "travel_dist_home", "travel_dist_away", "travel_diff", "tz_home_offset",
           "tz_away_offset", "tz_diff")

#: Columns of the model frame that are one other column less another.
DIFFERENCES = {**MATCHUPS, "rest_diff": ("home_rest", "away_rest"), "travel_diff": ("travel_dist_away", "travel_dist_home"),
               "tz_diff": ("tz_home_offset", "tz_away_offset"), "elo_diff": ("home_elo_pre", "away_elo_pre")}


def period_means(log: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return log.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def prior_period(log: DataFrame, entity: str, period: str, metrics: Sequence[str]) -> DataFrame:
    """Each (entity, period): means of the entity's most recent earlier period.

    Both sides of the as-of share their keys, so the earlier row is simply the
    previous one. The window runs over one row per period.
    """
    w = W.partitionBy(entity).orderBy(period)
    per = period_means(log, [entity, period], metrics)
    return per.select(entity, period, *[F.lag(m).over(w).alias(f"{m}_prior") for m in metrics])


def pooled_prior(log: DataFrame, period: str, metrics: Sequence[str],
                 seed_order: Sequence[str] | None = None) -> DataFrame:
    """Each period: means over all entities in the latest earlier period.

    The first period has none. With ``seed_order`` it takes the mean of its own
    rows before its last one, one value for the whole period (this looks ahead
    inside that period; ``seed_first_period`` is the point-in-time form).
    """
    means = period_means(log, [period], metrics)
    if seed_order:
        last = F.struct(*seed_order)
        seeds = log.groupBy(period).agg(*[x for m in metrics for x in (
            F.sum(m).alias(f"{m}_s"), F.count(m).alias(f"{m}_c"),
            F.max_by(F.struct(F.col(m).alias("v")), last).alias(f"{m}_l"))])
        means = means.join(seeds, period)
    w = W.orderBy(period)
    out = []
    for m in metrics:
        value = F.lag(m).over(w)
        if seed_order:
            held_out = F.col(f"{m}_l")["v"]
            seed = F.try_divide(F.col(f"{m}_s") - F.coalesce(held_out, F.lit(0.0)),
                                F.col(f"{m}_c") - held_out.isNotNull().cast("int"))
            value = F.when(F.row_number().over(w) == 1, seed).otherwise(value)
        out.append(value.alias(f"{m}_league"))
    # one row per period: a single small task
    return means.select(period, *out)


def seed_first_period(log: DataFrame, period: str, order: Sequence[str],
                      metrics: Sequence[str], task_rows: int | None = None) -> DataFrame:
    """Point-in-time seed: the running mean over all entities, strictly before each row."""
    first = log.agg(F.min(period).alias("_first"))
    rows = log.join(F.broadcast(first), F.col(period) == F.col("_first")).drop("_first")
    return prior_running(rows, [], order, {f"{m}_seed": (m, "mean") for m in metrics},
                         task_rows=task_rows)


def rolled(log: DataFrame, entity: str = "team", period: str = "season", time: str = "kickoff",
           id: str = "game_id", metrics: Sequence[str] = METRICS, k: float = fixed.SHRINK_K,
           rows: int = fixed.IN_SEASON_ROWS, halflife: float = fixed.EWM_HALFLIFE,
           seed: str = "running", leaky: Sequence[str] = (),
           task_rows: int | None = None) -> DataFrame:
    """Per log row: ``{m}_shrunk``, ``{m}_sd``, ``{m}_sd_n``, ``{m}_ewm`` and ``games_played_sd``.

    ``seed`` is ``running`` (point-in-time) or ``last_row`` (one value for the
    first period). ``leaky`` names windows (``metric`` or ``metric_ewm``) that
    include the current row, for negative controls.
    """
    order = [time, id]
    base = log.withColumn("_one", F.lit(1))
    if seed == "running":
        # few columns yet: joined later, the seeds would move every window's result once more
        seeds = seed_first_period(log, period, [time, id, entity], metrics, task_rows).select(
            entity, id, *[f"{m}_seed" for m in metrics])
        if keeps_dealt(log.sparkSession):
            # the windows by entity take the rows where the join left them: one shuffle serves both
            base = base.repartition(entity)
        base = base.join(seeds, [entity, id], "left")
    sound = [m for m in metrics if m not in leaky]
    aggs = lambda ms: {x: y for m in ms for x, y in (
        (f"{m}_sd", (m, "mean")), (f"{m}_sd_n", (m, "count")))}
    # the exponential means go first: their shuffle by entity also serves the windows by (entity, period)
    out = base
    ewm_ok = [m for m in metrics if f"{m}_ewm" not in leaky]
    ewm_bad = [m for m in metrics if f"{m}_ewm" in leaky]
    for ms, current in ((ewm_ok, False), (ewm_bad, True)):
        if ms:
            out = prior_ewm(out, [entity], order, {f"{m}_ewm": m for m in ms}, halflife,
                            include_current=current, task_rows=task_rows, sized=log)
    out = prior_window(out, [entity, period], order,
                       {**aggs(sound), "games_played_sd": ("_one", "count")}, rows, task_rows=task_rows, sized=log)
    bad = [m for m in metrics if m in leaky]
    if bad:
        out = prior_window(out, [entity, period], order, aggs(bad), rows, include_current=True,
                           task_rows=task_rows, sized=log)
    own = prior_period(log, entity, period, metrics)
    pooled = pooled_prior(log, period, metrics,
                          seed_order=[time, id, entity] if seed == "last_row" else None)
    # an entity's periods in one row: the rows stay where the windows by entity put them
    own = own.where(F.col(period).isNotNull()).groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct(
        period, F.struct(*[f"{m}_prior" for m in metrics])))).alias("_own"))
    out = out.join(own.hint("merge"), entity, "left").withColumn("_own", F.try_element_at("_own", F.col(period)))
    out = out.select("*", *[F.col(f"_own.{m}_prior") for m in metrics]).drop("_own")
    out = out.join(F.broadcast(pooled), period, "left")
    if seed == "running":
        out = out.withColumns({f"{m}_league": F.coalesce(f"{m}_league", f"{m}_seed") for m in metrics})
    keep = [c for c in log.columns if c not in metrics]
    return out.select(*keep, "games_played_sd", *[x for m in metrics for x in (
        shrink(f"{m}_sd_n", f"{m}_sd", f"{m}_prior", f"{m}_league", k).alias(f"{m}_shrunk"),
        F.col(f"{m}_sd"), F.col(f"{m}_sd_n"), F.col(f"{m}_ewm"))])


def home_base(schedule: DataFrame) -> DataFrame:
    """Most used home venue per (team, season), smallest id on ties, gaps filled per team."""
    used = schedule.where("game_type = 'REG' AND location = 'Home'").groupBy(
        recode("home_team", fixed.TEAM_CODES).alias("team"), "season", "stadium_id").agg(F.count(F.lit(1)).alias("n"))
    best = used.where("stadium_id IS NOT NULL").groupBy("team", "season").agg(
        F.min(F.struct(-F.col("n"), F.col("stadium_id"))).alias("b"))
    seasons = used.select("team", "season").distinct()
    modal = seasons.join(best, ["team", "season"], "left").select(
        "team", "season", F.col("b.stadium_id").alias("stadium_id"))
    return fill_gaps(modal, ["team"], ["season"], "stadium_id")


def context(games: DataFrame, base: DataFrame, venues: DataFrame) -> DataFrame:
    """Twelve facts known before the event. ``venues``: stadium_id, lat, lon, tz, one row per venue."""
    v = F.broadcast(venues)
    g = games.join(F.broadcast(venues.select("stadium_id", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))),
                   "stadium_id", "left")
    for side in ("home", "away"):
        at = base.join(v, "stadium_id", "left").select(
            F.col("team").alias(f"{side}_team"), "season", F.col("lat").alias(f"{side}_lat"),
            F.col("lon").alias(f"{side}_lon"), F.col("tz").alias(f"{side}_tz"))
        g = g.join(at, [f"{side}_team", "season"], "left")
    km = lambda s: great_circle_km(f"{s}_lat", f"{s}_lon", "g_lat", "g_lon")
    g = g.withColumns({
        "is_neutral": F.coalesce((F.col("location") == "Neutral").cast("int"), F.lit(0)),
        "home_rest": clip("home_rest", 3.0, 20.0), "away_rest": clip("away_rest", 3.0, 20.0),
        "div_game": F.col("div_game").cast("double"),
        "roof_indoor": indicator("roof", fixed.ROOF_CLOSED, fixed.ROOF_OPEN),
        "travel_dist_home": km("home"), "travel_dist_away": km("away"),
        "tz_home_offset": utc_offset_hours("kickoff", "home_tz", "last"),
        "tz_away_offset": utc_offset_hours("kickoff", "away_tz", "last")})
    return g.withColumns({
        "rest_diff": F.col("home_rest") - F.col("away_rest"),
        "travel_diff": F.col("travel_dist_away") - F.col("travel_dist_home"),
        "tz_diff": F.col("tz_home_offset") - F.col("tz_away_offset")}).select("game_id", *CONTEXT)


def venue_table(spark) -> DataFrame:
    return spark.createDataFrame(list(fixed.VENUES), "stadium_id string, lat double, lon double, tz string")


def assemble(rolled_log: DataFrame, games: DataFrame, facts: DataFrame, ratings: DataFrame,
             metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per event: both sides' features, matchups, context, ratings, label."""
    cols = ["games_played_sd", *[f"{m}_shrunk" for m in metrics], *[f"{m}_ewm" for m in metrics]]
    wide = to_event(rolled_log, "game_id", "is_home", cols)
    wide = wide.join(facts, "game_id").join(
        ratings.select("game_id", F.col("home_pre").alias("home_elo_pre"),
                       F.col("away_pre").alias("away_elo_pre"),
                       (F.col("home_pre") - F.col("away_pre")).alias("elo_diff")), "game_id")
    wide = wide.join(games.select("game_id", "season", "week", "kickoff", "home_win"), "game_id")
    frame = wide.withColumns({n: F.col(a) - F.col(b) for n, (a, b) in MATCHUPS.items()
                              if a in wide.columns and b in wide.columns})
    refuse_leaky_columns(frame, metrics)
    return frame


def feature_columns(metrics: Sequence[str] = METRICS) -> list[str]:
    sides = [c for s in ("home", "away") for c in (
        *[f"{s}_{m}_shrunk" for m in metrics], *[f"{s}_{m}_ewm" for m in metrics],
        f"{s}_games_played_sd")]
    return [*sides, *MATCHUPS, *CONTEXT, "home_elo_pre", "away_elo_pre", "elo_diff"]


def leaky_columns(columns: Sequence[str], metrics: Sequence[str] = METRICS,
                  priced: Sequence[str] = fixed.PRICE_COLUMNS) -> list[str]:
    """Columns a model frame must not hold: raw metrics of a side, or anything priced."""
    raw = {f"{s}_{m}" for s in ("home", "away") for m in metrics}
    return [c for c in columns if c in raw or any(p in c for p in priced)]


def refuse_leaky_columns(frame: DataFrame, metrics: Sequence[str] = METRICS) -> None:
    bad = leaky_columns(frame.columns, metrics)
    if bad:
        raise ValueError(f"outcome or price columns in the model frame: {bad}")


def feature_manifest(spark, metrics: Sequence[str] = METRICS, k: float = fixed.SHRINK_K,
                     rows: int = fixed.IN_SEASON_ROWS, halflife: float = fixed.EWM_HALFLIFE) -> DataFrame:
    """One row per model column: how it is made and why it is known before the event."""
    out = []
    for c in feature_columns(metrics):
        stem = c.split("_", 1)[1] if c.startswith(("home_", "away_")) else c
        if stem.endswith("_shrunk"):
            row = ("A+B", stem[:-7], f"mean of last {rows} rows blended with earlier-season means, k={k:g}",
                   "team, season", "current row outside its own frame; priors are earlier seasons")
        elif stem.endswith("_ewm"):
            row = ("C", stem[:-4], f"exponential mean, half-life {halflife:g} rows", "team",
                   "current row outside its own frame")
        elif stem == "games_played_sd":
            row = ("A", None, f"count of last {rows} rows", "team, season", "current row excluded")
        elif c in MATCHUPS:
            row = ("A+B difference", None, " - ".join(MATCHUPS[c]), None, "inherits both inputs")
        elif c in CONTEXT:
            row = ("context", None, "schedule fact or fixed geography", None, "known before the start")
        else:
            row = ("D", None, "rating fold, snapshot before the event", "pool", "own result folded afterwards")
        out.append((c, *row))
    return spark.createDataFrame(out, "feature string, pattern string, source string, call string, "
                                      "by string, note string")
