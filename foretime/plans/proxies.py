"""Logical inputs (schedule, plays, quotes, predictions) drawn from the given tables.

Everything is a declarative function of ``orders``, ``lineitem`` and ``events``,
so scans prune columns and the work grows with those tables. ``sql_views`` states
the same definitions in SQL for the oracle side.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretime.session import deal_by_size, pin, written
from foretime.sources.tables import read_table, stored_bytes

#: Season in which events after LAST_PLAYED_WEEK are still open.
LIVE_SEASON = 2001
LAST_PLAYED_WEEK = 6

METRICS = ("qb_epa_per_db", "qb_success_rate", "cpoe", "sack_rate", "int_rate",
           "air_yards_per_att", "def_epa_per_play", "def_success_allowed",
           "def_pressure_rate", "def_epa_early", "def_epa_money")


def hours(n: Column) -> Column:
    return F.make_dt_interval(hours=n.cast("int"))


def days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


def whole(c: str) -> Column:
    return F.floor(c).cast("int")


def planned(fn):
    """Keep the plan a derived table builds, so each session states it once (no data is kept)."""

    @wraps(fn)
    def get(t: "Tables", *args) -> DataFrame:
        key = (fn.__module__, fn.__qualname__, args)
        if key not in t.plans:
            t.plans[key] = fn(t, *args)
        return t.plans[key]

    return get


class Tables:
    """The given tables plus the logical ones derived from them."""

    _open: dict[tuple[str, str], "Tables"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = pin(spark)
        self.dir = sf_dir
        self.plans: dict = {}
        self.bytes = 0

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._open:
            cls._open[key] = cls(spark, sf_dir)
        pin(spark)
        deal_by_size(spark, cls._open[key].bytes)
        return cls._open[key]

    @planned
    def raw(self, name: str) -> DataFrame:
        path = f"{self.dir}/{name}.parquet"
        self.bytes += stored_bytes(self.spark, path)
        deal_by_size(self.spark, self.bytes)
        return read_table(self.spark, path, name)

    @planned
    def events(self) -> DataFrame:
        """Entity log: one metric with gaps, a day and a week period."""
        return self.raw("events").select(
            "event_id", "user_id", "ts", "event_type",
            F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("metric"), "value",
            F.date_trunc("week", "ts").alias("week_start"))

    @planned
    def first_lines(self) -> DataFrame:
        """One line per order: the smallest tuple, an aggregate and not a window. What would only
        break ties after these columns is not carried: no one reads it."""
        cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
        return (self.raw("lineitem").groupBy("l_orderkey")
                .agg(F.min(F.struct(*cols)).alias("f")).select("l_orderkey", "f.*"))

    @planned
    def schedule(self) -> DataFrame:
        """Every event: two teams, start time, scores unless still open, prices."""
        g = self.first_lines().join(
            self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        doy, part, supp = F.dayofyear("o_orderdate"), F.col("l_partkey"), F.col("l_suppkey")
        key = F.col("o_orderkey")
        week = (F.floor((doy - 1) / 20) + 1).cast("int")
        season = F.year("o_orderdate")
        opened = (season == LIVE_SEASON) & (week > LAST_PLAYED_WEEK)
        steep = (F.lit(105) + part % 300).cast("double")
        mild = (F.lit(101) + part % 280).cast("double")
        home_ml = F.when(part % 23 != 0, F.when(supp % 2 == 0, -steep).otherwise(mild))
        away_ml = F.when(part % 23 != 0, F.when(supp % 2 == 0, mild).otherwise(-steep))
        g = g.select(
            key.alias("game_id"), season.alias("season"), week.alias("week"),
            F.when(key % 20 == 0, "POST").otherwise("REG").alias("game_type"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("gameday"),
            F.when(key % 50 != 7, F.concat(
                F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":"),
                F.lpad((key * 7 % 60).cast("string"), 2, "0"))).alias("gametime"),
            (F.col("o_orderdate") + hours(key % 24)).alias("kickoff"),
            F.concat(F.lit("T"), F.expr("o_custkey div 10")).alias("home_team"),
            F.concat(F.lit("T"), F.expr("(l_suppkey * 15 + l_partkey % 15) div 10")).alias("away_team"),
            F.when(~opened, whole("l_quantity") % 40).cast("double").alias("home_score"),
            F.when(~opened, whole("l_extendedprice") % 40).cast("double").alias("away_score"),
            (F.lit(2) + F.col("o_custkey") % 22).cast("double").alias("home_rest"),
            (F.lit(2) + supp % 22).cast("double").alias("away_rest"),
            F.when(F.col("o_custkey") % 5 == supp % 5, 1).otherwise(0).alias("div_game"),
            F.element_at(F.array(*[F.lit(x) for x in ("dome", "closed", "outdoors", "open", "tent")]),
                         (part % 5 + 1).cast("int")).alias("roof"),
            F.when(supp % 30 == 3, "Neutral").otherwise("Home").alias("location"),
            F.concat(F.lit("V"), (F.expr("o_custkey div 10") * 2 + F.when(F.col("o_custkey") % 7 == 0, 1).otherwise(0)) % 40)
            .alias("stadium_id"),
            ((part % 21 - 10) * 0.5).alias("spread_line"),
            home_ml.alias("home_moneyline"), away_ml.alias("away_moneyline"),
            supp.alias("pool"),
            F.concat(F.lit("N"), F.col("o_custkey") % 20).alias("pool_home"),
            F.concat(F.lit("N"), part % 20).alias("pool_away"))
        # the logical schedule is a stored table to every query that uses it
        return written(g.where("home_team <> away_team"))

    @planned
    def plays(self) -> DataFrame:
        """One row per line: which side acts, indicator columns, graded values."""
        s = self.schedule().select("game_id", "season", "week", "home_team", "away_team")
        li = self.raw("lineitem")
        odd = F.col("l_linenumber") % 2 == 1
        part, supp = F.col("l_partkey"), F.col("l_suppkey")
        flag = lambda c: F.when(c, 1.0).otherwise(0.0)
        epa = F.when(part % 17 != 0, (F.col("l_quantity") - 25.0) / 10)
        return li.join(s, F.col("l_orderkey") == F.col("game_id")).select(
            "game_id", "season", "week",
            F.when(odd, F.col("home_team")).otherwise(F.col("away_team")).alias("posteam"),
            F.when(odd, F.col("away_team")).otherwise(F.col("home_team")).alias("defteam"),
            flag(part % 5 < 3).alias("pass"), flag(part % 5 == 3).alias("rush"),
            flag(part % 5 < 3).alias("qb_dropback"),
            flag((part % 5 < 3) & (supp % 7 == 0)).alias("sack"),
            flag((part % 5 < 3) & (supp % 11 == 1)).alias("qb_scramble"),
            flag(part % 13 == 0).alias("interception"),
            F.when(part % 29 != 0, flag(supp % 9 == 0)).alias("qb_hit"),
            epa.alias("epa"), (epa + F.col("l_discount")).alias("qb_epa"),
            F.when(epa.isNotNull(), flag(epa > 0)).alias("success"),
            F.when(F.col("season") >= 1996, (F.col("l_tax") - 0.04) * 100).alias("cpoe"),
            (whole("l_quantity") % 20).cast("double").alias("air_yards"),
            F.when(F.col("l_linenumber") != 7, F.col("l_linenumber") % 4 + 1).cast("double").alias("down"))

    @planned
    def quotes(self) -> DataFrame:
        """Price snapshots: one row per (pull time, event), pulled daily at noon."""
        s = self.schedule().select("game_id", "gameday")
        part, line = F.col("l_partkey"), F.col("l_linenumber")
        q = self.raw("lineitem").join(s, F.col("l_orderkey") == F.col("game_id")).select(
            "game_id",
            (F.to_timestamp("gameday", "yyyy-MM-dd") + hours(F.lit(12)) - days(line - 2)).alias("pulled_at"),
            F.struct(
                F.when(part % 19 != 0, -(F.lit(105) + part % 250).cast("double")).alias("home_moneyline"),
                (F.lit(101) + part % 230).cast("double").alias("away_moneyline")).alias("q"))
        return q.groupBy("game_id", "pulled_at").agg(F.min("q").alias("q")).select(
            "game_id", "pulled_at", "q.*")

    @planned
    def predictions(self) -> DataFrame:
        """Two models per event, logged against the prices of one snapshot."""
        key = F.col("game_id")
        p = F.lit(0.2) + (key * 7919 % 1000) * 0.0006
        s = self.schedule().where("game_type = 'REG'")
        return s.select(
            "season", "week", "game_id", "kickoff", "home_team", "away_team", "spread_line",
            "home_moneyline", "away_moneyline",
            (F.to_timestamp("gameday", "yyyy-MM-dd") + hours(F.lit(10)) - days(key % 4)).alias("predicted_from"),
            F.explode(F.array(
                F.struct(F.lit("champion").alias("model"), p.alias("p_home"),
                         F.lit("official").alias("bet_status")),
                F.struct(F.lit("challenger").alias("model"),
                         (F.lit(0.47) + (p - 0.5) * 0.8 + (key * 31 % 7) * 0.01).alias("p_home"),
                         F.lit("hypothetical").alias("bet_status")))).alias("m")).select("*", "m.*").drop("m")
