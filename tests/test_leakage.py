"""Properties: nothing may see its own outcome, and the audits must notice when it does."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from foretime.operators import audit, features, live, models

SMALL = ("a", "b")


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = []
    for g in range(240):
        season, week = 2000 + g // 60, g % 60 // 5
        h, a = rng.sample(range(8), 2)
        when = dt.datetime(season, 9, 1) + dt.timedelta(days=7 * week, hours=g % 5)
        for team, home in ((h, True), (a, False)):
            rows.append((f"g{g:03d}", f"t{team}", season, week, when, home, f"t{a if home else h}",
                         None if rng.random() < 0.1 else rng.gauss(0, 1), rng.gauss(0, 1)))
    return spark.createDataFrame(rows, "game_id string, team string, season int, week int, kickoff timestamp, "
                                       "is_home boolean, opponent string, a double, b double").cache()


def build(log, **k):
    return features.rolled(log, metrics=SMALL, **k)


COLS = ["games_played_sd", *[f"{m}_{s}" for m in SMALL for s in ("sd", "ewm", "shrunk")]]


def changed(x, y, cols=COLS):
    d = audit.table_diff(x.select("game_id", "team", *cols), y.select("game_id", "team", *cols), ["game_id", "team"], rtol=1e-9, atol=1e-12)
    return {r["column"]: r["mismatches"] for r in d.collect()}


def test_future_does_not_reach_back(log):
    """Changing every value from a season on moves nothing before it."""
    cut = log.withColumn("a", F.when(F.col("season") >= 2002, F.col("a") + 50).otherwise(F.col("a")))
    a, b = build(log), build(cut)
    assert set(changed(a.where("season < 2002"), b.where("season < 2002")).values()) == {0}
    assert changed(a.where("season > 2002"), b.where("season > 2002"))["a_ewm"] > 0


def test_own_row_is_never_read(log):
    """A row's own value may be anything."""
    last = log.groupBy("team").agg(F.max(F.struct("kickoff", "game_id"))["game_id"].alias("last"))
    rows = log.join(last, "team")
    fake = lambda v: build(rows.withColumn("a", F.when(F.col("game_id") == F.col("last"), F.lit(v)).otherwise(F.col("a"))).drop("last"))
    x, y = (fake(v).join(last.withColumnRenamed("last", "game_id"), ["team", "game_id"], "left_semi") for v in (-99.0, 99.0))
    assert set(changed(x, y).values()) == {0}


def test_last_row_seed_looks_ahead_and_running_seed_does_not(log):
    first = log.agg(F.min("season")).first()[0]
    poke = log.withColumn("a", F.when((F.col("season") == first) & (F.col("week") == 10), F.col("a") + 50).otherwise(F.col("a")))
    for seed, leaks in (("last_row", True), ("running", False)):
        a, b = (build(x, seed=seed).where(f"season = {first} AND week < 10") for x in (log, poke))
        assert (changed(a, b)["a_shrunk"] > 0) is leaks, seed


@pytest.mark.parametrize("leaky,caught", [((), []), (("a",), ["a_sd"]), (("a", "b"), ["a_sd", "b_sd"])])
def test_window_oracle_catches_leaks(log, leaky, caught):
    oracle = audit.window_oracle(log, ["team", "season"], ["kickoff", "game_id"], SMALL, 22)
    d = audit.mismatches(build(log, leaky=leaky), oracle, ["game_id", "team"], {f"{m}_sd": f"{m}_oracle" for m in SMALL})
    assert sorted(r.feature for r in d.collect() if r.mismatches) == caught


@pytest.mark.parametrize("current", [False, True])
def test_ewm_induction_catches_leaks(log, current):
    from foretime.operators.prior import prior_ewm
    by, order = ["team"], ["kickoff", "game_id"]
    d = prior_ewm(log, by, order, {"m": "a"}, 5.0, include_current=current, with_weight=True)
    assert (audit.ewm_induction(d, by, order, "a", "m", "m_w", 5.0).count() > 0) is current


def test_open_events_equal_the_next_row(spark, log):
    """Masking a week and everything later, then asking for it as open, gives history back."""
    season, week = 2002, 6
    truth = build(log)
    masked = live.before_week(log, season, week)
    this = log.where(f"season = {season} AND week = {week}")
    nxt = this.where("is_home").select("game_id", "season", "week", "kickoff", F.col("team").alias("home_team"), F.col("opponent").alias("away_team"))
    got = live.as_if_next(masked, nxt, SMALL)
    firsts = this.groupBy("team").agg(F.min(F.struct("kickoff", "game_id"))["game_id"].alias("game_id"))
    a, b = (d.join(firsts, ["team", "game_id"], "left_semi") for d in (truth, got))
    assert a.count() == b.count() > 4 and set(changed(a, b).values()) == {0}


def test_guards():
    assert features.leaky_columns(["home_cpoe", "home_cpoe_shrunk", "spread_line", "elo_diff"]) == ["home_cpoe", "spread_line"]
    assert len(features.feature_columns()) == 67


def test_folds_never_look_ahead(spark):
    rng = random.Random(2)
    rows = [(f"g{i}", 2000 + i // 100, rng.gauss(0, 1), None if i % 9 == 0 else rng.gauss(0, 1)) for i in range(500)]
    d = spark.createDataFrame([(g, s, x, z, int(x + rng.gauss(0, 1) > 0)) for g, s, x, z in rows], "game_id string, season int, x double, z double, y int").cache()
    seen = []

    def spy(train, fs, label):
        seen.append(train.agg(F.max("season")).first()[0])
        return models.logistic(1.0)(train, fs, label)

    folds = models.season_folds(d, 3)
    p = models.walk_forward(d, ["x", "z"], "y", folds, spy)
    assert folds == [2002, 2003, 2004] and seen == [2001, 2002, 2003] and p.count() == 300
    with pytest.raises(ValueError, match="forbidden"):
        models.season_folds(d, 3, forbidden=[2004])
    from foretime.operators.metrics import model_metrics
    r = model_metrics(p).first()
    assert r.acc > 0.65 and 0.6 < r.auc < 0.95
    shuffled = models.permuted(d, ["y"], "game_id", 1)
    assert shuffled.count() == 500 and shuffled.agg(F.sum("y")).first()[0] == d.agg(F.sum("y")).first()[0]
    assert audit.table_diff(d, shuffled, ["game_id"]).where("column = 'y'").first().mismatches > 100


def test_frozen_model_is_refused_twice(spark, tmp_path):
    d = spark.createDataFrame([(float(i), i % 2) for i in range(40)], "x double, y int")
    model = models.logistic(1.0)(d, ["x"], "y")
    meta = spark.createDataFrame([("abc", 40)], "data_digest string, n int")
    path = str(tmp_path / "m")
    models.freeze(model, path, meta)
    with pytest.raises(Exception):
        models.freeze(model, path, meta)
    again = models.thaw(spark, path, "abc")
    a, b = (models.score(x, d, ["x"]).orderBy("x").collect() for x in (model, again))
    assert a == b
    with pytest.raises(ValueError, match="trained on"):
        models.thaw(spark, path, "other")
