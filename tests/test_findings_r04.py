"""Findings of the fourth round: each test failed before its change."""

import datetime as dt
import re

import numpy as np
import pytest

from foretime import session
from foretime.operators import features, linear, models
from foretime.operators.team_log import METRICS
from foretime.plans import q_audit, q_model
from foretime.plans.catalog import QUERIES
from foretime.plans.proxies import Tables
from foretime.session import written

SF = "/root/testdata/sf0.001"
COLUMNS = q_model.COLUMNS


@pytest.fixture(scope="module")
def whole(spark):
    """A model frame of all columns with four seasons; the label follows two of the columns."""
    x = np.random.default_rng(7).normal(size=(1200, len(COLUMNS)))
    score = 2 * x[:, COLUMNS.index("mu_success_edge_a")] - x[:, COLUMNS.index("travel_diff")]
    label = score + np.random.default_rng(8).normal(size=1200) > 0
    rows = [(i, 1997 + i % 4, int(label[i]), *[None if (i + j) % 17 == 0 else float(v) for j, v in enumerate(r)]) for i, r in enumerate(x)]
    return written(spark.createDataFrame(rows, "game_id int, season int, home_win int, " + ", ".join(f"{c} double" for c in COLUMNS)))


def test_ablation_drops_the_heaviest_of_all_columns(spark, monkeypatch, whole):
    monkeypatch.setattr(q_model, "frame_of", lambda t: whole)
    got = QUERIES["ablation_report"](spark, SF).collect()
    want = models.ablation(whole, "season < 2000", "season = 2000", COLUMNS, "mu_success_edge_a", "home_win", models.logistic(1.0)).collect()
    assert [r.dropped for r in got] == ["mu_success_edge_a"]
    assert got[0].full == pytest.approx(want[0].full) and got[0].ablated == pytest.approx(want[0].ablated) and got[0].baseline == want[0].baseline


def test_pruning_ranks_all_columns_by_a_forest_of_full_size(spark, monkeypatch, whole):
    monkeypatch.setattr(q_model, "frame_of", lambda t: whole)
    grown, kind = [], models.RandomForestClassifier
    monkeypatch.setattr(models, "RandomForestClassifier", lambda **k: grown.append((k["numTrees"], k["maxDepth"], k["minInstancesPerNode"])) or kind(**{**k, "numTrees": 5, "maxDepth": 2}))
    got = {r.feature: r for r in QUERIES["feature_pruning"](spark, SF).collect()}
    assert grown == [(300, 8, 5)] and set(got) == set(COLUMNS)
    assert got["mu_success_edge_a"].avg_rank <= 2 and not got["mu_success_edge_a"].dropped


def test_tree_models_take_every_fold_all_columns_and_their_full_size(spark, monkeypatch, whole):
    monkeypatch.setattr(q_model, "frame_of", lambda t: whole)
    sizes, seen = [], {"RandomForestClassifier": {"numTrees": 5, "maxDepth": 2}, "GBTClassifier": {"maxIter": 2, "maxDepth": 2}}
    for name, small in seen.items():
        kind = getattr(models, name)
        monkeypatch.setattr(models, name, lambda kind=kind, small=small, **k: sizes.append(tuple(k[x] for x in small)) or kind(**{**k, **small}))
    got = {r.model: r for r in QUERIES["forest_and_boosting"](spark, SF).collect()}
    assert sorted(sizes) == [(100, 4)] * 3 + [(300, 8)] * 3
    assert {m: r.n for m, r in got.items()} == dict.fromkeys(("forest", "boosting", "logistic", "home_baseline"), 900)
    folds = models.walk_forward(whole, COLUMNS, "home_win", [1998, 1999, 2000], models.logistic(1.0))
    assert got["logistic"].acc == pytest.approx(models.model_metrics(folds).first().acc)


def team_rows(spark, games=240, teams=8):
    """A log of two rows a game and what else the frame is made of."""
    rng = np.random.default_rng(9)
    log, played, facts, rated = [], [], [], []
    for i in range(games):
        season, at = 1998 + i // 80, dt.datetime(1998 + i // 80, 1, 1) + dt.timedelta(hours=12 * (i % 80))
        home, away = (f"T{x}" for x in rng.permutation(teams)[:2])
        log += [(i, a, season, at, a == home, b, *[None if rng.random() < 0.1 else float(v) for v in rng.normal(size=len(METRICS))]) for a, b in ((home, away), (away, home))]
        played.append((i, season, i % 20, at, int(rng.random() < 0.5)))
        facts.append((i, *[float(v) for v in rng.normal(size=len(features.CONTEXT))]))
        rated.append((i, *[1500 + float(v) for v in rng.normal(size=2)]))
    return (spark.createDataFrame(log, "game_id long, team string, season int, kickoff timestamp, is_home boolean, opponent string, " + ", ".join(f"{m} double" for m in METRICS)),
            spark.createDataFrame(played, "game_id long, season int, week int, kickoff timestamp, home_win int"),
            spark.createDataFrame(facts, "game_id long, " + ", ".join(f"{c} double" for c in features.CONTEXT)).withColumns(
                {n: q_audit.F.col(a) - q_audit.F.col(b) for n, (a, b) in features.DIFFERENCES.items() if n in features.CONTEXT}),
            spark.createDataFrame(rated, "game_id long, home_pre double, away_pre double"))


def test_a_frame_written_in_slices_holds_the_same_rows(spark, monkeypatch):
    log, *rest = team_rows(spark)
    t = Tables(spark, "/none")
    t.bytes = 5
    monkeypatch.setattr(q_audit, "SLICE_BYTES", 2)
    monkeypatch.setattr(q_audit, "frame_parts", lambda t: (features.rolled(log), *rest))
    stored = []
    monkeypatch.setattr(q_audit, "written", lambda *d: stored.append(len(d)) or session.written(*d))
    got = q_audit.frame_of(t).orderBy("game_id").collect()
    want = features.assemble(features.rolled(log), *rest).orderBy("game_id").collect()
    session.pin(spark)
    assert max(stored) == 3 and len(got) == len(want) == 240
    for c in ("season", "week", "home_win", *COLUMNS):
        assert [r[c] for r in got] == [r[c] for r in want], c


def test_seeds_do_not_move_the_log_once_more(spark):
    log = written(team_rows(spark)[0])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = sorted(map(str, features.rolled(log).collect()))
        session.keep_dealt(spark)
        d = features.rolled(log)
        plan, got = d._jdf.queryExecution().executedPlan().toString(), sorted(map(str, d.collect()))
    finally:
        session.pin(spark).conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == want
    assert not re.search(r"hashpartitioning\(team#\d+, game_id#", plan)


def test_what_a_finished_step_shuffled_is_gone(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    session.keep_dealt(spark)
    try:
        here = files()
        written(spark.range(1000).groupBy((q_audit.F.col("id") % 7).alias("k")).count())
        assert files() <= here
    finally:
        session.pin(spark)


def test_labels_dealt_in_slices_fit_alike_and_rows_are_stored_unscaled(spark, monkeypatch, whole):
    names, stored = COLUMNS[:3], []
    monkeypatch.setattr(linear, "written", lambda *d: stored.append(d[0].columns) or session.written(*d))
    one, three = (linear.label_shuffle_test(whole, "season < 2000", "season = 2000", names, "home_win", repeats=3, slices=k).orderBy("repeat").collect() for k in (1, 3))
    assert one == three and len(one) == 4
    assert [*names, "y"] in stored and ["z", "y"] not in stored


def test_pairs_of_open_frames_are_compared_one_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(q_audit, "open_frame", lambda t, p, masked: t.spark.range(5).select(q_audit.F.col("id").alias("game_id"), *[q_audit.F.lit(1.0).alias(c) for c in COLUMNS]))
    stored = []
    monkeypatch.setattr(q_audit, "written", lambda *d: stored.append(d[0].count()) or session.written(*d))
    d = q_audit.open_frame_invariance(Tables.of(spark, SF))
    session.pin(spark)
    assert stored == [len(COLUMNS)] * 2 and d.count() == 2 * len(COLUMNS)
