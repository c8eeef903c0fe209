"""Findings of the third round: each test failed before its change."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretime import session
from foretime.functions import clock
from foretime.operators import audit, checks, features, linear, models
from foretime.plans import q_audit
from foretime.plans.proxies import Tables
from foretime.session import written

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_one_to_one_join_sends_no_side_to_the_driver(spark):
    a = spark.range(100).withColumnRenamed("id", "k")
    d = checks.join_one_to_one(a.withColumn("x", F.lit(1)), a.withColumn("y", F.lit(2)), ["k"])
    assert "Broadcast" not in plan(d) and d.count() == 100


def test_a_wall_time_that_occurs_twice_counts_as_the_occurrence_asked_for(spark):
    zone = F.lit("America/New_York")
    times = {"2024-11-03 00:30:00": -4.0, "2024-11-03 01:30:00": -5.0, "2024-11-03 02:30:00": -5.0, "2024-11-02 12:00:00": -4.0,
             "2024-03-09 12:00:00": -5.0, "2024-03-10 01:30:00": -5.0, "2024-03-10 02:30:00": -5.0, "2024-03-10 03:30:00": -4.0}
    for at, hours in times.items():
        assert spark.range(1).select(clock.utc_offset_hours(F.lit(at).cast("timestamp"), zone, "last")).first()[0] == hours, at
    half = spark.range(1).select(clock.utc_offset_hours(F.lit("2024-04-07 01:45:00").cast("timestamp"), F.lit("Australia/Lord_Howe"), "last"))
    assert half.first()[0] == 10.5
    assert spark.range(1).select(clock.utc_offset_hours(F.lit("2024-11-03 01:30:00").cast("timestamp"), zone)).first()[0] == -4.0


def test_last_bits_of_a_sum_are_no_mismatch_between_builds(spark, monkeypatch):
    built = []

    def noisy(t, placeholder, masked):
        built.append(1)
        cols = [(F.lit(0.1 + 0.2 if len(built) % 2 else 0.3)).alias(c) for c in q_audit.features.feature_columns()]
        return t.spark.range(5).select(F.col("id").alias("game_id"), *cols)

    monkeypatch.setattr(q_audit, "open_frame", noisy)
    assert q_audit.open_frame_invariance(Tables.of(spark, SF)).where("mismatches > 0").count() == 0


def test_large_sums_of_doubles_add_up_and_counts_must_exactly(spark):
    tiers = [(f"t{i}", 10_000_000 + i, 1_234_567.1 * (i + 1)) for i in range(7)]
    rows = [("all", sum(n for _, n, _ in tiers) + 1, sum(x for *_, x in reversed(tiers)) * (1 + 1e-15)), *tiers]
    report = spark.createDataFrame(rows, "tier string, n long, x double")
    assert [r.metric for r in audit.parts_add_up(report, "tier", "all", ["n", "x"]).collect()] == ["n"]


def rows_of_three(spark, n=1000):
    rng = np.random.default_rng(3)
    x = np.column_stack((rng.normal(size=n), rng.integers(0, 4, n), np.full(n, 5.0)))
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
    rows = [(i, None if i % 11 == 0 else float(a), float(b), float(c), 2000 + i % 4, int(t)) for i, ((a, b, c), t) in enumerate(zip(x, y, strict=True))]
    return rows, written(spark.createDataFrame(rows, "game_id long, a double, b double, c double, season int, y int").repartition(3))


def test_medians_are_exact_and_group_only_the_middle(spark, monkeypatch):
    rows, d = rows_of_three(spark, 20_001)
    d = d.withColumn("none", F.lit(None).cast("double"))
    want = {c: np.median([r[i] for r in rows if r[i] is not None]) for i, c in enumerate("abc", 1)}
    seen = []
    monkeypatch.setattr(models, "written", lambda x: seen.append(written(x)) or seen[-1])
    assert models.medians(d, ["a", "b", "c", "none"]) == want
    assert seen[0].count() < 400 and models.medians(d.where("false"), ["a"]) == {}
    # a bracket that misses takes the whole column
    monkeypatch.setattr(models.F, "percentile_approx", lambda c, *_: F.array(F.min(c), F.min(c)))
    assert models.medians(d, ["a", "b", "c"]) == want


def test_folds_scan_the_stored_table_and_write_no_copy(spark, monkeypatch):
    _, d = rows_of_three(spark)
    monkeypatch.setattr(linear, "written", None)
    fits = linear.fold_models(d, ["a", "b", "c"], "y", [2002, 2003], {"C=1": 1.0, "C=9": 9.0})
    got = linear.scored(d.where("season < 2003"), fits[2003], ["C=1", "C=9"], "y").groupBy("model").agg(F.avg("p").alias("p"), F.avg("y").alias("y")).collect()
    assert len(got) == 2 and all(abs(r.p - r.y) < 1e-9 for r in got)


def test_permutations_meet_in_short_runs(spark):
    rows, d = rows_of_three(spark)
    z = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in "abc"])
    w = np.array([1.0, 0.23, -0.117, 0.31])
    full = {r.feature: (r.coef, r.std) for r in linear.permutation_importance(d, z, "abc", "y", lambda x: x @ w[:-1] + w[-1], 7).collect()}
    for size in (64, 333, 1000, 4096):
        got = {r.feature: (r.coef, r.std) for r in linear.permutation_importance(d, z, "abc", "y", w, 7, size=size).collect()}
        assert got == {f: (pytest.approx(a), pytest.approx(b)) for f, (a, b) in full.items()}
        ys = {r.game_id: list(r.y) for r in linear.shuffled_labels(d, "game_id", "y", 7, ["game_id"], size=size).collect()}
        place = {r._pos: r.game_id for r in linear.numbered_by_hash(d.select("game_id"), "game_id")[0].collect()}
        n = len(rows)
        assert all(ys[place[p]] == [rows[place[p]][5]] + [rows[place[(p + 1 + r * linear.STRIDE % (n - 1)) % n]][5] for r in range(1, 8)] for p in range(n))


def test_a_row_is_sent_to_its_run_and_the_few_before_not_once_a_repeat(spark):
    n = 2_000_000
    rows = spark.range(n).withColumnRenamed("id", "_pos")
    assert linear.with_partners(rows, n, 20, linear.RUN_ROWS).count() < 2 * n


def test_rolled_rows_move_once_behind_the_windows(spark):
    """One wide shuffle by entity: windows and earlier periods read it, no join moves their results again."""
    n = 60
    log = written(spark.range(n).select(F.col("id").alias("game_id"), (F.col("id") % 3).cast("string").alias("team"), (F.col("id") / 20).cast("int").alias("season"),
                                        F.timestamp_seconds(F.col("id") * 1000).alias("kickoff"), (F.col("id") % 7).cast("double").alias("m")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = features.rolled(log, metrics=["m"])
        p = d._jdf.queryExecution().executedPlan().toString()
        rows = {r.game_id: r for r in d.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(re.findall(r"Exchange hashpartitioning\(team#\d+, season", p)) == 1  # means per period; the rows stay
    assert len(rows) == n
    for g, r in rows.items():
        own = [i % 7 for i in range(g % 3, g, 3) if i // 20 == g // 20]
        prior = [i % 7 for i in range(g % 3, n, 3) if i // 20 == g // 20 - 1]
        league = [i % 7 for i in range(g)] if g < 20 else [1]
        prior = np.mean(prior) if prior else np.mean(league) if league else None
        total, weight = sum(own[-22:]) + (4 * prior if prior is not None else 0), len(own[-22:]) + (4 if prior is not None else 0)
        assert r.m_shrunk == (pytest.approx(total / weight) if weight else None)


def test_shuffle_partitions_follow_the_stored_size_of_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "PARTITION_BYTES", 1 << 10)
    small, large = tmp_path / "a", tmp_path / "b"
    rows = spark.range(4000).selectExpr("uuid() AS x")
    rows.write.parquet(f"{small}/lineitem.parquet")
    rows.union(rows).union(rows).union(rows).write.parquet(f"{large}/lineitem.parquet")
    dealt = []
    for folder in (small, large):
        Tables.of(spark, str(folder)).raw("lineitem")
        dealt.append(session.partitions(spark))
    assert dealt[0] > int(spark.conf.get("spark.sql.shuffle.partitions")) and dealt[1] > 3 * dealt[0]
    Tables.of(spark, str(small))
    assert session.partitions(spark) == dealt[0]


def test_a_first_line_carries_only_what_is_read(spark):
    assert set(Tables.of(spark, SF).first_lines().columns) == {"l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"}


def test_all_folds_take_their_steps_together(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, int(1995 + i % 4), None if i % 13 == 0 else float(x), float(z), int(x + z + rng.normal() > 0) if i % 17 else None)
            for i, (x, z) in enumerate(rng.normal(size=(800, 2)))]
    d = written(spark.createDataFrame(rows, "game_id long, season int, a double, b double, y int"))
    alone = {}
    for s in (1996, 1997, 1998):
        known = d.where((F.col("season") < s) & F.col("y").isNotNull())
        scaling = linear.Scaling.of(known, ["a", "b"])
        y = F.array(*[F.col("y").cast("double")] * 2)
        alone[s] = linear.fit_logistic(known.select(scaling.array().alias("z"), y.alias("y")), 2, 2, [0.1, 10.0], is_stored=True)
    passes, kind = [], type(d)
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: (passes.append(1), own(self, *a, **k))[1])
    fits = linear.fold_models(d, ["a", "b"], "y", [1996, 1997, 1998], {"C=0.1": 0.1, "C=10": 10.0})
    assert len(passes) <= 12
    for s, (_, beta) in fits.items():
        assert np.allclose(beta, alone[s], atol=1e-8), s


def test_a_fit_that_leaves_features_out_takes_the_passes_of_the_others(spark, monkeypatch):
    _, d = rows_of_three(spark)
    passes, newton = [], linear.newton
    monkeypatch.setattr(linear, "newton", lambda *a, **k: passes.append(1) or newton(*a, **k))
    fits = linear.fold_models(d, ["a", "b", "c"], "y", [2002, 2003], {"with": 1.0, "without": 1.0}, {"without": ["a"]})
    assert len(passes) == 1
    for season, (_, beta) in fits.items():
        own = linear.fold_models(d, ["b", "c"], "y", [season], {"without": 1.0})[season][1]
        assert beta[1, 0] == 0 and beta[1, 1:] == pytest.approx(own[0], abs=1e-7)
        assert beta[0, 0] > 0.5


@pytest.mark.parametrize(("name", "medians_of"), [("rotating_holdout", 2), ("forest_and_boosting", 1), ("ablation_report", 1),
                                                  ("coefficient_report", 1), ("feature_pruning", 1)])
def test_model_reports_fit_together_and_find_medians_once(spark, monkeypatch, name, medians_of):
    rows = np.random.default_rng(5).normal(size=(1200, 5))
    label = rows @ [1, -1, 0.2, 0.5, 2] + np.random.default_rng(6).normal(size=1200) > 0
    table = [(i, 1998 + i % 3, int(label[i]), *[None if (i + j) % 13 == 0 else float(x) for j, x in enumerate(r)]) for i, r in enumerate(rows)]
    d = written(spark.createDataFrame(table, "game_id int, season int, home_win int, " + ", ".join(f"{c} double" for c in q_audit.FEATURES)))
    monkeypatch.setattr(q_audit, "small_frame", lambda t: d)
    plain = models.logistic(1.0)
    train, test = d.where("season < 2000"), d.where("season = 2000")
    want = {
        "rotating_holdout": lambda: models.with_and_without(d, q_audit.FEATURES, ["elo_gap"], "home_win", [1999, 2000], plain),
        "ablation_report": lambda: models.ablation(d, "season < 2000", "season = 2000", q_audit.FEATURES, "elo_gap", "home_win", plain),
        "coefficient_report": lambda: models.coefficients(spark, plain(train, q_audit.FEATURES, "home_win"), q_audit.FEATURES),
        "forest_and_boosting": lambda: models.model_metrics(models.walk_forward(d, q_audit.FEATURES, "home_win", [2000], models.boosting(5, 3), "boosting")),
        "feature_pruning": lambda: models.average_rank([models.coefficients(spark, k(train, q_audit.FEATURES, "home_win"), q_audit.FEATURES)
                                                        for k in (plain, models.forest(10, 4))])}[name]().toPandas()
    seen, found = [], models.medians
    for place in (models, linear):
        monkeypatch.setattr(place, "medians", lambda *a: seen.append(1) or found(*a))
    monkeypatch.setattr(models, "LogisticRegression", None)
    got = getattr(q_audit, name)(Tables.of(spark, SF)).toPandas()
    assert len(seen) == medians_of and test.count() == 400
    key = next(c for c in want.columns if c in ("season", "model", "feature", "dropped"))
    got, want = (x.set_index(key).sort_index() for x in (got, want))
    for c in want.columns.intersection(got.columns):
        assert got.loc[want.index, c].to_numpy().astype(float) == pytest.approx(want[c].to_numpy().astype(float), abs=1e-5), c
