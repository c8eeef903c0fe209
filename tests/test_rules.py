"""Hand values at exact boundaries: prices, bets, clocks, statistics."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from foretime.functions import clock, market as m, stats
from foretime.functions.scalar import clip, rate, shrink
from foretime.operators import live, scorecard, tables
from foretime.sources.tables import normalise

UTC = dt.timezone.utc


def ts(text):
    return F.lit(text).cast("timestamp")


def evaluate(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_bet_rule(spark):
    rows = [(0.54, -100.0, -100.0), (0.5399, -100.0, -100.0), (0.45, -100.0, -100.0), (0.70, -150.0, 130.0),
            (0.9, None, 120.0), (0.9, -140.0, None)]
    got = evaluate(spark, rows, "p double, h double, a double", m.place_bet("p", "h", "a").alias("b"))
    assert [(b.paper_bet, b.no_bet_reason, b.bet_price, b.stake) for (b,) in got] == [
        ("home", "", -100.0, 1.0), ("none", "edge_below_threshold", None, 0.0), ("away", "", -100.0, 1.0),
        ("home", "", -150.0, 1.0), ("none", "missing_line", None, 0.0), ("none", "missing_line", None, 0.0)]
    assert got[3][0].implied_p_home == pytest.approx(0.6 / (0.6 + 100 / 230))
    assert evaluate(spark, [(0.57 - 0.53,)], "e double", m.qualifies("e"))[0][0]


def test_settlement(spark):
    rows = [("home", 150.0, 24.0, 17.0), ("away", -200.0, 17.0, 24.0), ("home", -200.0, 17.0, 24.0),
            ("away", 110.0, 20.0, 20.0), ("none", None, 20.0, 10.0), ("home", 110.0, None, None)]
    got = evaluate(spark, rows, "s string, o double, h double, a double", m.settle("s", "o", "h", "a").alias("x"))
    assert [tuple(x) for (x,) in got] == [("win", 1.5), ("win", 0.5), ("loss", -1.0), ("void", 0.0), ("none", 0.0), ("pending", None)]


def test_line_value(spark):
    got = evaluate(spark, [("home", .5, .55), ("away", .5, .55), ("away", .5, .45), ("none", .5, .6)], "s string, a double, b double", m.line_value("s", "a", "b"))
    assert [None if x is None else round(x, 9) for (x,) in got] == [.05, -.05, .05, None]
    got = evaluate(spark, [(.6, .5, .55), (.4, .5, .55), (.4, .5, .45), (.5, .5, .55)], "p double, a double, b double", m.move_toward_model("p", "a", "b"))
    assert [round(x, 9) for (x,) in got] == [.05, -.05, .05, 0]


def test_tiers_and_buckets(spark):
    edges = [0.0399, None, 0.04, 0.57 - 0.53, 0.06, 0.36 - 0.30, 0.08, 0.1099, 0.10999999, 0.11, 0.61 - 0.50, 0.15999999, 0.16, 0.86 - 0.70, 0.25]
    got = evaluate(spark, [(e,) for e in edges], "e double", m.edge_bucket("e"), m.tier("e"))
    lean, one, two = "lean", "one_star", "two_star"
    assert [t for _, t in got] == [None, None, lean, lean, lean, lean, lean, lean, lean, one, one, one, two, two, two]
    assert [b for b, _ in got][:7] == [None, None, "[0.04, 0.06)", "[0.04, 0.06)", "[0.06, 0.08)", "[0.06, 0.08)", "[0.08+)"]
    ps = [0.55, 0.45, 0.30 + 0.25, 0.5, 0.5499, 0.5501, 0.4499, 0.9]
    assert [x for (x,) in evaluate(spark, [(p,) for p in ps], "p double", m.toss_up("p"))] == [True] * 5 + [False] * 3


def test_picks_and_losses(spark):
    got = evaluate(spark, [(0.5,), (0.5000001,)], "p double", m.pick("p"))
    assert [x for (x,) in got] == ["away", "home"]
    (ll, br), = evaluate(spark, [(1.0, 0.8)], "y double, p double", m.log_loss("y", "p"), m.brier("y", "p"))
    assert ll == pytest.approx(-math.log(0.8)) and br == pytest.approx(0.04)
    got = evaluate(spark, [(1.0, None, None), (-3.5, None, None), (0.0, -120.0, 100.0), (0.0, 100.0, 100.0), (None, None, None)],
                   "s double, h double, a double", m.favourite("s", "h", "a"))
    assert [x for (x,) in got] == ["home", "away", "home", "unresolved", "unresolved"]


def test_missing_value_rules(spark):
    got = evaluate(spark, [(1.0, 0.0, None), (None, 2.0, 30.0)], "a double, b double, c double", rate("a", "b"), clip("c", 3.0, 20.0))
    assert got == [(None, None), (None, 20.0)]
    d = normalise(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert [r.x for r in d.collect()] == [None, 1.0]
    rows = [(3, 2.0, 1.0, 9.0), (0, None, None, 9.0), (None, None, None, None), (2, 5.0, None, None), (3, None, 1.0, None)]
    got = evaluate(spark, rows, "n int, m double, p double, l double", shrink("n", "m", "p", "l", 4))
    assert [x for (x,) in got] == [pytest.approx(10 / 7), 9.0, None, 5.0, 1.0]


def test_clocks(spark):
    zone = F.lit("America/New_York")
    rows = [("2024-11-03", "13:00"), ("2024-11-03", "01:30"), ("2024-03-10", "02:30"), ("2024-09-08", None), ("bad", "13:00")]
    got = evaluate(spark, rows, "d string, t string", F.date_format(clock.kickoff("d", "t", zone), "dd HH:mm"))
    assert [x for (x,) in got] == ["03 18:00", None, "10 07:00", "08 17:00", None]
    one = spark.range(1)
    assert one.select(clock.utc_offset_hours(ts("2024-11-03 17:00:00"), zone)).first()[0] == -5.0
    for at, text in (("2026-09-27 17:00:00", "Sun 9/27 10:00 AM"), ("2026-09-25 00:15:00", "Thu 9/24 5:15 PM"), ("2026-11-08 18:00:00", "Sun 11/8 10:00 AM")):
        assert one.select(clock.local_start(ts(at), "America/Los_Angeles")).first()[0] == text
    assert one.select(clock.iso_utc(ts("2026-10-30 00:15:00"))).first()[0] == "2026-10-30T00:15:00Z"
    slots = [one.select(clock.broadcast_slot(ts(x))).first()[0] for x in ("2026-10-30 00:15:00", "2026-11-09 01:20:00", "2026-11-09 19:00:00", "2026-11-26 17:30:00")]
    assert slots == ["TNF", "SNF", "MNF", None]


def test_intervals_and_exact_tests(spark):
    got = evaluate(spark, [(53, 89), (10, 21), (0, 0)], "k int, n int", stats.wilson("k", "n").alias("w"))
    assert [round(got[0][0].low, 3), round(got[0][0].high, 3)] == [0.492, 0.691]
    assert [round(got[1][0].low, 3), round(got[1][0].high, 3)] == [0.283, 0.676]
    assert got[2][0].low is None
    cases = [(31, 91, 0.0031), (6, 22, 0.0525), (4, 21, 0.0072), (4, 18, 0.0309), (2, 7, 0.4531), (10, 20, 1.0), (0, 0, 1.0)]
    got = evaluate(spark, [c[:2] for c in cases], "k int, n int", stats.sign_test_two_sided("k", "n"))
    assert [round(x, 4) for (x,) in got] == [c[2] for c in cases]
    got = evaluate(spark, [(3, 3), (0, 5), (5, 8)], "k int, n int", stats.sign_test_at_least("k", "n"))
    assert [x for (x,) in got] == pytest.approx([0.125, 1.0, 93 / 256])
    # published table values of Student's t
    got = evaluate(spark, [(1,), (2,), (5,), (10,), (30,), (1000000,)], "v int", stats.t_quantile_975("v"))
    assert [round(x, 3) for (x,) in got] == [12.706, 4.303, 2.571, 2.228, 2.042, 1.96]
    got = evaluate(spark, [(2.015, 5), (0.0, 9), (-2.015, 5), (1.0, 1)], "t double, v int", stats.t_upper("t", "v"))
    assert [round(x, 4) for (x,) in got] == [0.05, 0.5, 0.95, 0.25]
    got = evaluate(spark, [(0.1, 1.0, 1), (0.1, 0.0, 5)], "m double, s double, n int", stats.one_sided_t("m", "s", "n", "greater"))
    assert got == [(None,), (None,)]


def test_snapshot_trigger(spark):
    start = dt.datetime(2026, 11, 15, 18)

    def fire(now, pulls=(), score=None):
        s = spark.createDataFrame([(start, score)], "kickoff timestamp, home_score double")
        q = spark.createDataFrame([(p,) for p in pulls], "pulled_at timestamp")
        return live.snapshot_due(s, q, F.lit(now).cast("timestamp")).first()["fire"]

    h, mi, s = (lambda n: dt.timedelta(hours=n)), (lambda n: dt.timedelta(minutes=n)), dt.timedelta(seconds=1)
    assert fire(start - h(3)) and fire(start - h(4))
    assert not fire(start - h(4) - s) and not fire(start) and not fire(start - h(1), score=7.0)
    now = start - h(3)
    assert not fire(now, [now - mi(89)]) and fire(now, [now - mi(90)]) and fire(now, [now - h(2), now - h(30)])
    assert not fire(now, [now + mi(5)])


def test_freshness(spark):
    at = lambda n: dt.datetime(2026, 10, 1, 15, 0, n)
    frame = lambda rows: spark.createDataFrame(rows, "pulled_at timestamp, digest string")

    def status(pulls, snaps, now=at(1)):
        return live.freshness(frame(pulls), frame(snaps), F.lit(now).cast("timestamp")).first()["status"]

    pulls = [(at(0), "x"), (at(1), "x")]
    assert status(pulls, [(at(1), "x")]) == "fresh"
    assert status(pulls, [(at(0), "x")]) == "snapshot older than pull"
    assert status(pulls, [(at(1), "y")]) == "content differs"
    assert status(pulls, []) == "no snapshot" and status([], [(at(1), "x")]) == "no pull recorded"
    six = dt.datetime(2026, 10, 1, 21, 0, 1)
    assert status(pulls, [(at(1), "x")], six) == "fresh"
    assert status(pulls, [(at(1), "x")], six + dt.timedelta(seconds=1)) == "snapshot too old"


def _graded(spark, champ, chall, weeks, pending=False):
    import random
    rng = random.Random(0)
    rows = []
    for w in weeks:
        for g in range(15):
            for model, level in (("champion", champ), ("challenger", chall)):
                wait = pending and w == weeks[-1] and g == 0
                rows.append((1, w, f"{w}-{g}", model, "pending" if wait else "home", None if wait else level + rng.gauss(0, 0.01)))
    return spark.createDataFrame(rows, "season int, week int, game_id string, model string, result string, log_loss double")


@pytest.mark.parametrize("champ,chall,want", [(.65, .60, "swap"), (.60, .65, "no swap"), (.65, .65, "no swap"), (.650, .645, "no swap"), (.650, .635, "swap")])
def test_checkpoint(spark, champ, chall, want):
    g = _graded(spark, champ, chall, range(4, 10))
    games = g.select("season", "week", "game_id").distinct()
    sched = games.withColumn("kickoff", ts("2026-10-01 00:00:00"))
    weeks = scorecard.checkpoint_weeks(g, games, sched, ts("2026-12-01 00:00:00"))
    assert scorecard.checkpoint(g, weeks).first()["decision"] == want


def test_checkpoint_not_evaluable(spark):
    g = _graded(spark, .65, .60, range(4, 10), pending=True)
    games = g.select("season", "week", "game_id").distinct()
    sched = games.withColumn("kickoff", ts("2026-10-01 00:00:00"))
    assert scorecard.checkpoint(g, scorecard.checkpoint_weeks(g, games, sched, ts("2026-12-01 00:00:00"))).first()["decision"] == "not yet evaluable"
    # a week without predictions: missed once every start is past, open before
    part = games.where("week < 9")
    weeks = scorecard.checkpoint_weeks(_graded(spark, .65, .6, range(4, 9)), part, sched, ts("2026-12-01 00:00:00"))
    assert {r.week: r.status for r in weeks.collect()}[9] == "missed"
    weeks = scorecard.checkpoint_weeks(_graded(spark, .65, .6, range(4, 9)), part, sched, ts("2026-09-01 00:00:00"))
    assert {r.week: r.done for r in weeks.collect()}[9] is False


def test_wins_over_expected(spark):
    rows = [("home", .05, .50, "win"), ("away", .17, .40, "loss"), ("home", .16, .60, "void"), ("home", .11, .30, "win"), ("away", .1099, .80, "loss")]
    d = spark.createDataFrame([(s, e if s == "home" else -e, -e if s == "home" else e, p, o, "official") for s, e, p, o in rows],
                              "paper_bet string, edge_home double, edge_away double, implied_p_home double, bet_outcome string, bet_status string")
    got = {r.tier: r for r in scorecard.wins_over_expected(d).collect()}
    assert {k: r.calls for k, r in got.items()} == {"all": 5, "lean": 2, "one_star": 1, "two_star": 2}
    assert {k: r.n for k, r in got.items()} == {"all": 4, "lean": 2, "one_star": 1, "two_star": 1}
    assert [round(got[k].vegas_expected, 2) for k in ("lean", "one_star", "two_star")] == [.70, .30, .60]
    assert round(got["all"].woe, 2) == 0.40


def test_current_week(spark):
    d = spark.createDataFrame([(1, 3, 1.0, 2.0), (1, 4, None, None), (1, 5, None, None), (2, 1, 1.0, 0.0)], "season int, week int, home_score double, away_score double")
    assert {r.season: r.current_week for r in tables.current_week(d).collect()} == {1: 4, 2: 18}
