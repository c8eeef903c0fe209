"""Plain and chunked plans against brute force, one key holding most rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foretime.operators.asof import asof_strict
from foretime.operators.ordered import number_rows
from foretime.operators.prior import (
    fill_gaps, last_known, next_value, prior_ewm, prior_running, prior_value, prior_window)
from foretime.operators.rating import rating_fold

ROWS = []
_rng = random.Random(5)
for _i in range(400):
    _key = "hot" if _i % 3 else f"k{_i % 7}"
    ROWS.append((_key, _rng.randrange(60), _i, None if _rng.random() < 0.3 else round(_rng.uniform(-5, 5), 3)))

BY_KEY: dict = {}
for _r in sorted(ROWS, key=lambda r: (r[1], r[2])):
    BY_KEY.setdefault(_r[0], []).append(_r)

MODES = [None, 7, 40]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "k string, t int, id int, x double").repartition(3).cache()


def values(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for i, w in want.items():
        for a, b in zip(got[i], w, strict=True):
            assert (a is None) == (b is None), (i, got[i], w)
            if b is not None:
                assert a == pytest.approx(b, rel=1e-9, abs=1e-12), i


def brute(fn):
    out = {}
    for rows in BY_KEY.values():
        for n, r in enumerate(rows):
            out[r[2]] = fn(rows, n)
    return out


def known(rows):
    return [r[3] for r in rows if r[3] is not None]


def mean(v):
    return sum(v) / len(v) if v else None


@pytest.mark.parametrize("mode", MODES)
def test_window(table, mode):
    d = prior_window(table, ["k"], ["t", "id"], {"m": ("x", "mean"), "n": ("x", "count"), "g": ("id", "count")}, 5, task_rows=mode)
    same(values(d, "m", "n", "g"), brute(lambda rows, n: (
        mean(known(rows[max(0, n - 5):n])), len(known(rows[max(0, n - 5):n])), min(n, 5))))


@pytest.mark.parametrize("mode", MODES)
def test_running(table, mode):
    d = prior_running(table, ["k"], ["t", "id"], {"m": ("x", "mean"), "s": ("x", "sum"), "n": ("x", "count"), "h": ("x", "max")}, task_rows=mode)
    same(values(d, "m", "s", "n", "h"), brute(lambda rows, n: (
        mean(known(rows[:n])), sum(known(rows[:n])) if known(rows[:n]) else None,
        len(known(rows[:n])), max(known(rows[:n]), default=None))))


@pytest.mark.parametrize("mode", MODES)
def test_ewm(table, mode):
    def want(rows, n):
        num = den = 0.0
        for j in range(n):
            if rows[j][3] is not None:
                w = 2.0 ** (-(n - j) / 5)
                num, den = num + w * rows[j][3], den + w
        return (num / den if den else None,)
    d = prior_ewm(table, ["k"], ["t", "id"], {"m": "x"}, 5.0, task_rows=mode)
    same(values(d, "m"), brute(want))


@pytest.mark.parametrize("mode", MODES)
def test_ewm_over_many_blocks(spark, mode):
    """Half-life 0.01 makes blocks of five rows; long gaps must still carry the last value."""
    rows = [("a", i, (1.5 if i % 13 == 0 else None)) for i in range(60)]
    d = spark.createDataFrame(rows, "k string, id int, x double")
    got = values(prior_ewm(d, ["k"], ["id"], {"m": "x"}, 0.01, task_rows=mode), "m")
    assert got[0] == (None,)
    assert all(got[i][0] == pytest.approx(1.5) for i in range(1, 60))


@pytest.mark.parametrize("mode", MODES)
def test_lag_lead_last_fill(table, mode):
    by, order = ["k"], ["t", "id"]
    same(values(prior_value(table, by, order, {"p": "x", "q": "t"}, task_rows=mode), "p", "q"),
         brute(lambda rows, n: (rows[n - 1][3], rows[n - 1][1]) if n else (None, None)))
    same(values(next_value(table, by, order, {"p": "t"}, task_rows=mode), "p"),
         brute(lambda rows, n: (rows[n + 1][1],) if n + 1 < len(rows) else (None,)))
    same(values(last_known(table, by, order, {"p": "x"}, task_rows=mode), "p"),
         brute(lambda rows, n: (known(rows[:n])[-1] if known(rows[:n]) else None,)))
    same(values(fill_gaps(table, by, order, "x", task_rows=mode), "x"),
         brute(lambda rows, n: ((known(rows[:n + 1]) or [None])[-1] if known(rows[:n + 1]) else (known(rows[n:]) or [None])[0],)))


def test_numbering(table):
    got = values(number_rows(table, ["k"], ["t", "id"]), "_pos")
    same(got, brute(lambda rows, n: (n,)))


@pytest.mark.parametrize("mode", MODES)
def test_asof_is_strict_and_carries_the_row(spark, mode):
    left = spark.createDataFrame([(i, "a", i % 10) for i in range(40)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0, 1), ("a", 5, None, 2), ("a", 5, 7.0, 3), ("b", 0, 9.0, 4)], "k string, t int, v double, rid int")
    got = values(asof_strict(left, right, "t", "t", ["k"], ["v", "rid"], right_id=["rid"], task_rows=mode), "v", "rid")
    for i in range(40):
        t = i % 10
        assert got[i] == ((None, None) if t <= 2 else (1.0, 1) if t <= 5 else (7.0, 3)), i
    nulls = asof_strict(left, right.where("rid < 3"), "t", "t", ["k"], ["v", "rid"], task_rows=mode)
    assert values(nulls, "v", "rid")[9] == (None, 2)
    unkeyed = asof_strict(left.drop("k"), right, "t", "t", [], ["rid"], right_id=["rid"], task_rows=mode)
    assert values(unkeyed, "rid")[1] == (4,)


def test_rating_steps_equal_one_pass(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        h, a = rng.sample(range(6), 2)
        hs, as_ = rng.sample(range(40), 2)
        rows.append((i, i // 2, "p" if i % 4 else "q", f"t{h}", f"t{a}", float(hs), float(as_)))
    d = spark.createDataFrame(rows, "game_id int, time int, pool string, h string, a string, hs double, s double")
    args = (["pool"], "time", "game_id", "h", "a", "hs", "s")
    one = {r.game_id: (r.home_pre, r.away_pre) for r in rating_fold(d, *args).collect()}
    many = {r.game_id: (r.home_pre, r.away_pre) for r in rating_fold(d, *args, step_events=25).collect()}
    assert one == many and len(one) == 120
    held: dict = {}
    for i, _, pool, h, a, hs, s in sorted(rows, key=lambda r: (r[1], r[0])):
        x, y = held.get((pool, h), 1500.0), held.get((pool, a), 1500.0)
        assert one[i] == pytest.approx((x, y))
        e = 1 / (1 + 10 ** ((y - x - 44.72586959078301) / 400))
        win = hs > s
        gain = 20 * math.log(abs(hs - s) + 1) * 2.2 / (0.001 * ((x - y) if win else (y - x)) + 2.2) * (win - e)
        held[(pool, h)], held[(pool, a)] = x + gain, y - gain


def test_exact_quantiles_and_auc(spark):
    from foretime.operators.metrics import exact_quantiles, roc_auc
    d = spark.createDataFrame([(float(i % 37), i % 2) for i in range(200)], "p double, y int")
    vals = sorted(float(i % 37) for i in range(200))
    for mode in MODES:
        q = exact_quantiles(d, "p", (0.25, 0.5), task_rows=mode).first()
        for got, at in ((q["q25"], 0.25), (q["q50"], 0.5)):
            x = at * 199
            lo = int(x)
            assert got == pytest.approx(vals[lo] + (vals[min(lo + 1, 199)] - vals[lo]) * (x - lo))
        auc = roc_auc(d.withColumn("m", F.lit("a")), ["m"], task_rows=mode).first()["auc"]
        pos = [float(i % 37) for i in range(200) if i % 2]
        neg = [float(i % 37) for i in range(200) if not i % 2]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        assert auc == pytest.approx(want)
