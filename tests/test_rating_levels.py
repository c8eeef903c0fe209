"""The rating fold by dependency level against the plain fold, event by event."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from foretime.operators import rating


def fold(rows):
    """Ratings before each event, one event after the other."""
    held, out = {}, {}
    for i, _, pool, h, a, hs, s in sorted(rows, key=lambda r: (r[1], r[0])):
        x, y = held.get((pool, h), 1500.0), held.get((pool, a), 1500.0)
        out[i] = (x, y)
        if hs is None or s is None:
            continue
        won = hs > s
        lead = x - y if won else y - x
        gain = 20 * math.log(abs(hs - s) + 1) * 2.2 / (0.001 * lead + 2.2) * (won - 1 / (1 + 10 ** ((y - x - 44.72586959078301) / 400)))
        held[pool, h], held[pool, a] = x + gain, y - gain
    return out


def events(n, pools, entities, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pool = rng.choice(pools)
        h, a = rng.choices(entities, k=2)
        hs, s = (None, 3.0) if rng.random() < 0.05 else map(float, rng.sample(range(40), 2))
        rows.append((i, rng.randrange(n), pool, h, a, hs, s))
    return rows


@pytest.mark.parametrize(("block", "pools"), [(8192, ["p", "q", None]), (7, ["p", "q", "1:p", ""]), (1, ["p"])])
def test_levels_equal_the_sequential_fold(spark, block, pools):
    # pools and entities whose names run into each other, null ones, and events of one entity with itself
    rows = events(400, pools, ["a", "b", "1:a", "", None, "c"], block)
    d = spark.createDataFrame(rows, "game_id int, time int, pool string, h string, a string, hs double, s double").repartition(6)
    got = rating.rating_fold(d, ["pool"], "time", "game_id", "h", "a", "hs", "s", step_events=block)
    assert got.columns == ["pool", "game_id", "home_pre", "away_pre"]
    want = fold(rows)
    assert {r.game_id: (pytest.approx(r.home_pre), pytest.approx(r.away_pre)) for r in got.collect()} == want


def test_levels_wait_for_both_sides():
    rng = np.random.default_rng(1)
    for n, entities in ((1, 1), (50, 3), (300, 40), (300, 2)):
        h, a = rng.integers(0, entities, (2, n))
        level, seen = np.full(n, -1), {}
        for k, at in enumerate(rating.levels(h, a)):
            assert (level[at] == -1).all()
            level[at] = k
        for i in range(n):
            want = max(seen.get(h[i], -1), seen.get(a[i], -1)) + 1
            assert level[i] == want
            seen[h[i]] = seen[a[i]] = want


def test_wide_levels_are_folded_at_once(monkeypatch):
    calls = []
    monkeypatch.setattr(rating, "gains", lambda h, *x, f=rating.gains: calls.append(len(h)) or f(h, *x))
    r = rating.Ratings(20.0, 1500.0, 44.0)
    home, away = (pa.array([f"{s}{i % 500}" for i in range(2000)]) for s in "ha")
    r.fold(home, away, np.arange(2000) % 9 - 4.5)
    assert calls == [500] * 4


def test_empty_events(spark):
    d = spark.createDataFrame([], "game_id int, time int, pool string, h string, a string, hs double, s double")
    assert rating.rating_fold(d, ["pool"], "time", "game_id", "h", "a", "hs", "s").count() == 0
    assert rating.rating_fold(d, [], "time", "game_id", "h", "a", "hs", "s").columns == ["game_id", "home_pre", "away_pre"]
