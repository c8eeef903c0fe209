"""Histogram boosting against a plain tree grower, and against held-out rows."""

import numpy as np
import pandas as pd
import pytest

from foretime.operators import boosting, models
from foretime.operators.boosting import MISSING, Growth


def table(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[rng.random((n, 4)) < 0.15] = np.nan
    score = np.nan_to_num(x[:, 0]) + np.where(np.isnan(x[:, 1]), 2.0, -0.3) + 0.5 * np.nan_to_num(x[:, 2])
    y = (rng.random(n) < 1 / (1 + np.exp(-score))).astype(int)
    return x, y


def frame(spark, x, y):
    d = pd.DataFrame(x, columns=list("abcd")).assign(y=y, game_id=range(len(y)), season=[2000 + i % 5 for i in range(len(y))])
    return spark.createDataFrame(d.astype(object).where(d.notna(), None).values.tolist(), "a double, b double, c double, d double, y int, game_id int, season int")


def plain_split(x, g, h, rows, growth):
    """Best split of some rows by trying every value and both sides of the missing ones."""
    best = None
    for f in range(x.shape[1]):
        for b in range(MISSING):
            for missing_left in (False, True):
                left = np.where(x[rows, f] == MISSING, missing_left, x[rows, f] <= b)
                nl, nr = left.sum(), (~left).sum()
                if min(nl, nr) < growth.leaf_rows:
                    continue
                gl, gr, hl, hr = g[rows][left].sum(), g[rows][~left].sum(), h[rows][left].sum(), h[rows][~left].sum()
                gain = round(gl ** 2 / (hl + growth.l2) + gr ** 2 / (hr + growth.l2) - (gl + gr) ** 2 / (hl + hr + growth.l2), 9)
                if gain > 0 and (best is None or (-gain, f, b, missing_left) < best[0]):
                    best = ((-gain, f, b, missing_left), rows[left], rows[~left])
    return best


def plain_tree(x, y, raw, growth):
    p = 1 / (1 + np.exp(-raw))
    g, h = p - y, p * (1 - p)
    leaves, splits = [np.arange(len(y))], []
    while len(leaves) < growth.leaves:
        found = [(plain_split(x, g, h, rows, growth), i) for i, rows in enumerate(leaves)]
        found = [f for f in found if f[0]]
        if not found:
            break
        (key, left, right), i = min(found, key=lambda f: (f[0][0][0], f[1]))
        splits.append(key)
        leaves[i:i + 1] = []
        leaves += [left, right]
    for rows in leaves:
        raw[rows] -= growth.rate * g[rows].sum() / (h[rows].sum() + growth.l2)
    return splits


def test_trees_equal_a_plain_grower(spark):
    x, y = table(400)
    growth = Growth(rounds=2, leaves=5, l2=0.5)
    d = frame(spark, x, y)
    edges = boosting.bin_edges(d, list("abcd"), 12, exact=True)
    model = boosting.fit(d.repartition(5), list("abcd"), "y", growth, edges)
    bins = model.binned(x)
    assert ((bins == MISSING) == np.isnan(x)).all()
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for made in model.splits:
        want = plain_tree(bins, y, raw, growth)
        assert [(s["feature"], s["bin"], s["missing_left"]) for s in made] == [k[1:] for k in want]
        assert [s["gain"] for s in made] == pytest.approx([-k[0] for k in want])
    assert model.raw(bins) == pytest.approx(raw)
    p = {r.game_id: r.p for r in models.score(model, d, ["game_id"]).collect()}
    assert [p[i] for i in range(len(y))] == pytest.approx((1 / (1 + np.exp(-raw))).tolist())


def test_missing_side_is_learned_and_beats_the_base_rate(spark):
    x, y = table()
    d = frame(spark, x, y)
    out = models.walk_forward(d, list("abcd"), "y", [2004], boosting.boosting(rounds=8, leaves=6), "boosting").collect()
    assert len(out) == 300
    p, t = np.array([r.p for r in out]), np.array([r.y for r in out])
    base = np.array([y.mean()] * len(t))
    loss = lambda q: -np.log(np.where(t == 1, q, 1 - q)).mean()
    assert loss(p) < loss(base) - 0.05
    model = boosting.fit(d, list("abcd"), "y", Growth(rounds=3, leaves=4))
    # the second feature tells only by being missing
    assert any(s["feature"] == 1 for tree in model.splits for s in tree) and model.importance()["b"] > model.importance()["d"]


def test_no_split_and_one_class(spark):
    x, y = table(60)
    d = frame(spark, x, y)
    assert boosting.fit(d, list("abcd"), "y", Growth(leaf_rows=40)).trees == []
    one = boosting.fit(d.where("y = 1"), list("abcd"), "y")
    assert one.trees == [] and one.raw(one.binned(x)).tolist() == [0.0] * 60
    assert boosting.fit(d.limit(0), list("abcd"), "y").trees == []
