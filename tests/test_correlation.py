"""Correlation matrices from merged co-moments against pandas, and what is decided from them."""

import numpy as np
import pandas as pd
import pytest

from foretime.operators import metrics, models


def table(n=800):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 7))
    x[:, 1] += 2 * x[:, 0]
    x[:, 2] = 1e9 + x[:, 0] * 1e-2  # far from zero, little spread
    x[rng.random((n, 7)) < 0.2] = np.nan
    x[:, 5] = 3.0
    x[:, 6] = np.nan
    x[4, 6] = 1.0
    return pd.DataFrame(x, columns=list("abcdefg"))


def spark_frame(spark, d):
    return spark.createDataFrame(d.astype(object).where(d.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in d))


@pytest.mark.parametrize("block", [128, 2])
def test_matrix_equals_pandas(spark, monkeypatch, block):
    monkeypatch.setattr(metrics, "BLOCK_COLUMNS", block)
    if block == 2:
        d = table()
        want = d.corr()
        # one worker's blocks, merged in any order
        parts = [metrics.CoMoments(d.values[i:i + 100, :3], d.values[i:i + 100, 3:]) for i in range(0, 800, 100)]
        total = parts[5]
        for p in parts[:5] + parts[6:]:
            total.merge(metrics.CoMoments.from_bytes(p.to_bytes(), (3, 4)))
        assert np.allclose(total.correlation(), want.values[:3, 3:], equal_nan=True, atol=1e-5)
        return
    d = table()
    got = {(r.a, r.b): (r.n, r.r) for r in metrics.correlation_matrix(spark_frame(spark, d).repartition(5), list(d)).collect()}
    want = d.corr()
    assert len(got) == 21
    for (a, b), (n, r) in got.items():
        assert n == d[[a, b]].notna().all(axis=1).sum()
        assert (r is None and np.isnan(want.loc[a, b])) or r == pytest.approx(want.loc[a, b], abs=1e-5)


def test_many_blocks_of_columns(spark):
    d = pd.DataFrame(np.random.default_rng(2).normal(size=(60, 150)), columns=[f"c{i}" for i in range(150)])
    got = {(r.a, r.b): r.r for r in metrics.correlation_pairs(spark_frame(spark, d), list(d)).collect()}
    want = d.corr().values
    assert len(got) == 150 * 149 // 2
    assert all(got[f"c{i}", f"c{j}"] == pytest.approx(want[i, j]) for i in range(150) for j in range(i + 1, 150))


def test_redundant_and_opposed(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", -0.95), ("b", "c", 0.1), ("c", "d", None)], "a string, b string, r double")
    ranks = spark.createDataFrame([("a", 2.0, 0.5), ("b", 1.0, -0.1), ("c", 2.0, 0.3), ("d", 4.0, 1.0)], "feature string, avg_rank double, coef double")
    assert {r.feature for r in models.redundant(pairs, ranks, 0.8).collect()} == {"a", "c"}
    assert [(r.a, r.b) for r in models.opposed_pairs(pairs, ranks).collect()] == [("a", "b")]
    assert metrics.correlation_matrix(spark.createDataFrame([], "x double, y double"), ["x", "y"]).count() == 0
