"""State kept between arrivals: array folds against plain sums, windows, and timers that close entities."""

import datetime as dt

import numpy as np
import pytest

from foretime.streaming import feeds

DAY = dt.datetime(2026, 1, 1)


def test_array_fold_equals_the_plain_one(monkeypatch):
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 700):
        x = rng.normal(size=n)
        x[rng.random(n) < 0.3] = np.nan
        for halflife, first in ((5.0, (0.0, 0.0)), (1.5, (2.0, 1.25))):
            decay = 2.0 ** (-1 / halflife)
            means, total, weight = feeds.prior_ewm_values(x, decay, *first)
            t, w = first
            for i, v in enumerate(x):
                assert (np.isnan(means[i]) and w == 0) or means[i] == pytest.approx(t / w, rel=1e-9)
                known = not np.isnan(v)
                t, w = (t + (v if known else 0.0)) * decay, (w + known) * decay
            assert (total, weight) == (pytest.approx(t, rel=1e-9, abs=1e-12), pytest.approx(w, rel=1e-9))
    series = rng.normal(size=60)
    series[::4] = np.nan
    got = feeds.prior_window_means(series, 20, 7)
    for k, i in enumerate(range(20, 60)):
        assert got[k] == pytest.approx(np.nanmean(series[i - 7:i]))
    assert np.isnan(feeds.prior_window_means(np.array([np.nan, 1.0]), 0, 3)).all()


def run(spark, tmp_path, rows, **how):
    d = spark.createDataFrame(rows, "u string, id string, at timestamp, x double")
    d.write.mode("append").parquet(str(tmp_path / "land"))
    stream = feeds.prior_state_stream(feeds.landing_stream(spark, str(tmp_path / "land"), d.schema), "u", "at", "id", "x", 5.0, **how)
    feeds.append_states(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    return [(r.u, r.id, r.prior_rows, r.recent_mean, str(r.late).lower(), r.closed) for r in out.orderBy("u", "closed", "id").collect()]


def test_window_and_late_rows_over_arrivals(spark, tmp_path):
    rows = [("a", f"e{i}", DAY + dt.timedelta(hours=i // 2), None if i == 3 else float(i)) for i in range(8)]
    run(spark, tmp_path, rows[:5], window=3)
    # an equal time with a larger id follows, a smaller one is late; null entities have a state too
    got = run(spark, tmp_path, [rows[5], rows[6], ("a", "d", DAY + dt.timedelta(hours=3), 9.0), ("a", "a", DAY + dt.timedelta(hours=2), 9.0), (None, "n", DAY, 1.0)], window=3)
    assert got == [
        (None, "n", 0, None, "false", False),
        ("a", "a", None, None, "true", False), ("a", "d", 6, 4.5, "false", False),
        ("a", "e0", 0, None, "false", False), ("a", "e1", 1, 0.0, "false", False), ("a", "e2", 2, 0.5, "false", False),
        ("a", "e3", 3, 1.0, "false", False), ("a", "e4", 4, 1.5, "false", False), ("a", "e5", 5, 3.0, "false", False),
        ("a", "e6", 7, 6.0, "false", False)]
    side = spark.read.parquet(str(tmp_path / "out")).where("late = 'true'").select("id").collect()
    assert [r.id for r in side] == ["a"]


def test_silent_entities_are_closed_and_forgotten(spark, tmp_path):
    day_ms = 86_400_000
    run(spark, tmp_path, [("a", "1", DAY, 4.0), ("a", "2", DAY, 6.0)], idle_ms=day_ms)
    got = run(spark, tmp_path, [("b", "1", DAY + dt.timedelta(days=3), 1.0)], idle_ms=day_ms)
    assert ("a", "2", 2, 5.0, "false", True) in got and ("b", "1", 0, None, "false", False) in got
    # forgotten: an old time is news again
    got = run(spark, tmp_path, [("a", "0", DAY, 7.0)], idle_ms=day_ms)
    assert ("a", "0", 0, None, "false", False) in got
