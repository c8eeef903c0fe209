"""Registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = ("prior_window_mean_count", "prior_ewm_by_entity", "asof_last_view_before_purchase", "shrunk_prior_mean_user_week",
         "team_game_log", "rating_chain_audit", "graded_log", "betting_scorecard", "exact_mcnemar_pairs", "model_metrics",
         "price_distribution", "kickoff_utc", "export_pages", "negative_control", "ewm_induction_failures", "perturbation_by_week",
         "rating_fold_by_pool", "model_frame_full", "open_model_frame", "frame_correlations", "window_oracle_mismatches", "week_documents",
         "newest_snapshot_rows", "upserted_seasons", "weekly_text_read_back", "landed_snapshots_once", "prior_state_by_arrival",
         "boosted_tree_splits", "predictions_with_grades", "edge_histogram", "feature_tripwire",
         "reconciled_reports", "parts_that_do_not_add_up", "predicted_without_schedule", "seeded_sample", "snapshot_trigger")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or (isinstance(a, float) and b is not None and a == pytest.approx(b, abs=2e-6)), (g, w)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
