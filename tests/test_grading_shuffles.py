"""Graded predictions meet the quotes where these were dealt by game."""

import os
import re

import pytest

from foretime.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", ["line_value_statuses", "season_verdict"])
def test_quotes_are_not_shuffled_by_game_and_time(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.search(r"SortMergeJoin \[game_id#\d+L?, last_pulled#", plan)
    assert not re.search(r"hashpartitioning\(game_id#\d+L?, last_pulled#", plan)
