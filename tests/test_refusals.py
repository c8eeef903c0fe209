"""Two rows for one side, old team codes and ties between ids that are not integers."""

import pytest

from foretime.operators.asof import asof_strict
from foretime.operators.features import home_base
from foretime.operators.sides import to_event


def test_two_rows_for_one_side_are_refused(spark):
    rows = [(1, True, 1.0), (1, False, 2.0), (2, True, 3.0)]
    good = to_event(spark.createDataFrame(rows, "g int, h boolean, v double"), "g", "h", ["v"])
    assert [tuple(r) for r in good.collect()] == [(1, 1.0, 2.0)]
    bad = spark.createDataFrame([*rows, (1, True, 1.0)], "g int, h boolean, v double")
    with pytest.raises(Exception, match="two rows for one side of 1"):
        to_event(bad, "g", "h", ["v"]).collect()


def test_old_codes_share_the_home_base(spark):
    rows = [("REG", "Home", "OAK", 2019, "S1"), ("REG", "Home", "OAK", 2019, "S1"), ("REG", "Home", "LV", 2019, "S2")]
    base = home_base(spark.createDataFrame(rows, "game_type string, location string, home_team string, season int, stadium_id string"))
    assert [(r.team, r.season, r.stadium_id) for r in base.collect()] == [("LV", 2019, "S1")]


def test_ties_follow_the_type_of_the_id(spark):
    left = spark.createDataFrame([(1, 5)], "i int, t int")
    right = spark.createDataFrame([(4, 9.5, "low"), (4, 10.5, "high"), (4, -3.0, "least")], "t int, k double, v string")
    got = asof_strict(left, right, "t", "t", values=["v"], left_id=["i"], right_id=["k"]).collect()
    assert [r.v for r in got] == ["high"]
