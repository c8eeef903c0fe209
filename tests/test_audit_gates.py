"""Audits that have to fail when a row is missing."""

from foretime.operators import audit


def test_missing_total_or_parts_are_reported(spark):
    rows = [("all", 5.0, 2.0), ("a", 3.0, 1.0), ("b", 2.0, 0.5)]
    report = spark.createDataFrame(rows, "tier string, n double, u double")
    found = lambda df: {r.metric for r in audit.parts_add_up(df, "tier", "all", ["n", "u"]).collect()}
    assert found(report) == {"u"}
    assert found(report.where("tier <> 'all'")) == {"n", "u"}
    assert found(report.where("tier = 'all'")) == {"n", "u"}


def test_control_needs_one_clean_and_a_leaky_variant(spark):
    rows = [("clean", True), ("peek", False), ("shift", False)]
    results = spark.createDataFrame(rows, "variant string, passed boolean")
    sound = lambda df: audit.control_gate(df).first().sound
    assert sound(results) is True
    assert sound(results.where("variant <> 'clean'")) is False
    assert sound(results.where("variant = 'clean'")) is False
    assert sound(results.unionAll(results.where("variant = 'clean'"))) is False
    assert sound(results.limit(0)) is False
