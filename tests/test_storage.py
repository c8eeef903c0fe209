"""Season upsert, snapshots, write-once targets, documents, streams."""

import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from foretime.operators import audit, checks
from foretime.operators.prior import prior_ewm
from foretime.sources import document, seasons, snapshots
from foretime.sources.tables import read_seasons
from foretime.streaming import feeds

UTC = dt.timezone.utc
T0 = dt.datetime(2026, 9, 1, 12, tzinfo=UTC)


def schedule(spark, tag, years):
    return spark.createDataFrame([(f"{y}-{i}", y, "REG", float(tag * (1 if i else -1))) for y in years for i in range(2)],
                                 "game_id string, season int, game_type string, spread_line double")


def test_upsert_states(spark, tmp_path):
    base, meta = str(tmp_path / "t"), str(tmp_path / "m")
    up = lambda tag, years, **k: seasons.upsert_seasons(schedule(spark, tag, years), base, "schedule", T0, 2026, meta, **k)
    assert up(1, [2024, 2025]) == [2024, 2025]
    assert up(2, [2024, 2025, 2026]) == [2026]
    assert up(3, [2026]) == [] and up(3, [2026], refresh=True) == [2026]
    with pytest.raises(ValueError, match="completed"):
        up(4, [2025], refresh=True)
    tags = {r.season: abs(r.spread_line) for r in spark.read.parquet(base).collect()}
    assert tags == {2024: 1.0, 2025: 1.0, 2026: 3.0}
    assert up(5, [2024], force=True) == [2024]
    table = spark.read.parquet(base)
    assert {r.season: r.status for r in seasons.inventory(table, seasons.latest_metadata(spark, meta), "schedule").collect()} == {
        2024: "recorded", 2025: "recorded", 2026: "recorded"}
    assert {r.status for r in seasons.inventory(table, seasons.latest_metadata(spark, meta), "plays").collect()} == {"legacy"}
    assert read_seasons(spark, base, [2024, 2026], ["game_id"]).columns == ["game_id", "season"]
    with pytest.raises(ValueError, match="2023"):
        read_seasons(spark, base, [2023, 2024])


def test_snapshots_are_immutable(spark, tmp_path):
    base = str(tmp_path)
    for hour, tag in ((15, 1), (16, 2)):
        snapshots.write_snapshot(schedule(spark, tag, [2026]), base, 2026, dt.datetime(2026, 9, 30, hour, tzinfo=UTC))
    with pytest.raises(AnalysisException):
        snapshots.write_snapshot(schedule(spark, 9, [2026]), base, 2026, dt.datetime(2026, 9, 30, 15, tzinfo=UTC))
    s = snapshots.read_snapshots(spark, base)
    assert [r.pulled_at.hour for r in snapshots.catalogue(s).select(F.col("pulled_at")).collect()] == [15, 16]
    assert {abs(r.spread_line) for r in snapshots.latest(s).collect()} == {2.0}


def test_write_once_and_republish(spark, tmp_path):
    d = spark.createDataFrame([(2026, 3, "a", 0.1 + 0.2, None), (2026, 4, "b", 1 / 3, 2.0)], "season int, week int, game_id string, p double, q double")
    once = str(tmp_path / "once")
    snapshots.publish_once(d.where("week = 3"), once, 2026, 3)
    with pytest.raises(AnalysisException):
        snapshots.publish_once(d.where("week = 3"), once, 2026, 3)
    many = str(tmp_path / "many")
    snapshots.republish(d, many)
    snapshots.republish(d.where("week = 4").withColumn("p", F.lit(9.0)), many)
    assert {r.week: r.p for r in spark.read.parquet(many).collect()} == {3: pytest.approx(0.3), 4: 9.0}
    csv = str(tmp_path / "csv")
    snapshots.write_weekly_csv(d, csv)
    back = snapshots.read_weekly_csv(spark, csv, d.schema)
    got = {r.game_id: (r.week, r.p, r.q) for r in back.collect()}
    assert got["a"] == (3, 0.3, None) and got["b"][1] == pytest.approx(1 / 3, abs=1e-9)


def test_document_pages(spark):
    d = spark.createDataFrame([(1, i, i / 7, None if i % 2 else "x") for i in range(5)], "season int, g int, p double, s string")
    pages = {r.page: json.loads(r.document) for r in document.export_pages(d, ["season"], ["g"], ["p", "g", "s"], page_rows=2).collect()}
    assert sorted(pages) == [0, 1, 2] and [len(p["games"]) for _, p in sorted(pages.items())] == [2, 2, 1]
    assert pages[1]["games"][1] == {"g": 3, "p": 0.4286, "s": None}


def test_checks(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, None), (4, 4.0)], "k int, v double")
    assert {(r.k, r.why) for r in checks.matched_or_refuse(a, b, ["k"], ["v"]).collect()} == {(3, "only left"), (4, "only right")}
    assert {(r.k, r.only_in) for r in checks.key_difference(a, b, ["k"]).collect()} == {(3, "left"), (4, "right")}
    with pytest.raises(ValueError, match="duplicate"):
        checks.join_one_to_one(a.union(a), b, ["k"])
    r = audit.table_diff(a, b.where("k < 4").union(spark.createDataFrame([(3, 3.5)], b.schema)), ["k"]).first()
    assert (r.compared, r.mismatches, r.max_abs_diff) == (3, 1, 0.5)
    assert audit.fingerprint(a).first() == audit.fingerprint(a.repartition(3)).first()
    assert audit.fingerprint(a).first() != audit.fingerprint(b).first()


def test_snapshot_stream_keeps_each_row_once(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    day = lambda n: dt.datetime(2026, 9, n)
    d = spark.createDataFrame([("a", day(1), 1.0), ("b", day(1), 2.0)], "game_id string, pulled_at timestamp, price double")
    d.write.mode("append").parquet(land)
    run = lambda: feeds.append_snapshots(feeds.landing_stream(spark, land, d.schema), out, str(tmp_path / "cp")).awaitTermination()
    run()
    d.write.mode("append").parquet(land)
    spark.createDataFrame([("a", day(2), 1.5)], d.schema).write.mode("append").parquet(land)
    run()
    got = sorted((r.game_id, r.pulled_at.day, r.price) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1, 1.0), ("a", 2, 1.5), ("b", 1, 2.0)]


def test_state_stream_equals_batch(spark, tmp_path):
    land = str(tmp_path / "land")
    rows = [(f"u{i % 3}", i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), None if i % 5 == 0 else float(i % 11)) for i in range(60)]
    schema = "u string, id bigint, at timestamp, x double"
    whole = spark.createDataFrame(rows, schema)
    for lo, hi in ((0, 20), (20, 45), (45, 60)):
        spark.createDataFrame(rows[lo:hi], schema).coalesce(1).write.mode("append").parquet(land)
        stream = feeds.prior_state_stream(feeds.landing_stream(spark, land, whole.schema), "u", "at", "id", "x", 5.0)
        q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start())
        q.awaitTermination()
    late = spark.createDataFrame([("u0", 99, dt.datetime(2026, 1, 1), 5.0)], schema)
    late.write.mode("append").parquet(land)
    q = (feeds.prior_state_stream(feeds.landing_stream(spark, land, whole.schema), "u", "at", "id", "x", 5.0).writeStream.format("parquet")
         .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[99].late and len(got) == 61
    for r in prior_ewm(whole, ["u"], ["at", "id"], {"m": "x"}, 5.0).collect():
        assert not got[r.id].late
        assert (got[r.id].prior_mean is None) == (r.m is None)
        if r.m is not None:
            assert got[r.id].prior_mean == pytest.approx(r.m, rel=1e-9)


def test_equal_times_are_not_late(spark, tmp_path):
    """(time, id) orders the stream: an equal time with a larger id is the next row, in one batch or in two."""
    schema = "u string, id long, at timestamp, x double"
    at = dt.datetime(2026, 1, 1)
    rows = [("a", 1, at, 1.0), ("a", 2, at, 5.0), ("a", 3, at, 2.0), ("a", 4, at + dt.timedelta(days=1), 3.0)]
    land = str(tmp_path / "land")
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(land)
        stream = feeds.prior_state_stream(feeds.landing_stream(spark, land, spark.createDataFrame(rows, schema).schema), "u", "at", "id", "x", 5.0)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.id: r.m for r in prior_ewm(spark.createDataFrame(rows, schema), ["u"], ["at", "id"], {"m": "x"}, 5.0).collect()}
    assert not any(r.late for r in got.values()) and got[1].prior_mean is None
    assert [got[i].prior_mean for i in (2, 3, 4)] == pytest.approx([want[i] for i in (2, 3, 4)], rel=1e-9)
