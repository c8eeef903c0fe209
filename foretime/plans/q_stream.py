"""Streams driven to their end over parts of a given table, returned as rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretime.plans.registry import query, r6
from foretime.session import shared_folder
from foretime.streaming import feeds


def deliver(waves: list[DataFrame], start) -> DataFrame:
    """Land each wave of rows and run the stream to its end behind it; what it has appended by then.

    ``start(landed, target, checkpoint)`` begins a stream over the landing folder.
    """
    spark = waves[0].sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for wave in waves:
        wave.write.mode("append").parquet(f"{root}/landing")
        landed = feeds.landing_stream(spark, f"{root}/landing", waves[0].schema, files_per_batch=1_000_000)
        start(landed, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/rows")


@query("landed_snapshots_once", "SELECT event_id, user_id, ts, round(value, 6) AS value FROM events")
def landed_snapshots_once(t):
    """Snapshots land in two waves, most of them twice; the append-only table holds each once."""
    rows = t.raw("events").select("event_id", "user_id", F.col("ts").alias("pulled_at"), "value")
    first = rows.where(F.col("pulled_at") < F.lit("2024-01-16").cast("timestamp"))
    # the second wave brings the first once more, and its own rows twice
    second = rows.unionAll(rows.where(F.col("pulled_at") >= F.lit("2024-01-16").cast("timestamp")))
    d = deliver([first.unionAll(first), second], lambda s, out, at: feeds.append_snapshots(s, out, at, keys=("event_id", "pulled_at")))
    return d.select("event_id", "user_id", F.col("pulled_at").alias("ts"), *r6("value"))


_WAVES = """
WITH r AS (SELECT event_id, user_id, date_trunc('hour', ts) AS hour, metric AS x,
  CASE WHEN ts < timestamp '2024-01-16' AND event_id % 11 <> 0 THEN 1 ELSE 2 END AS wave FROM ev),
n AS (SELECT user_id, max(struct_pack(h := hour, i := event_id)) AS newest FROM r WHERE wave = 1 GROUP BY 1),
s AS (SELECT r.*, wave = 2 AND newest IS NOT NULL AND struct_pack(h := hour, i := event_id) <= newest AS late FROM r LEFT JOIN n USING (user_id)),
p AS (SELECT *, row_number() OVER o AS i, avg(x) OVER (o ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING) AS recent
  FROM s WHERE NOT late WINDOW o AS (PARTITION BY user_id ORDER BY hour, event_id)),
m AS (SELECT *, sum(x * pow(2.0, i / 5.0)) OVER q / sum(CASE WHEN x IS NOT NULL THEN pow(2.0, i / 5.0) END) OVER q AS mean
  FROM p WINDOW q AS (PARTITION BY user_id ORDER BY hour, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


@query("prior_state_by_arrival", _WAVES + """
SELECT event_id, user_id, false AS late, i - 1 AS prior_rows, round(mean, 6) AS prior_mean, round(recent, 6) AS recent_mean FROM m
UNION ALL SELECT event_id, user_id, true, -1, NULL, NULL FROM s WHERE late""", ("ev",))
def prior_state_by_arrival(t):
    """State kept between two arrivals, hourly times that are often equal; the second arrival holds late rows."""
    rows = t.events().select("event_id", "user_id", F.date_trunc("hour", "ts").alias("hour"), F.col("metric"),
                             ((F.col("ts") < F.lit("2024-01-16").cast("timestamp")) & (F.col("event_id") % 11 != 0)).alias("early"))
    waves = [rows.where(w).drop("early") for w in ("early", "not early")]
    d = deliver(waves, lambda s, out, at: feeds.append_states(feeds.prior_state_stream(s, "user_id", "hour", "event_id", "metric", 5.0), out, at))
    return d.select("event_id", "user_id", F.col("late").cast("boolean").alias("late"), F.coalesce("prior_rows", F.lit(-1)).alias("prior_rows"), *r6("prior_mean", "recent_mean"))
