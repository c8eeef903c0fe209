"""Headline queries at one scale; prints one JSON line.

Every query is planned and run from the given tables: derived plans are dropped
between queries, so nothing computed for one is reused by the next.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foretime.plans.catalog import QUERIES  # noqa: E402
from foretime.plans.proxies import Tables  # noqa: E402
from foretime.session import build_session  # noqa: E402

HEADLINE = (
    "prior_window_mean_count", "prior_ewm_by_entity", "prior_period_mean_asof", "asof_last_view_before_purchase",
    "shrunk_prior_mean_user_week", "team_game_log", "rolled_features", "rating_fold_by_pool", "context_features",
    "graded_log", "predictor_scorecard", "betting_scorecard", "evaluation_blocks", "model_metrics", "price_distribution")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["first_row_per_entity"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's threads
    times = {}
    for name in HEADLINE:
        Tables._open.clear()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
