"""Connected components of a large graph by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretime.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of ``edges`` (a, b) with the smallest node of its component.

    Each step takes the smallest label among a node and its neighbours, then that of
    the node so named, so that chains shorten by half. Sums and minima are combined
    before their shuffles; no node's neighbours are gathered anywhere."""
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("seen"))
        low = labels.join(seen, F.col("node") == F.col("a")).select("node", "label", F.least("label", "seen").alias("low"))
        of = labels.select(F.col("node").alias("n"), F.col("label").alias("far"))
        nearer = stored(low.join(of, F.col("low") == F.col("n"), "left").select(
            "node", F.least("low", F.coalesce("far", "low")).alias("label"), (F.least("low", F.coalesce("far", "low")) < F.col("label")).alias("moved")), "labels")
        labels = nearer.select("node", "label")
        if nearer.where("moved").limit(1).count() == 0:
            return labels
