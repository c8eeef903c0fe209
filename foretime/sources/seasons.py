"""Season-partitioned tables: load what is missing, replace what is still moving, record what came."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretime.operators.audit import fingerprint

METADATA = "kind string, season bigint, pulled_at timestamp, rows bigint, sum string, xor bigint"


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table at ``path``, or None where nothing is stored yet."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def stored_seasons(spark: SparkSession, path: str) -> list[int]:
    t = stored(spark, path)
    return [] if t is None else sorted(r[0] for r in t.select("season").distinct().collect())


def upsert_seasons(incoming: DataFrame, path: str, kind: str, pulled_at: datetime, current: int,
                   metadata_path: str, force: bool = False, refresh: bool = False) -> list[int]:
    """Write the seasons of ``incoming`` that are missing; returns the seasons written.

    ``refresh`` replaces the season in progress and refuses to touch completed
    ones; ``force`` rewrites everything delivered. Only the partitions written
    are overwritten.
    """
    spark = incoming.sparkSession
    delivered = sorted(r[0] for r in incoming.select("season").distinct().collect())
    if refresh:
        closed = [s for s in delivered if s < current]
        if closed:
            raise ValueError(f"completed seasons are not refreshed: {closed}")
        wanted = delivered
    elif force:
        wanted = delivered
    else:
        present = set(stored_seasons(spark, path))
        wanted = [s for s in delivered if s not in present]
    if wanted:
        new = incoming.where(F.col("season").isin(wanted))
        (new.repartition("season", F.pmod(F.xxhash64(*[c for c in new.columns if c != "season"]), F.lit(64)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("season").parquet(path))
        record_pull(spark, path, kind, wanted, pulled_at, metadata_path)
    return wanted


def record_pull(spark: SparkSession, path: str, kind: str, seasons: Sequence[int],
                pulled_at: datetime, metadata_path: str) -> None:
    """Append pull time, row count and content digest of each season."""
    table = spark.read.parquet(path)
    cols = sorted(c for c in table.columns if c != "season")
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols])
    d = table.where(F.col("season").isin(list(seasons))).select("season", h.alias("h")).groupBy("season").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum"),
        F.bit_xor("h").alias("xor"))
    d.select(F.lit(kind).alias("kind"), F.col("season").cast("bigint"), F.lit(pulled_at).cast("timestamp").alias("pulled_at"),
             "rows", "sum", "xor").write.mode("append").parquet(metadata_path)


def latest_metadata(spark: SparkSession, metadata_path: str) -> DataFrame:
    t = stored(spark, metadata_path, METADATA)
    t = spark.createDataFrame([], METADATA) if t is None else t
    return t.groupBy("kind", "season").agg(F.max(F.struct("pulled_at", "rows", "sum", "xor")).alias("m")).select(
        "kind", "season", "m.*")


def inventory(table: DataFrame, metadata: DataFrame, kind: str) -> DataFrame:
    """Stored seasons with their recorded pull; a season without one is ``legacy``."""
    counts = table.groupBy(F.col("season").cast("bigint").alias("season")).agg(F.count(F.lit(1)).alias("stored_rows"))
    meta = metadata.where(F.col("kind") == kind).select("season", "pulled_at", F.col("rows").alias("recorded_rows"))
    d = counts.join(meta, "season", "left")
    status = (F.when(F.col("recorded_rows").isNull(), "legacy")
              .when(F.col("recorded_rows") == F.col("stored_rows"), "recorded").otherwise("changed since"))
    return d.withColumn("status", status)


def content_of(df: DataFrame) -> str:
    """Digest text of a table, for comparing a pull with a snapshot or a frozen model's data."""
    r = fingerprint(df).first()
    return f"{r['rows']}-{r['sum']}-{r['xor']}"
