"""Append-only snapshots and write-once results."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STAMP = "%Y%m%dT%H%M%SZ"
_NAME = r"schedules_(\d{4})_(\d{8}T\d{6}Z)"


def snapshot_name(season: int, pulled_at: datetime) -> str:
    return f"schedules_{season}_{pulled_at.astimezone(timezone.utc).strftime(_STAMP)}"


def write_snapshot(schedule: DataFrame, base: str, season: int, pulled_at: datetime) -> str:
    """Store one immutable copy of a season's schedule; an existing one is never overwritten."""
    path = f"{base}/{snapshot_name(season, pulled_at)}.parquet"
    schedule.where(F.col("season") == season).write.mode("errorifexists").parquet(path)
    return path


def read_snapshots(spark: SparkSession, base: str, season: int | None = None) -> DataFrame:
    """All snapshots stacked, each row with the pull time its name states."""
    glob = f"{base}/schedules_{season or '*'}_*.parquet"
    df = spark.read.parquet(glob)
    name = F.regexp_extract(F.col("_metadata.file_path"), _NAME, 2)
    return df.withColumn("pulled_at", F.to_timestamp(name, "yyyyMMdd'T'HHmmss'Z'"))


def catalogue(snapshots: DataFrame) -> DataFrame:
    """Pull times, oldest first."""
    return snapshots.groupBy("season", "pulled_at").agg(F.count(F.lit(1)).alias("rows")).orderBy("season", "pulled_at")


def latest(snapshots: DataFrame) -> DataFrame:
    """Rows of each season's newest snapshot."""
    newest = snapshots.groupBy("season").agg(F.max("pulled_at").alias("pulled_at"))
    return snapshots.join(newest, ["season", "pulled_at"], "left_semi")


def newest_names(spark: SparkSession, base: str) -> dict[int, str]:
    """Season -> name of its newest snapshot, from the names of the stored files alone: no row is read."""
    name = F.regexp_extract(F.col("_metadata.file_path"), _NAME, 0)
    files = spark.read.parquet(f"{base}/schedules_*.parquet").select(name.alias("name"), F.regexp_extract(F.col("_metadata.file_path"), _NAME, 1).cast("int").alias("season"))
    # one row per season
    return {r["season"]: r["name"] for r in files.groupBy("season").agg(F.max("name").alias("name")).collect()}


def read_newest(spark: SparkSession, base: str) -> DataFrame:
    """Rows of each season's newest snapshot; files of older ones are pruned by their names."""
    names = sorted(newest_names(spark, base).values())
    return read_snapshots(spark, base).where(F.regexp_extract(F.col("_metadata.file_path"), _NAME, 0).isin(names))


def publish_once(df: DataFrame, base: str, season: int, week: int) -> str:
    """Write a week's result; a week that exists is refused."""
    path = f"{base}/season={season}/week={week}"
    df.drop("season", "week").write.mode("errorifexists").parquet(path)
    return path


def republish(df: DataFrame, base: str) -> None:
    """Regenerable weeks: replace exactly the (season, week) partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("season", "week").parquet(base))


def write_weekly_csv(df: DataFrame, base: str) -> None:
    """Weekly text files with ten significant digits for doubles."""
    ten = [F.format_string("%.10g", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    # a missing number stays missing, not the text "null"
    kept = [F.when(F.col(c).isNotNull(), e).alias(c) if t == "double" else F.col(c)
            for (c, t), e in zip(df.dtypes, ten, strict=True)]
    df.select(*kept).write.mode("overwrite").partitionBy("season", "week").option("header", True).csv(base)


def read_weekly_csv(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(base)


def predicted_ids(predictions: DataFrame) -> DataFrame:
    """Keyed rows of what each week predicted."""
    return predictions.select("season", "week", "game_id").distinct()
