"""Scans under a fixed contract: declared columns, one normalising step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    return normalise(spark.read.parquet(path))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a table's files, by a listing: no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.sum("length")).first()[0] or 0


def normalise(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """NaN becomes NULL, zone-less timestamps become instants, types follow ``schema``.

    Doing this once at the scan keeps every later aggregate free of NaN rules.
    """
    wanted = {f.name: f.dataType for f in schema} if schema else {}
    missing = [n for n in wanted if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing from source: {missing}")
    out = []
    for f in df.schema:
        if wanted and f.name not in wanted:
            continue
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        if isinstance(t, T.TimestampNTZType):
            c = c.cast(T.TimestampType())
        target = wanted.get(f.name)
        if target is not None:
            c = c.cast(target)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_seasons(spark: SparkSession, base: str, seasons: Sequence[int],
                 columns: Sequence[str] = (), schema: T.StructType | None = None) -> DataFrame:
    """Partitions ``season=..`` of a stored table; refuses when one of them is absent.

    The filter prunes partitions and the column list prunes the scan; presence
    is read from the partition values alone.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(base).where(F.col("season").isin([int(s) for s in seasons]))
    present = {r[0] for r in df.select("season").distinct().collect()}
    absent = sorted(set(seasons) - present)
    if absent:
        raise ValueError(f"seasons not stored under {base}: {absent}")
    df = normalise(df)
    return df.select(*dict.fromkeys([*columns, "season"])) if columns else df
