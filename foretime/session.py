"""Session settings shared by tests, bench and batch jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Typed state and timers need this store; it keeps state on disk, beyond an executor's memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stored bytes of input for each shuffle partition, and shuffled bytes up to which small neighbours are joined again.
PARTITION_BYTES, JOINED_BYTES = 4 << 20, 16 << 20
#: False lets a join on several columns keep rows that are dealt by some of them already.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: True deletes the shuffle files of every finished query, not only when the driver collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def build_session(master: str | None = None, app: str = "foretime", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return pin(builder.getOrCreate())


def pin(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on: UTC wall clock, adaptive plans, streams' state on disk."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set(ALL_KEYS, "true")
    spark.conf.set(DROP_SHUFFLES, "false")
    return spark


def keep_dealt(spark: SparkSession) -> None:
    """For queries whose tables are large against their input: joins keep rows where one of their keys put them, and
    what a finished step shuffled goes when the step ends. Holds until the next ``pin``."""
    spark.conf.set(ALL_KEYS, "false")
    spark.conf.set(DROP_SHUFFLES, "true")


def deal_by_size(spark: SparkSession, input_bytes: int) -> None:
    """As many shuffle partitions as the input needs, so that a task's share does not grow with it.

    Adaptive plans join small neighbours again. Streams are not adaptive and keep the session's number.
    """
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // PARTITION_BYTES), 1)
    spark.conf.set(INITIAL_PARTITIONS, str(wanted))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(JOINED_BYTES))


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle with a number of its own takes."""
    own = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return max(own, int(spark.conf.get(INITIAL_PARTITIONS, None) or 0))


def keeps_dealt(spark: SparkSession) -> bool:
    return spark.conf.get(ALL_KEYS) == "false"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A private one is only made when the session has none and runs in local mode.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foretime-"))
    return sc.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` by a reliable checkpoint and cut its lineage.

    Used where later stages must see the very same rows in the very same
    partitions (row ids drawn from partition offsets, iterative state).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Store ``df``, and the rows of ``more`` tables of its columns one after the other, as a parquet table in the
    shared folder and scan it from there.

    For tables several branches of a plan read: unlike a checkpoint the scan
    still prunes columns, takes pushed filters and knows its size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    for d in (df, *more):
        d.write.parquet(path, mode="append", compression="zstd")
    return spark.read.schema(df.schema).parquet(path)
