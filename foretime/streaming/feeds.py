"""Streams: landing snapshots into an append-only table, and per-entity decayed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def landing_stream(spark: SparkSession, path: str, schema: T.StructType,
                   files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_snapshots(stream: DataFrame, target: str, checkpoint: str, delay: str = "2 days",
                     keys: tuple[str, ...] = ("game_id", "pulled_at")) -> StreamingQuery:
    """Append each (event, pull time) once, however often its file is delivered.

    Every micro-batch overwrites its own ``batch`` partition, so a batch that is
    replayed after a failure leaves no second copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    unique = stream.withWatermark("pulled_at", delay).dropDuplicatesWithinWatermark(list(keys))
    return (unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


#: Rows folded with one set of decay powers, which stay far from overflow for half-lives of a row and more.
FOLD_ROWS = 256


class PriorState(StatefulProcessor):
    """Per entity: what its rows so far say about its next one.

    ``now`` holds the decayed sum and weight, the rows seen and the newest row's place; ``recent``
    the values of the last rows of the window. A timer closes an entity that stays silent.
    """

    def __init__(self, entity: str, id: str, id_type: str, halflife: float, window: int, idle_ms: int | None):
        self.entity, self.id, self.id_type = entity, id, id_type
        self.decay, self.window, self.idle_ms = 2.0 ** (-1.0 / halflife), window, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", f"total double, weight double, seen bigint, us bigint, id {self.id_type}")
        self.recent = handle.getListState("recent", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, weight, seen, us, last_id = self.now.get() if self.now.exists() else (0.0, 0.0, 0, None, None)
        arrived = pd.concat([c[["at_us", self.id, "at_value"]] for c in rows]).sort_values(["at_us", self.id])
        late = pd.Series(False, arrived.index) if us is None else (
            (arrived["at_us"] < us) | ((arrived["at_us"] == us) & (arrived[self.id] <= last_id)))
        if late.any():
            yield self._out(key, arrived.loc[late, self.id], late=True)
        news = arrived[~late]
        if len(news):
            held = np.array([r[0] for r in self.recent.get()], np.float64)
            x = news["at_value"].to_numpy(np.float64)
            means, total, weight = prior_ewm_values(x, self.decay, total, weight)
            series = np.concatenate((held, x))
            yield self._out(key, news[self.id], means, np.arange(seen, seen + len(x)), prior_window_means(series, len(held), self.window))
            newest = (plain(news["at_us"].iloc[-1]), plain(news[self.id].iloc[-1]))
            self.now.update((float(total), float(weight), seen + len(x), *newest))
            self.recent.put([(float(v),) for v in series[-self.window:]])
            if self.idle_ms is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(newest[0] // 1000 + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, weight, seen, _, last_id = self.now.get()
        held = [r[0] for r in self.recent.get()]
        self.now.clear()
        self.recent.clear()
        window = prior_window_means(np.array([*held, np.nan]), len(held), self.window)
        yield self._out(key, [last_id], total / weight if weight > 0 else np.nan, [seen], window, closed=True)

    def close(self) -> None:
        pass

    def _out(self, key: tuple, ids, means=np.nan, seen=None, window=np.nan, late: bool = False, closed: bool = False) -> pd.DataFrame:
        return pd.DataFrame({
            self.entity: [key[0]] * len(ids), self.id: list(ids), "prior_mean": means, "prior_rows": pd.array([None] * len(ids) if seen is None else seen, "Int64"),
            "recent_mean": window, "late": late, "closed": closed})


def plain(value):
    """A pandas cell as the Python value that state takes."""
    return value.item() if isinstance(value, np.generic) else value


def prior_ewm_values(x: np.ndarray, decay: float, total: float, weight: float) -> tuple[np.ndarray, float, float]:
    """Decayed mean before each value (missing ones only age the rest), and the sum and weight after them all."""
    out = np.empty(len(x))
    for at in range(0, len(x), FOLD_ROWS):
        part = x[at:at + FOLD_ROWS]
        n = len(part)
        known = ~np.isnan(part)
        up = decay ** -np.arange(n)
        sums = np.concatenate(([total], total + np.cumsum(np.where(known, part, 0.0) * up)))
        weights = np.concatenate(([weight], weight + np.cumsum(known * up)))
        with np.errstate(invalid="ignore", divide="ignore"):
            out[at:at + n] = np.where(weights[:-1] > 0, sums[:-1] / weights[:-1], np.nan)
        total, weight = sums[-1] * decay ** n, weights[-1] * decay ** n
    return out, total, weight


def prior_window_means(series: np.ndarray, start: int, window: int) -> np.ndarray:
    """Mean of the up to ``window`` values before each place from ``start`` on, missing ones left out."""
    known = ~np.isnan(series)
    sums = np.concatenate(([0.0], np.cumsum(np.where(known, series, 0.0))))
    counts = np.concatenate(([0], np.cumsum(known)))
    at = np.arange(start, len(series))
    low = np.maximum(at - window, 0)
    n = counts[at] - counts[low]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, (sums[at] - sums[low]) / n, np.nan)


def prior_state_stream(events: DataFrame, entity: str, time: str, id: str, metric: str, halflife: float,
                       window: int = 22, idle_ms: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """Per event what was known of its entity before it, kept between arrivals: ``prior_mean`` (decayed),
    ``prior_rows`` and ``recent_mean`` (over the last ``window`` rows).

    Rows are ordered by (time, id). A row at or before the entity's newest one in that order is
    ``late``: it comes out flagged, without values, and leaves the state alone (the batch build
    corrects it). With ``idle_ms`` an entity whose newest row is older than that by the clock of the
    stream's times (its watermark, ``delay`` behind the newest time of all) comes out once more,
    ``closed``, with its newest id and what its next row would have known, and is forgotten.
    State per entity is a few numbers and one window; a task sees the numbers of an
    entity's rows in one micro-batch, which the source's trigger limit bounds.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    out = (f"`{entity}` {types[entity]}, `{id}` {types[id]}, prior_mean double, prior_rows bigint, recent_mean double, "
           "late boolean, closed boolean")
    if idle_ms is not None:
        events = events.withWatermark(time, delay)
    # column names reach the processor only without a leading underscore
    rows = events.select(entity, id, F.unix_micros(time).alias("at_us"), F.col(metric).cast("double").alias("at_value"))
    state = PriorState(entity, id, types[id], halflife, window, idle_ms)
    return rows.groupBy(entity).transformWithStateInPandas(state, out, "Append", "None" if idle_ms is None else "EventTime")


def append_states(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append states to ``target``, late rows into a side folder of their own (``late=true``); a batch that
    is replayed after a failure replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{target}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).outputMode("append").start())
