"""Ordered rating fold over events that couple two entities.

A rating depends on both sides' earlier ratings, so no window over one entity can
express it. What an event has to wait for is only its two sides' previous events:
its level is one more than the larger level of those. Events of one level touch each
entity once, so a whole level is folded at once, with arrays.

Pools share no entity. A task streams the events of its pools in time order, block by
block, and holds one number per entity, however long a pool is. Across the pools of a task
and the entities of a pool the levels are few and wide; a pool is one task's work only
as far as its own events depend on each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretime.functions import fixed
from foretime.operators.prior import prior_value
from foretime.operators.sides import to_sides

#: Events of a stream whose levels are worked out together.
STEP_EVENTS = 8192


def gains(home: np.ndarray, away: np.ndarray, margin: np.ndarray, k: float, advantage: float) -> np.ndarray:
    """Points each home side gains; an event without a result moves none."""
    won = margin > 0
    lead = np.where(won, home - away, away - home)
    damp = fixed.RATING_MARGIN_DENOM / (fixed.RATING_MARGIN_SCALE * lead + fixed.RATING_MARGIN_DENOM)
    surprise = won - 1.0 / (1.0 + 10.0 ** ((away - home - advantage) / 400.0))
    return np.where(np.isnan(margin), 0.0, k * np.log(np.abs(margin) + 1.0) * damp * surprise)


def levels(home: np.ndarray, away: np.ndarray) -> Iterator[np.ndarray]:
    """Events, given in order by the numbers of their sides, level by level: those that
    wait for no event, then those that wait only for these, and so on."""
    n = len(home)
    sides, events = np.concatenate((home, away)), np.tile(np.arange(n), 2)
    order = np.lexsort((events, sides))
    sides, events = sides[order], events[order]
    # the next event of the same entity, for each side of each event
    linked = np.flatnonzero((sides[1:] == sides[:-1]) & (events[1:] != events[:-1]))
    before, after = events[linked], events[linked + 1]
    waits = np.bincount(after, minlength=n)
    by = np.argsort(before, kind="stable")
    after, first = after[by], np.searchsorted(before[by], np.arange(n + 1))
    ready = np.flatnonzero(waits == 0)
    while len(ready):
        yield ready
        runs = first[ready + 1] - first[ready]
        freed = after[np.repeat(first[ready] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())]
        np.subtract.at(waits, freed, 1)
        ready = np.unique(freed[waits[freed] == 0])


class Ratings:
    """Ratings held by one task: an entity's number is its place in ``held``."""

    def __init__(self, k: float, start: float, advantage: float):
        self.k, self.start, self.advantage = k, start, advantage
        self.number: dict[str, int] = {}
        self.held = np.empty(0)

    def _numbers(self, keys: pa.Array) -> np.ndarray:
        coded = keys.dictionary_encode()
        known = [self.number.setdefault(x, len(self.number)) for x in coded.dictionary.to_pylist()]
        if len(self.number) > len(self.held):
            fresh = np.full(max(len(self.number), 2 * len(self.held)) - len(self.held), self.start)
            self.held = np.concatenate((self.held, fresh))
        return np.array(known, np.int64)[coded.indices.to_numpy()]

    def fold(self, home: pa.Array, away: pa.Array, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both sides' ratings before each event; the events' own results are taken in."""
        sides = self._numbers(pa.concat_arrays([home, away]))
        h, a = sides[:len(home)], sides[len(home):]
        before = np.empty((2, len(h)))
        for at in levels(h, a):
            x, y = self.held[h[at]], self.held[a[at]]
            before[0, at], before[1, at] = x, y
            gain = gains(x, y, margin[at], self.k, self.advantage)
            self.held[h[at]] = x + gain
            self.held[a[at]] = y - gain
        return before[0], before[1]


def _key(pool: Sequence[str], entity: str) -> Column:
    """An entity within its pool, as one string that no other can equal."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
             for c in (*map(F.col, pool), F.col(entity))]
    return F.concat(*parts)


def rating_fold(events: DataFrame, pool: Sequence[str], time: str, id: str, home: str, away: str,
                home_score: str, away_score: str, k: float = fixed.RATING_K,
                start: float = fixed.RATING_START, advantage: float = fixed.RATING_HOME_ADV,
                step_events: int = STEP_EVENTS) -> DataFrame:
    """One row per event: ``pool``, ``id``, ``home_pre``, ``away_pre``.

    Ties must be filtered out beforehand. Both ratings are read before the
    event's own result is folded in; an event without a result changes none.
    """
    pool = list(pool)
    keys = [f"_p{i}" for i in range(len(pool))]
    e = events.select(
        *[F.col(p).alias(k) for p, k in zip(pool, keys, strict=True)], F.col(time).alias("_time"), F.col(id).alias("_id"),
        F.col(home).alias("_home"), F.col(away).alias("_away"), (F.col(home_score) - F.col(away_score)).cast("double").alias("_margin"))
    kept = [*keys, "_id"]
    types = {f.name: f.dataType.simpleString() for f in e.schema}

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratings = Ratings(k, start, advantage)
        for whole in batches:
            for at in range(0, whole.num_rows, step_events):
                b = whole.slice(at, step_events)
                margin = b.column("_margin").to_numpy(zero_copy_only=False)
                pair = ratings.fold(b.column("_home"), b.column("_away"), margin)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, pair)], names=[*kept, "home_pre", "away_pre"])

    dealt = (e.repartition(*keys) if pool else e.coalesce(1)).sortWithinPartitions("_time", "_id")
    # an entity's string names its pool too: it is made where the rows are, not moved
    out = dealt.withColumns({side: _key(keys, side) for side in ("_home", "_away")}).mapInArrow(
        folded, ", ".join(f"{c} {types[c]}" for c in kept) + ", home_pre double, away_pre double")
    return out.select(*[F.col(f"_p{i}").alias(p) for i, p in enumerate(pool)], F.col("_id").alias(id), "home_pre", "away_pre")


def rating_after(ratings: DataFrame, events: DataFrame, id: str, home_score: str, away_score: str,
                 k: float = fixed.RATING_K, advantage: float = fixed.RATING_HOME_ADV) -> DataFrame:
    """Ratings after each event, recomputed as a pure expression of the ratings before it."""
    margin = F.col(home_score) - F.col(away_score)
    won = margin > 0
    lead = F.when(won, F.col("home_pre") - F.col("away_pre")).otherwise(
        F.col("away_pre") - F.col("home_pre"))
    damp = F.lit(fixed.RATING_MARGIN_DENOM) / (lead * fixed.RATING_MARGIN_SCALE + fixed.RATING_MARGIN_DENOM)
    expect = 1.0 / (1.0 + F.pow(F.lit(10.0), (
        F.col("away_pre") - F.col("home_pre") - advantage) / 400.0))
    gain = F.log(F.abs(margin) + 1.0) * damp * (won.cast("double") - expect) * k
    return ratings.join(events, id).withColumns({
        "home_post": F.col("home_pre") + gain, "away_post": F.col("away_pre") - gain})


def rating_audit(ratings: DataFrame, events: DataFrame, pool: Sequence[str], time: str, id: str,
                 home: str, away: str, home_score: str, away_score: str,
                 start: float = fixed.RATING_START) -> DataFrame:
    """Per entity and event: the rating it should have had, and what the table says.

    The expected value is the previous event's recomputed outcome, or ``start``
    for a first event.
    """
    after = rating_after(ratings.select(id, "home_pre", "away_pre"), events, id, home_score, away_score)
    rows = to_sides(after, [*pool, id, time],
                    {"entity": home, "pre": "home_pre", "post": "home_post"},
                    {"entity": away, "pre": "away_pre", "post": "away_post"})
    rows = prior_value(rows, [*pool, "entity"], [time, id], {"_prev": "post"})
    return rows.withColumn("expected", F.coalesce(F.col("_prev"), F.lit(start))).drop("_prev")


def latest_rating(audit: DataFrame, pool: Sequence[str], time: str, id: str) -> DataFrame:
    """Rating an open event of each entity starts from: the one after its last event."""
    return audit.groupBy(*pool, "entity").agg(
        F.max_by("post", F.struct(time, id)).alias("rating"))
