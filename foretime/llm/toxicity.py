"""Severity of toxic language by cumulative-link ordinal regression.

One weight vector over hashed text features is shared by ordered thresholds:
P(severity > k) = 1 / (1 + exp(t_k - w.x)). Features are the distinct words of a
text, lower-cased, and the first four and five letters of longer words; a feature
counts once however often it occurs, and an L1 penalty leaves few weights. The
expected severity is the sum of P(severity > k) over the thresholds.

The fit sees at most ``fit_rows`` labelled documents of either label, chosen by a
hash of their ids; everything else covers all rows. Two-valued labels are graded
first: within the toxic rows of the sample, by thirds of the number of distinct
features that are at least ``lift`` times as frequent in toxic as in other rows.

Cases: null and empty texts have no features and get the clean side's severity;
labelled ids without text and rows without a label are left out of the fit; a
sample without both labels gives a model that calls nothing toxic; equal rows are
scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretime.llm.common import low_words, rows_of, with_text

BITS = 18
#: Probability from which a severity counts as reached.
CUT = 0.3
#: Distinct words whose features or scores a worker remembers.
REMEMBERED = 200_000


def features_of(word: bytes) -> tuple[int, ...]:
    text = word.decode("utf-8", "replace")
    names = [b"w" + word]
    names += [b"p%d" % n + text[:n].encode() for n in (4, 5) if len(text) >= n + 1]
    return tuple(zlib.crc32(x) & ((1 << BITS) - 1) for x in names)


@dataclass
class Ordinal:
    """Weights by feature and rising thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(severity > k), one column per threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))

    def severity(self, score: np.ndarray, cut: float) -> np.ndarray:
        """Thresholds passed with more than ``cut``; none where no feature speaks for any."""
        return ((self.above(score) > cut) & (score > 0)[:, None]).sum(axis=1)

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, row_weights: np.ndarray, n_grades: int, l1: float = 5e-4, epochs: int = 24,
            rate: float = 0.3, batch: int = 128, seed: int = 1) -> "Ordinal":
        """Adagrad with soft thresholding on the log likelihood of the grades."""
        rng = np.random.default_rng(seed)
        w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
        share = np.array([(row_weights * (grades > k)).sum() for k in range(n_grades - 1)]) / row_weights.sum()
        share = np.clip(share, 1e-4, 1 - 1e-4)
        theta, t2 = np.log(1 / share - 1) + 1e-3 * np.arange(n_grades - 1), np.full(n_grades - 1, 1e-3)
        sizes = np.array([len(r) for r in rows])
        sums = [np.zeros(1 << BITS), np.zeros(n_grades - 1)]
        for epoch in range(epochs):
            for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                idx = np.concatenate([rows[i] for i in at]) if len(at) else np.empty(0, np.int64)
                owner = np.repeat(np.arange(len(at)), sizes[at])
                score = np.bincount(owner, w[idx], len(at))
                edges = np.concatenate(([-np.inf], theta, [np.inf]))
                y, rw = grades[at], row_weights[at] / max(len(at), 1)
                high, low = (1 / (1 + np.exp(np.clip(score - e, -50, 50))) for e in (edges[y + 1], edges[y]))
                p = np.maximum(high - low, 1e-9)
                d = rw * (1 - high - low)  # of minus the log likelihood, by the score
                grad = np.bincount(idx, d[owner], 1 << BITS)
                g2 += grad ** 2
                step = rate / np.sqrt(g2)
                w = w - step * grad
                w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
                dt = np.zeros(n_grades - 1)
                np.add.at(dt, np.minimum(y, n_grades - 2), -np.where(y < n_grades - 1, rw * high * (1 - high) / p, 0))
                np.add.at(dt, np.maximum(y - 1, 0), np.where(y > 0, rw * low * (1 - low) / p, 0))
                t2 += dt ** 2
                theta = np.maximum.accumulate(theta - 0.1 * dt / np.sqrt(t2) * 0.3 + 1e-6 * np.arange(n_grades - 1))
            if epoch >= epochs // 2:
                sums = [sums[0] + w, sums[1] + theta]
        # the mean over the later epochs; weights that are seldom other than zero are none
        w, theta = (x / (epochs - epochs // 2) for x in sums)
        return cls(np.where(np.abs(w) > 1e-2, w, 0).astype(np.float32), theta)


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray, levels: int, lift: float) -> np.ndarray:
    """0 for rows that aren't toxic, else 1..levels by the number of tell-tale features."""
    hit = np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(toxic)]), minlength=1 << BITS) / max(1, toxic.sum())
    miss = np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(~toxic)]), minlength=1 << BITS) / max(1, (~toxic).sum())
    tell = (hit > 0.002) & (hit > lift * miss)
    found = np.array([tell[r].sum() for r in rows])
    cuts = np.quantile(found[toxic], np.arange(1, levels) / levels)
    return np.where(toxic, 1 + np.searchsorted(cuts, found, "left"), 0).astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, fit_rows: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features, labels and row weights (which restore the labels' shares) of the bounded sample."""
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(F.col(doc_id).alias("id"), (F.col(label) > 0).alias("toxic"))
    rows = rows.groupBy("id").agg(F.max("toxic").alias("toxic"))
    shares = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for value in (True, False):
        part = rows.where(F.col("toxic") == value).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # the order of the sample is the rows' own, whatever the partitions: the fit depends on it
    texts = with_text(docs, text).select(F.col(doc_id).alias("d"), F.col(text).alias("text"), F.xxhash64(doc_id).alias("place"), F.xxhash64(text).alias("tie"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.unique(np.array([f for w in set(low_words(t)) for f in features_of(w)], np.int32)).tobytes() for t, in rows_of([b], "text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("toxic", "place", "tie")), pa.array(out, pa.binary())], names=["toxic", "place", "tie", "features"])

    got = (texts.join(chosen, F.col("d") == F.col("id")).select("toxic", "place", "tie", "text").where(F.col("text").isNotNull())
           .mapInArrow(featured, "toxic boolean, place long, tie long, features binary").orderBy("place", "tie", "features").limit(2 * fit_rows).collect())
    toxic = np.array([r.toxic for r in got], bool)
    n = {v: max(1, (toxic == v).sum()) for v in (True, False)}
    weight = {v: shares.get(v, 0) / n[v] for v in n}
    row_weights = np.array([weight[bool(v)] for v in toxic])
    return [np.frombuffer(r.features, np.int32) for r in got], toxic, row_weights / (row_weights.mean() if len(got) else 1)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = 6000,
        levels: int = 3, lift: float = 8.0) -> Ordinal:
    rows, toxic, row_weights = sample(docs, labels, doc_id, text, label, fit_rows)
    if not toxic.any() or toxic.all():
        return Ordinal(np.zeros(1 << BITS, np.float32), np.full(levels, 50.0))
    return Ordinal.fit(rows, severity_grades(rows, toxic, levels, lift), row_weights, levels + 1)


class Scorer:
    """Sums weights over the distinct features of a text. Words all of whose features
    weigh nothing are told by one lookup."""

    def __init__(self, model: Ordinal):
        self.model, self.known = model, {}

    def score(self, text: str | None) -> float:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, w = self.known, self.model.weights
        words = set(low_words(text))
        for x in words.difference(known):
            known[x] = tuple(f for f in features_of(x) if w[f])
        found = set()
        for f in filter(None, map(known.__getitem__, words)):
            found.update(f)
        return float(sum(w[f] for f in found))


def scored(docs: DataFrame, model: Ordinal, doc_id: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """(id, severity: thresholds passed with more than ``cut``, expected_severity, p_toxic, toxic)."""
    rows = with_text(docs, text).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            score = np.array([scorer.score(t) for t, in rows_of([b], "text")], np.float64)
            p, severity = model.above(score), model.severity(score, cut)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(severity), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(severity > 0)],
                names=["id", "severity", "expected_severity", "p_toxic", "toxic"])

    return rows.mapInArrow(grade, f"id {kind}, severity long, expected_severity double, p_toxic double, toxic boolean").withColumnRenamed("id", doc_id)


def rejected(docs: DataFrame, model: Ordinal, text: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that the model calls toxic."""
    docs = with_text(docs, text)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            score = np.array([scorer.score(t) for t in b.column(at).to_pylist()], np.float64)
            yield b.filter(pa.array(model.severity(score, cut) == 0))

    return docs.mapInArrow(keep, docs.schema)
