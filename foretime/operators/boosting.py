"""Histogram gradient boosting for a 0/1 label, with missing values on a learned side.

Features are cut into bins once; the binned rows are stored. A wave of tree growth is one
job: each task scores its rows with the trees so far, adds up gradients, curvatures and counts
per (open node, feature, bin), and a grouped aggregate over the nodes sums them and returns
each node's best split, with the missing rows tried on either side. Only that one row a
node comes to the driver, whatever the table's size. Nodes are split by falling gain until the
tree has its leaves; the nodes that may come next are measured together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretime.session import written

MISSING = 255
#: Gains are compared to this many digits, so that the order of a sum doesn't choose a split.
GAIN_DIGITS = 9
ROOT = 0
SPLITS = "node int, feature int, bin int, missing_left boolean, gain double, gl double, hl double, nl long, gr double, hr double, nr long"


@dataclass(frozen=True)
class Growth:
    """How trees grow: steps of ``rate``, ``leaves`` a tree of at least ``leaf_rows`` rows, ``l2`` on leaf values."""

    rounds: int = 100
    rate: float = 0.1
    leaves: int = 31
    leaf_rows: int = 20
    l2: float = 0.0
    depth: int | None = None


@dataclass
class Node:
    depth: int
    g: float
    h: float
    n: int
    best: dict | None = None
    children: tuple[int, int] | None = None


@dataclass(frozen=True)
class Tree:
    """Parallel arrays over nodes; ``feature`` is -1 at a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Node in which each row of the binned matrix ends."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            b = x[rows, np.maximum(f, 0)]
            to_left = np.where(b == MISSING, self.missing_left[node], b <= self.bin[node])
            node = np.where(inner, np.where(to_left, self.left[node], self.right[node]), node)


def as_tree(nodes: list[Node], kept: set[int] | None, growth: Growth) -> Tree:
    """``nodes`` as arrays; only ``kept`` ones stay split (all that have children, if None)."""
    split = [n.children is not None and (kept is None or i in kept) for i, n in enumerate(nodes)]
    pick = lambda k, none: np.array([n.best[k] if s else none for n, s in zip(nodes, split, strict=True)])
    child = lambda side: np.array([n.children[side] if s else 0 for n, s in zip(nodes, split, strict=True)])
    value = np.array([-growth.rate * n.g / (n.h + growth.l2) if n.h + growth.l2 > 0 else 0.0 for n in nodes])
    return Tree(pick("feature", -1).astype(np.int64), pick("bin", 0).astype(np.int64), pick("missing_left", False).astype(bool), child(0), child(1), value)


def best_split(hist: np.ndarray, growth: Growth) -> dict | None:
    """Best cut of one feature: ``hist`` holds (g, h, n) rows per bin, the last bin the missing ones."""
    known, missing = np.cumsum(hist[:-1], axis=0), hist[-1]
    total = known[-1] + missing
    found = None
    for missing_left in (False, True):
        left = known + missing if missing_left else known
        right = total - left
        ok = (left[:, 2] >= growth.leaf_rows) & (right[:, 2] >= growth.leaf_rows) & (left[:, 1] + growth.l2 > 0) & (right[:, 1] + growth.l2 > 0)
        if not ok.any():
            continue
        part = lambda s: s[:, 0] ** 2 / np.where(ok, s[:, 1] + growth.l2, 1.0)
        gain = np.where(ok, np.round(part(left) + part(right) - total[0] ** 2 / (total[1] + growth.l2), GAIN_DIGITS), -np.inf)
        b = int(np.argmax(gain))
        if gain[b] > 0 and (found is None or (-gain[b], b, missing_left) < (-found["gain"], found["bin"], found["missing_left"])):
            (gl, hl, nl), (gr, hr, nr) = left[b], right[b]
            found = {"bin": b, "missing_left": missing_left, "gain": float(gain[b]), "gl": gl, "hl": hl, "nl": int(round(nl)), "gr": gr, "hr": hr, "nr": int(round(nr))}
    return found


@dataclass
class Boosted:
    """Fitted trees; ``transform`` adds a ``probability`` vector as other models do."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    growth: Growth
    trees: list[Tree] = field(default_factory=list)
    splits: list[list[dict]] = field(default_factory=list)

    def binned(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(values.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(values[:, j]), MISSING, np.searchsorted(e, values[:, j], "left"))
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.leaf_of(x)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        @F.pandas_udf("array<double>")
        def both(cols: pd.DataFrame) -> pd.Series:
            p = 1 / (1 + np.exp(-self.raw(self.binned(cols.to_numpy(np.float64)))))
            return pd.Series(list(np.stack([1 - p, p], axis=1)))

        cols = F.struct(*[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(self.features)])
        return df.withColumn("probability", array_to_vector(both(cols)))

    def importance(self) -> dict[str, float]:
        """Gain of all splits of each feature."""
        out = dict.fromkeys(self.features, 0.0)
        for s in (s for tree in self.splits for s in tree):
            out[self.features[s["feature"]]] += s["gain"]
        return out


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = MISSING, exact: bool = False) -> list[np.ndarray]:
    """Upper edges of the bins of each feature, at even shares of its known values: approximate
    quantiles from one pass over all features, or exact ones."""
    shares = [i / bins for i in range(1, bins)]
    cut = (lambda c: F.percentile(c, shares)) if exact else (lambda c: F.percentile_approx(c, shares, 10_000))
    row = df.agg(*[cut(F.col(c).cast("double")).alias(f"c{j}") for j, c in enumerate(features)]).first()
    return [np.unique(np.array(row[f"c{j}"] or [], np.float64)) for j in range(len(features))]


def fit(train: DataFrame, features: Sequence[str], label: str, growth: Growth = Growth(), edges: list[np.ndarray] | None = None) -> Boosted:
    """Trees over all rows of ``train`` that have a label."""
    train = train.where(F.col(label).isNotNull())
    y = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("s")).first()
    n, ones = y["n"], float(y["s"] or 0.0)
    model = Boosted(list(features), bin_edges(train, features) if edges is None else edges, float(np.log(ones / (n - ones))) if 0 < ones < n else 0.0, growth)
    if not 0 < ones < n:
        return model
    cells = F.array(*[F.col(c).cast("double") for c in features])

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(features))
            x = model.binned(values)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column("y")], names=["x", "y"])

    rows = written(train.select(cells.alias("v"), F.col(label).cast("double").alias("y")).mapInArrow(to_bins, "x binary, y double"))
    for _ in range(growth.rounds):
        tree, splits = _grow(rows, model)
        if not splits:
            break
        model.trees.append(tree)
        model.splits.append(splits)
    return model


def _measure(rows: DataFrame, model: Boosted, nodes: list[Node], wanted: list[int]) -> dict[int, dict]:
    """Best split of each wanted node, which end the tree as it is."""
    growth, width = model.growth, len(model.features)
    tree = as_tree(nodes, None, growth)
    size = width * (MISSING + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {w: np.zeros((3, size)) for w in wanted}
        for b in batches:
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(-1, width)
            p = 1 / (1 + np.exp(-model.raw(x)))
            g, h, at = p - b.column("y").to_numpy(), p * (1 - p), tree.leaf_of(x)
            for w in wanted:
                mine = at == w
                cell = (x[mine] + np.arange(width) * (MISSING + 1)).ravel()
                for k, weight in enumerate((g[mine], h[mine], np.ones(mine.sum()))):
                    sums[w][k] += np.bincount(cell, np.repeat(weight, width), size)
        for w, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["node", "hist"])

    def split(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 * size)
        for b in batches:
            for h in b.column("hist"):
                total += np.frombuffer(h.as_buffer())
        per = total.reshape(3, width, MISSING + 1).transpose(1, 2, 0)
        found = [{"node": key[0].as_py(), "feature": f, **best} for f, h in enumerate(per) if (best := best_split(h, growth))]
        found = sorted(found, key=lambda r: (-r["gain"], r["feature"]))[:1]
        yield pa.RecordBatch.from_pylist(found, schema=SPLIT_SCHEMA)

    found = rows.mapInArrow(partial, "node int, hist binary").groupBy("node").applyInArrow(split, SPLITS).collect()
    return {r["node"]: r.asDict() for r in found}


SPLIT_SCHEMA = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("missing_left", pa.bool_()), ("gain", pa.float64()),
                          ("gl", pa.float64()), ("hl", pa.float64()), ("nl", pa.int64()), ("gr", pa.float64()), ("hr", pa.float64()), ("nr", pa.int64())])


def _grow(rows: DataFrame, model: Boosted) -> tuple[Tree, list[dict]]:
    """One tree, and its splits in the order in which they were made."""
    growth = model.growth
    nodes = [Node(0, 0.0, 0.0, 0)]

    def measure(wanted: list[int]) -> None:
        fits = [w for w in wanted if w == ROOT or nodes[w].n >= 2 * growth.leaf_rows and (growth.depth is None or nodes[w].depth < growth.depth)]
        for w, best in (_measure(rows, model, nodes, fits) if fits else {}).items():
            nodes[w].best = best

    measure([ROOT])
    leaves, kept, splits = {ROOT}, set(), []
    while len(leaves) < growth.leaves:
        open_ = sorted((i for i in leaves if nodes[i].best), key=lambda i: (-nodes[i].best["gain"], i))
        if not open_:
            break
        pick = open_[0]
        if nodes[pick].children is None:
            fresh = []
            for i in [i for i in open_ if nodes[i].children is None][:growth.leaves - len(leaves)]:
                b, d = nodes[i].best, nodes[i].depth + 1
                nodes[i].children = (len(nodes), len(nodes) + 1)
                fresh += nodes[i].children
                nodes += [Node(d, b["gl"], b["hl"], b["nl"]), Node(d, b["gr"], b["hr"], b["nr"])]
            measure(fresh)
        leaves = leaves - {pick} | set(nodes[pick].children)
        kept.add(pick)
        splits.append({**nodes[pick].best, "node": pick, "depth": nodes[pick].depth, "children": nodes[pick].children})
    return as_tree(nodes, kept, growth), splits


def boosting(growth: Growth = Growth(), **changed):
    """A fit for the season-ordered operators."""
    growth = replace(growth, **changed)
    return lambda train, features, label: fit(train, features, label, growth)
