"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are stored as shards of bounded size, each with a tree of balls (centre and
radius). For a query no vector in a ball scores above q.centre + |q| * radius; nodes
are taken in order of that bound and left out once it is below the query's k-th best
score. A block of queries goes down a tree together: bounds and scores are matrix products. Queries go to the shards in blocks of bounded size, in two passes: first each
query visits its most promising shard, which gives a k-th score that the second pass
hands to all shards; within a task it rises from shard to shard.

Components become floor(scale * x), so scores are whole numbers and exact. They are
multiplied as doubles while those are exact, else as integers of any size.

Cases: vectors that are null, or hold null or non-finite components, take no part; a
query meets vectors of its own length only; equal vectors are separate candidates,
ties go to the smaller id; rows with the query's id aren't its candidates; an empty
vector scores 0; empty tables give no rows. Scaled components beyond 2^53 are rounded to doubles;
a score beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from foretime.llm.common import stored

SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK = 4096, 64, 4096
EXACT = 2.0 ** 53


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v) with whole components; unusable rows are left out."""
    v = F.col(vector).cast("array<double>")
    return vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).select(
        "id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


def grow(points: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int, float]], np.ndarray]:
    """Order of the rows, nodes (first, after, left, right, radius) and centres of a ball tree."""
    order, nodes, centres = np.arange(len(points)), [], []

    def node(first: int, after: int) -> int:
        rows = points[order[first:after]]
        centre = rows.mean(axis=0)
        away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        me = len(nodes)
        nodes.append([first, after, -1, -1, float(away.max(initial=0.0))])
        centres.append(centre)
        if after - first > LEAF_ROWS and nodes[me][4] > 0:
            a = rows[away.argmax()]
            b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
            side = rows @ (b - a)
            half = (after - first) // 2
            order[first:after] = order[first:after][np.argpartition(side, half)]
            nodes[me][2] = node(first, first + half)
            nodes[me][3] = node(first + half, after)
        return me

    if len(points):
        node(0, len(points))
    return order, [tuple(n) for n in nodes], np.array(centres)


NODE = np.dtype([("first", "<i4"), ("after", "<i4"), ("left", "<i4"), ("right", "<i4"), ("radius", "<f8")])
SHARD = "shard long, dim int, ids binary, vectors binary, nodes binary, centres binary"


def build_shards(points: DataFrame) -> DataFrame:
    """Stored shards of at most SHARD_ROWS vectors of one length, each with its tree."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 32, 0
        waiting: dict[int, tuple[list, list]] = {}

        def close(dim: int) -> pa.RecordBatch:
            nonlocal n
            ids, rows = waiting.pop(dim)
            rows = np.array(rows, np.float64).reshape(len(ids), dim)
            order, nodes, centres = grow(rows)
            n += 1
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([part + n - 1], pa.int64()), "dim": pa.array([dim], pa.int32()), "ids": [np.array(ids, np.int64)[order].tobytes()], "vectors": [rows[order].tobytes()],
                "nodes": [np.array(nodes, NODE).tobytes()], "centres": [centres.tobytes()]})

        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                ids, rows = waiting.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) >= SHARD_ROWS:
                    yield close(len(v))
        for dim in list(waiting):
            yield close(dim)

    return stored(points.mapInArrow(shards, SHARD), "balls")


class Shard:
    def __init__(self, dim: int, ids: bytes, vectors: bytes, nodes: bytes, centres: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.rows = np.frombuffer(vectors, np.float64).reshape(len(self.ids), dim)
        self.nodes = np.frombuffer(nodes, NODE)
        self.centres = np.frombuffer(centres, np.float64).reshape(len(self.nodes), dim)
        self.reach = float(np.abs(self.rows).max(initial=0.0))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, nodes): no vector below a node scores more; a child's bound is at most its parent's."""
        b = q @ self.centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * self.nodes["radius"]
        b += np.abs(b) * 1e-9 + 1e-6 * (1 + self.reach)  # what rounding may take off
        for n, (left, right) in enumerate(zip(self.nodes["left"].tolist(), self.nodes["right"].tolist(), strict=True)):
            if left >= 0:
                b[:, [left, right]] = np.minimum(b[:, [left, right]], b[:, [n]])
        return b

    def scores(self, q: np.ndarray, first: int, after: int) -> np.ndarray:
        """(queries, rows first to after), exact."""
        rows = self.rows[first:after]
        large = q.shape[1] * self.reach * np.abs(q).max(axis=1, initial=0.0) >= EXACT
        if not large.any():
            return (q @ rows.T).astype(np.int64)
        out = np.empty((len(q), len(rows)), np.int64)
        out[~large] = (q[~large] @ rows.T).astype(np.int64)
        for n in np.flatnonzero(large):
            whole = [int(x) for x in q[n]]
            out[n] = [sum(int(x) * y for x, y in zip(r, whole, strict=True)) for r in rows]
        return out

    def search(self, q: np.ndarray, who: np.ndarray, best: "Best") -> None:
        """Add to ``best`` what belongs to the k best of the queries ``who``, whose vectors are ``q``.

        Each query takes its leaves in order of their bounds, in rounds of 1, 2, 4 ... leaves,
        until the next bound is under its k-th score; in a round a leaf meets its queries at once."""
        if not len(self.ids) or not len(who):
            return
        leaves = np.flatnonzero(self.nodes["left"] < 0)
        bounds = self.bounds(q)[:, leaves]
        order = np.argsort(-bounds, axis=1, kind="stable")
        done, step, rows = 0, 1, np.arange(len(who))
        while done < len(leaves) and len(rows):
            at = order[rows, done:done + step]
            wanted = bounds[rows[:, None], at] >= best.floor[who[rows], None]
            rows, at, wanted = (x[wanted[:, 0]] for x in (rows, at, wanted))  # bounds fall along a row
            found: list[tuple[np.ndarray, ...]] = []
            for leaf in np.unique(at[wanted]).tolist():
                these = rows[((at == leaf) & wanted).any(axis=1)]
                first, after = int(self.nodes["first"][leaves[leaf]]), int(self.nodes["after"][leaves[leaf]])
                scores, ids = self.scores(q[these], first, after), self.ids[first:after]
                n, j = np.nonzero((scores >= best.floor[who[these], None]) & (ids != best.own[who[these], None]))
                found.append((who[these[n]], scores[n, j], ids[j]))
            if found:
                best.add(*map(np.concatenate, zip(*found, strict=True)))
            done, step = done + step, 2 * step


class Best:
    """The k best (score, id) of each query so far, and the score under which nothing belongs to them."""

    def __init__(self, own: np.ndarray, k: int, least: np.ndarray):
        self.own, self.k, self.least, self.floor = own, k, least, least.copy()
        self.n = np.zeros(len(own), np.int64)
        self.score, self.id = np.zeros((len(own), k), np.int64), np.zeros((len(own), k), np.int64)

    def forget(self, who: np.ndarray) -> None:
        self.n[who], self.floor[who] = 0, self.least[who]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        known = np.unique(query)
        n, j = np.nonzero(np.arange(self.k) < self.n[known, None])
        query, score, ids = (np.concatenate(x) for x in (
            (known[n], query), (self.score[known[n], j], score), (self.id[known[n], j], ids)))
        order = np.lexsort((ids, ~score, query))
        query, score, ids = query[order], score[order], ids[order]
        _, start, count = np.unique(query, return_index=True, return_counts=True)
        rank = np.arange(len(query)) - np.repeat(start, count)
        keep = rank < self.k
        self.score[query[keep], rank[keep]], self.id[query[keep], rank[keep]] = score[keep], ids[keep]
        self.n[known] = np.minimum(count, self.k)
        full = known[count >= self.k]
        self.floor[full] = np.maximum(self.least[full], self.score[full, self.k - 1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, j = np.nonzero(np.arange(self.k) < self.n[:, None])
        return n, self.id[n, j], self.score[n, j]


def visit(shards: DataFrame, block: list[tuple], k: int, least: dict[int, int] | None) -> DataFrame:
    """(query, id, score): candidates of the block's queries. Without ``least`` each query
    visits one shard per task, the one with the highest bound; with it, all shards."""
    own = np.array([q for q, _ in block], np.int64)
    by_length: dict[int, list[int]] = {}
    for n, (_, v) in enumerate(block):
        by_length.setdefault(len(v), []).append(n)
    asked = {d: (np.array(at), np.array([block[n][1] for n in at], np.float64).reshape(len(at), d)) for d, at in by_length.items()}
    low = np.full(len(block), np.iinfo(np.int64).min)
    for n, score in (least or {}).items():
        low[n] = score

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, top = Best(own, k, low), np.full(len(own), -np.inf)
        for b in batches:
            for j in range(b.num_rows):
                shard = Shard(*(b.column(c)[j].as_py() for c in ("dim", "ids", "vectors", "nodes", "centres")))
                if shard.rows.shape[1] not in asked:
                    continue
                who, q = asked[shard.rows.shape[1]]
                if least is None:
                    root = q @ shard.centres[0] + np.sqrt((q * q).sum(axis=1)) * shard.nodes["radius"][0]
                    better = root > top[who]
                    top[who[better]] = root[better]
                    who, q = who[better], q[better]
                    best.forget(who)
                shard.search(q, who, best)
        n, ids, scores = best.rows()
        if len(n):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (n, ids, scores)], names=["query", "id", "score"])

    return shards.mapInArrow(search, "query long, id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): per query row its k best candidates."""
    spark = vectors.sparkSession
    shards = build_shards(scaled(vectors, vec_id, vector, scale))
    asked = scaled(queries, vec_id, vector, scale)
    found: list[DataFrame] = []
    block: list[tuple] = []

    def answer() -> None:
        # a query's k-th score within one shard is a floor for its k-th score over all
        first = visit(shards, block, k, None)
        kth = W.partitionBy("query").orderBy(F.desc("score"), "id")
        floors = first.withColumn("r", F.row_number().over(kth)).where(F.col("r") == k).select("query", "score").collect()
        named = spark.createDataFrame([(n, q) for n, (q, _) in enumerate(block)], "n long, query_id long")
        best = visit(shards, block, k, {r.query: r.score for r in floors})
        best = best.withColumn("rank", F.row_number().over(kth)).where(F.col("rank") <= k)
        found.append(stored(best.join(F.broadcast(named), F.col("query") == F.col("n")).select(
            "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"), "nearest"))

    for row in asked.toLocalIterator():
        block.append((row.id, row.v))
        if len(block) >= QUERY_BLOCK:
            answer()
            block = []
    if block or not found:
        answer()
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
