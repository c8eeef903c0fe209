"""Near-duplicates by DartMinHash signatures and banded joins.

A document is a weighted set: its five-word shingles with their counts. Over each
unit of weight of an element lies a line of ranks on which hashed darts land at
random, the same for every document that has that unit; a dart carries one of
``k`` coordinates. A signature keeps the earliest dart per coordinate. Two
signatures agree in a coordinate with the weighted Jaccard similarity as
probability. A document throws only darts up to a rank that its total weight sets,
about k (ln k + 4) of them however long it is, and on when a coordinate stays empty.

Equal texts are one class before anything is compared. Bands of signature values
deal classes into buckets; in a bucket the member that shares the most buckets is
compared with the others, by exact weighted Jaccard, and what is linked need not be
compared again. Members of buckets that still hold several components are ordered
shingle by shingle, the rarest among them first. Two similar sets share a shingle early in
both: of what comes before the first that they share, neither holds more than the
similarity leaves. Only pairs of different components with such a shingle are compared, so no
similar pair is lost and no task gathers a bucket.

Cases: texts without words (null, empty, marks alone) are similar to nothing; a text
of one to four words is one shingle; equal rows fall into one class; a tie between
class heads goes to the smallest id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from foretime.llm.common import Interned, arrow_rows, low_words, rows_of, sized_groups, stored, text_key, with_text
from foretime.llm.graph import components

#: Words per shingle, bands, values per band: a pair at 0.8 meets in a band with 0.99994.
SHINGLE, BANDS, ROWS = 5, 32, 6
GROUP_BYTES = 2 << 20
#: Pairs of sets per Arrow batch.
PAIR_ROWS = 100
#: Bounds on whole weights are computed in doubles.
EPS = 1e-6

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of each text's shingles, in order."""
    number, rows = Interned(), []
    for t in texts:
        w = low_words(t)
        rows.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
    word = np.fromiter((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in number), np.uint64, len(number))
    out = []
    for r in rows:
        h, n = word[r], max(1, len(r) - size + 1) if len(r) else 0
        total = np.zeros(n, np.uint64)
        for j in range(min(size, len(r))):
            total = (total * _C) + mixed_bits(h[j:j + n] + np.uint64(j))
        out.append(mixed_bits(total))
    return out


def darts(elements: np.ndarray, owner: np.ndarray, weights: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Earliest dart rank per document and coordinate; inf where a document has no weight.
    Weights may be fractions: a dart counts if it lies below the element's weight."""
    cells = np.ceil(weights).astype(np.int64)
    unit = np.repeat(np.arange(len(elements)), cells)
    a = np.arange(len(unit)) - np.repeat(np.cumsum(cells) - cells, cells)
    seed = mixed_bits(elements[unit] + a.astype(np.uint64) * _A)
    left = weights[unit] - a  # of this unit of the weight axis
    doc = owner[unit]
    total = np.bincount(owner, weights, n_docs)
    out = np.full(n_docs * k, np.inf)
    limit = np.zeros(n_docs)
    np.divide(np.log(k) + 4, total, out=limit, where=total > 0)
    open_docs = total > 0
    with np.errstate(over="ignore"):
        while open_docs.any():
            at = np.flatnonzero(open_docs[doc])
            s, rank, n = seed[at], np.zeros(len(at)), 0
            while len(at):
                x = mixed_bits(s + np.uint64(n) * _B)
                rank = rank - np.log((x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54) / k
                near = rank < limit[doc[at]]
                at, s, rank, x = at[near], s[near], rank[near], x[near]
                y = mixed_bits(x + _A)
                high = (y >> np.uint64(40)).astype(np.float64) * 2.0 ** -24
                hit = high < left[at]
                np.minimum.at(out, doc[at[hit]] * k + (y[hit] & np.uint64(0xFFFFFFFF)).astype(np.int64) % k, rank[hit])
                n += 1
            open_docs = np.isinf(out.reshape(n_docs, k)).any(axis=1) & (total > 0)
            limit[open_docs] *= 2
    return out.reshape(n_docs, k)


def band_keys(ranks: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = mixed_bits(ranks.view(np.uint64)).reshape(len(ranks), bands, rows)
    key = np.zeros(bits.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64) * _A
    for j in range(rows):
        key = mixed_bits(key + bits[:, :, j])
    return key.view(np.int64)


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two stored shingle sets."""
    (x, n), (y, m) = (_opened(v) for v in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(n[i], m[j]).sum()
    return float(both / (n.sum() + m.sum() - both)) if len(x) or len(y) else 0.0


def _opened(v: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(v) // 12
    return np.frombuffer(v, np.uint64, half), np.frombuffer(v, np.uint32, half, 8 * half).astype(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """(id, tkey, content, size, bands) per row; content and bands are null without words."""
    docs = with_text(docs, text).select(F.col(doc_id).alias("id"), text_key(text).alias("tkey"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for group in sized_groups(rows_of([b], "text"), 0, GROUP_BYTES):
                sets = shingles([t for t, in group])
                content = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                pairs = [counted(s) for s in sets]
                elements = np.concatenate([x for x, _ in pairs])
                owner = np.repeat(np.arange(len(pairs)), [len(x) for x, _ in pairs])
                ranks = darts(elements, owner, np.concatenate([n for _, n in pairs]).astype(np.float64), len(pairs), bands * rows)
                keys = band_keys(ranks, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(at, len(group)), b.column("tkey").slice(at, len(group)), pa.array(content, pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array([k if len(s) else None for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64()))], names=["id", "tkey", "content", "size", "bands"])
                at += len(group)

    return stored(docs.mapInArrow(sign, f"id {kind}, tkey long, content binary, size long, bands array<long>"), "signatures")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the wanted nodes' texts; ``docs`` has id, tkey and text."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for group in sized_groups(rows_of([b], "text"), 0, GROUP_BYTES):
                sets = [counted(s) for s in shingles([t for t, in group])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("node").slice(at, len(group)), pa.array([x.tobytes() + n.astype(np.uint32).tobytes() for x, n in sets], pa.binary())], names=["node", "set"])
                at += len(group)

    heads = wanted.select("node", F.col("head.id").alias("i"), F.col("head.tkey").alias("t"))
    rows = docs.join(heads, F.col("id").eqNullSafe(F.col("i")) & (F.col("tkey") == F.col("t"))).select("node", "text")
    return rows.mapInArrow(collect, "node long, set binary").dropDuplicates(["node"])


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    return stored(shingle_sets(docs, wanted.join(nodes.select("node", "head"), "node")), "shingles")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``sets`` are similar enough, with the similarity."""
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([similarity(x, y) for x, y in rows_of([b], "x", "y")], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(s)], names=["a", "b", "similarity"]).filter(pa.array(s >= least))

    with arrow_rows(pairs.sparkSession, PAIR_ROWS):
        return stored(rows.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, similarity double"), "links")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, tkey, class_id, class_tkey, n_compared_links, n_copies), one row per row of ``docs``.

    ``class_id`` is the smallest id of the class (its head), ``n_copies`` the rows of equal text.
    ``n_compared_links`` counts the different texts found similar to this one by comparison; texts that are
    already in one class aren't compared, so it isn't the number of similar texts."""
    docs = with_text(docs, text)
    signed = signatures(docs, doc_id, text, bands, rows)
    texts = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("tkey"), F.col(text).alias("text"))
    nodes = signed.where("content is not null").groupBy("content").agg(
        F.min(F.struct("id", "tkey")).alias("head"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n_copies"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = linked(nodes, texts, least)
    labels = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("n_compared_links"))
    placed = nodes.join(labels.withColumnRenamed("node", "l"), F.col("node") == F.col("l"), "left").withColumn("label", F.coalesce("label", "node")).drop("l")
    heads = placed.groupBy("label").agg(F.min("head").alias("class"))
    placed = placed.join(heads, "label").join(degree, F.col("node") == F.col("n"), "left").select(
        F.col("content").alias("c"), "class", "n_copies", F.coalesce("n_compared_links", F.lit(0)).alias("n_compared_links"))
    out = signed.join(placed, F.col("content") == F.col("c"), "left")
    own = F.col("class").isNull()
    return out.select(F.col("id").alias(doc_id), "tkey", F.when(own, F.col("id")).otherwise(F.col("class.id")).alias("class_id"),
                      F.when(own, F.col("tkey")).otherwise(F.col("class.tkey")).alias("class_tkey"),
                      F.coalesce("n_compared_links", F.lit(0)).cast("long").alias("n_compared_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def leading(sets: DataFrame, least: float) -> DataFrame:
    """(node, element, before) of the shingles that may be the first shared with a similar set, in the order
    of rarity among ``sets``: the weight before it is at most what the similarity leaves of the whole."""

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, held in rows_of([b], "node", "set"):
                x, n = _opened(held)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), node)), pa.array(x.view(np.int64)), pa.array(n)], names=["node", "element", "n"])

    rows = stored(sets.mapInArrow(elements, "node long, element long, n long"), "elements")
    several = rows.groupBy("element").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = rows.join(several, "element", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    own = W.partitionBy("node")
    before = F.sum("n").over(own.orderBy("c", "element").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    rows = rows.withColumns({"before": before, "total": F.sum("n").over(own)})
    return rows.where((F.col("c") > 1) & (F.col("before") <= F.lit(1 - least) * F.col("total") + EPS)).select("node", "element", "before")


def may_reach(size: str, before: str, other: Column, least: float) -> Column:
    """Whether what is not ``before`` the first shared shingle suffices beside a set of size ``other``."""
    return F.col(size) - F.col(before) + EPS >= F.lit(least / (1 + least)) * (F.col(size) + other)


def rare_pairs(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): a superset of the pairs of ``members`` (node, size, label) with different labels that are similar enough."""
    rows = leading(sets, least).join(members, "node")
    smallest = rows.groupBy("element").agg(F.min("size").alias("s"))
    nearest = F.greatest(F.col("s"), F.lit(least) * F.col("size"))
    rows = stored(rows.join(smallest, "element").where(may_reach("size", "before", nearest, least)).drop("s"), "leading")
    # pairs within an element's most frequent label needn't be formed
    counts = rows.groupBy("element", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("element").agg(
        F.max_by("label", F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("element", "most")
    few = rows.join(counts, "element").where("label <> most").drop("most")
    few = few.select("element", *[F.col(c).alias(f"{c}_x") for c in ("node", "size", "label", "before")])
    alike = may_reach("size", "before", F.col("size_x"), least) & may_reach("size_x", "before_x", F.col("size"), least)
    near = F.least("size", "size_x") >= F.lit(least) * F.greatest("size", "size_x") - EPS
    return few.join(rows, "element").where((F.col("label") != F.col("label_x")) & near & alike).select(
        F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")).distinct()


def linked(nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b) that join all nodes which share a bucket and are similar."""
    rows = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(rows.join(counts, "bucket"), "buckets")
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    state = stored(members.join(score, "node").select("bucket", "node", "size", "score"), "buckets")
    heads = stored(state.groupBy("bucket").agg(F.max(F.struct("score", "node", "size")).alias("h")).select(
        "bucket", F.col("h.node").alias("hub"), F.col("h.size").alias("hub_size")), "hubs")
    # no similarity exceeds the smaller weight's share of the larger
    alike = F.least("size", "hub_size") >= F.lit(least) * F.greatest("size", "hub_size")
    pairs = stored(state.join(heads, "bucket").where(alike & F.expr("node <> hub")).select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = verified(pairs, sets_of(named, nodes, texts), least)
    rest = state.join(heads.select("bucket", F.col("hub").alias("node")), ["bucket", "node"], "left_anti").join(
        components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = rest.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    open_ = stored(rest.join(several, "bucket", "left_semi").select("node", "size", "label").distinct(), "open")
    if open_.isEmpty():
        return links
    sets = sets_of(open_.select("node"), nodes, texts)
    more = stored(rare_pairs(open_, sets, least).join(pairs, ["a", "b"], "left_anti"), "pairs")
    return links.unionByName(verified(more, sets, least))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each class: its head, once."""
    docs = with_text(docs, text)
    heads = classes(docs, doc_id, text, **how).where(F.col(doc_id).eqNullSafe(F.col("class_id")) & (F.col("tkey") == F.col("class_tkey")))
    heads = stored(heads.select(F.col(doc_id).alias("__near_id"), F.col("tkey").alias("__near_key")).distinct(), "heads")
    rows = docs.withColumn("__near_key", text_key(text))
    kept = rows.join(heads, F.col(doc_id).eqNullSafe(F.col("__near_id")) & (rows["__near_key"] == heads["__near_key"]), "left_semi")
    return kept.dropDuplicates([doc_id, "__near_key"]).select(*docs.columns)
