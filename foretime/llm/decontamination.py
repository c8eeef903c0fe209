"""Benchmark decontamination by a positional inverted index of the training tokens.

``build_index`` stores, per block of documents, the postings of every term: the
positions at which it stands. A query takes the lists of a phrase's terms from the
rarest on, shifts each by the term's place in the phrase and intersects them, so
that common terms are only looked up at the few places still open. Blocks hold
whole documents, so every block answers alone; test items are given to all blocks
in chunks of bounded size, one pass over the index for each chunk.

Cases: null and empty texts have no words and no hits; a word of any length is one
term; equal items are separate items with the same hits; rows with equal ids stay
separate rows; an item without words never occurs; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretime.llm.common import Interned, low_words, sized_groups, stored, with_text

#: Text bytes per block of the index; windows of test items per pass.
BLOCK_BYTES = 4 << 20
CHUNK_WINDOWS = 200_000

HITS = "array<struct<item:string,first:int,after:int>>"


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored postings, one row per block: ids and word offsets of its documents, its
    terms, and for each term the run of ``positions`` from ``starts`` on."""
    docs = with_text(docs, text).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, doc_starts binary, terms binary, starts binary, positions binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        n = 0
        for b in batches:
            ids, at = b.column("id"), 0
            for group in sized_groups(((t,) for t in b.column("text").to_pylist()), 0, BLOCK_BYTES):
                yield pa.RecordBatch.from_pydict(
                    {"block": [base + n], "ids": pa.ListArray.from_arrays([0, len(group)], ids.slice(at, len(group))), **postings([t for t, in group])})
                n, at = n + 1, at + len(group)

    return stored(docs.mapInArrow(blocks, schema), "postings")


def postings(texts: list[str | None]) -> dict[str, list[bytes]]:
    number = Interned()
    rows = [np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for w in map(low_words, texts)]
    tokens = np.concatenate(rows) if rows else np.empty(0, np.int32)
    doc_starts = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    starts = np.concatenate(([0], np.cumsum(np.bincount(tokens, minlength=len(number))))).astype(np.int32)
    positions = np.argsort(tokens, kind="stable").astype(np.int32)
    return {"doc_starts": [doc_starts.tobytes()], "terms": [b" ".join(number)], "starts": [starts.tobytes()], "positions": [positions.tobytes()]}


class Block:
    """Postings of one stored row."""

    def __init__(self, doc_starts: bytes, terms: bytes, starts: bytes, positions: bytes):
        self.docs, self.starts = np.frombuffer(doc_starts, np.int32), np.frombuffer(starts, np.int32)
        self.positions = np.frombuffer(positions, np.int32)
        self.number = {w: i for i, w in enumerate(terms.split(b" "))} if terms else {}

    def places(self, term: int) -> np.ndarray:
        return self.positions[self.starts[term]:self.starts[term + 1]]

    def lookup(self, terms: list[bytes]) -> np.ndarray:
        return np.fromiter((self.number.get(t, -1) for t in terms), np.int64, len(terms))

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions at which the terms stand one after another in one document."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        rare = np.argsort(sizes, kind="stable")
        open_at = self.places(terms[rare[0]]) - rare[0]
        for k in rare[1:]:
            if not open_at.size:
                return open_at
            there, want = self.places(terms[k]), open_at + k
            at = np.searchsorted(there, want)
            open_at = open_at[there[np.minimum(at, len(there) - 1)] == want]
        doc = np.searchsorted(self.docs, open_at, "right") - 1
        return open_at[(open_at >= 0) & (open_at + len(terms) <= self.docs[np.minimum(doc + 1, len(self.docs) - 1)])]

    def near(self, terms: np.ndarray, within: int) -> list[tuple[int, int]]:
        """Shortest spans from each place of the rarest term that hold all terms in at most ``within`` words."""
        terms = np.unique(terms)
        rare = terms[np.argsort(self.starts[terms + 1] - self.starts[terms], kind="stable")]
        found = set()
        for p in self.places(rare[0]):
            doc = np.searchsorted(self.docs, p, "right") - 1
            low, high = max(self.docs[doc], p - within + 1), min(self.docs[doc + 1], p + within)
            seen = []
            for t in rare:
                there = self.places(t)
                seen.append(there[np.searchsorted(there, low):np.searchsorted(there, high)])
                if not len(seen[-1]):
                    break
            else:
                best = None
                for first in np.unique(np.concatenate(seen)):
                    if first > p:
                        break
                    ends = [s[np.searchsorted(s, first):] for s in seen[1:]]
                    if all(len(e) for e in ends):
                        after = max([p, *(e[0] for e in ends)]) + 1
                        if after - first <= within and (best is None or after - first < best[1] - best[0]):
                            best = (int(first), int(after))
                if best:
                    found.add(best)
        return sorted(found)


def windows_of(words: list[bytes], window: int) -> list[list[bytes]]:
    return [words[i:i + window] for i in range(max(1, len(words) - window + 1))] if words else []


def chunks(items: DataFrame, item_id: str, text: str, window: int | None) -> Iterator[list[tuple]]:
    """(item id, window words) in lists of bounded length, streamed through the driver.
    Without a window the unit is a whole item."""
    part: list[tuple] = []
    rows = with_text(items, text).select(F.col(item_id).cast("string"), text).toLocalIterator()
    for name, t in rows:
        words = low_words(t)
        for w in windows_of(words, window or max(1, len(words))):
            part.append((name, w))
            if len(part) >= CHUNK_WINDOWS:
                yield part
                part = []
    if part:
        yield part


def matches(index: DataFrame, part: list[tuple], within: int | None = None) -> DataFrame:
    """One row per document of the index with its hits by ``part``: the spans of exact
    phrases, or with ``within`` the spans in which all of an item's words stand near."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"block long, ord int, id {kind}, n_words long, hits {HITS}"
    number = Interned()
    by_size: dict[int, tuple[list, list]] = {}
    for name, words in part:
        names, rows = by_size.setdefault(len(words), ([], []))
        names.append(name)
        rows.append([number[w] for w in words])
    terms, sized = list(number), [(names, np.array(rows)) for names, rows in by_size.values()]

    def found(block: Block) -> Iterator[tuple[str, int, int]]:
        known = block.lookup(terms)
        for names, rows in sized:
            here = known[rows]
            for i in np.flatnonzero((here >= 0).all(axis=1)):
                if within is None:
                    for p in block.phrase(here[i]):
                        yield names[i], int(p), int(p) + rows.shape[1]
                else:
                    for first, after in block.near(here[i], within):
                        yield names[i], first, after

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = Block(*(b.column(c)[i].as_py() for c in ("doc_starts", "terms", "starts", "positions")))
                ids = b.column("ids")[i].values
                n = len(ids)
                spans: list[dict[str, list]] = [{} for _ in range(n)]
                for name, first, after in sorted(found(block), key=lambda x: x[1]):
                    d = int(np.searchsorted(block.docs, first, "right")) - 1
                    first, after = first - int(block.docs[d]), after - int(block.docs[d])
                    runs = spans[d].setdefault(name, [])
                    if runs and first <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], after)
                    else:
                        runs.append([first, after])
                hits = [[{"item": k, "first": f, "after": a} for k, runs in s.items() for f, a in runs] for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("block")[i].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), ids, pa.array(np.diff(block.docs), pa.int64()),
                     pa.array(hits, pa.list_(pa.struct([("item", pa.string()), ("first", pa.int32()), ("after", pa.int32())])))],
                    names=["block", "ord", "id", "n_words", "hits"])

    return index.mapInArrow(search, schema)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int | None = 10,
                  within: int | None = None) -> DataFrame:
    """(block, ord, id, n_words, hits), one row per document."""
    index = build_index(docs, doc_id, text)
    parts = chunks(items, item_id, item_text, window)
    both = matches(index, next(parts, []), within)
    rest = [stored(matches(index, part, within).where(F.size("hits") > 0), "hits") for part in parts]
    if not rest:
        return both
    for p in rest:
        both = both.unionByName(p)
    return both.groupBy("block", "ord").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"),
                                            F.flatten(F.collect_list("hits")).alias("hits"))


def summary(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts of hit words and items per document."""
    # words under the union of spans, folded from left to right
    covered = F.aggregate(
        F.array_sort(F.transform("hits", lambda h: F.struct(h["first"], h["after"]))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda acc, h: F.struct((acc["n"] + F.greatest(F.lit(0), h["after"] - F.greatest(h["first"], acc["upto"]))).cast("long").alias("n"),
                                F.greatest(acc["upto"], h["after"]).alias("upto")), lambda acc: acc["n"])
    items = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h["item"]), lambda x: x.isNotNull())))
    return (found.withColumn("n_hit", covered).withColumn("_items", items)
            .select(F.col("id").alias(doc_id), "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")))


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold a window of any item."""
    docs = with_text(docs, text)
    keyed = docs.select(F.struct(F.col(doc_id).cast("string").alias("i"), F.xxhash64(F.col(text)).alias("t")).alias("key"), F.col(text).alias("text"))
    hit = contamination(keyed, items, "key", "text", **how).where(F.size("hits") > 0).select("id.*").distinct()
    hit = stored(hit, "contaminated")
    return docs.join(hit, docs[doc_id].cast("string").eqNullSafe(hit["i"]) & (F.xxhash64(docs[text]) == hit["t"]), "left_anti").select(*docs.columns)
