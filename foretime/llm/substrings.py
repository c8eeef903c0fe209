"""Removal of word sequences that repeat anywhere in the corpus, by De Bruijn compaction.

Every run of ``window`` words is an edge of a De Bruijn graph. Edges are never dealt
one by one: consecutive edges of a document that share their anchor (the smallest
hash among their runs of ``ANCHOR`` words) form a compact path, found from content
alone, so equal text gives equal paths wherever it stands. Three joins follow.

1. Paths are grouped: one that occurs twice is repeated with all its edges.
2. Paths that occur once but whose anchor occurs elsewhere lie at the border of a
   repeat. They, and one coordinate of each other path of that anchor, are read
   again at their source and opened into edges; equal edges of different places are
   repeated. Equal edges have equal anchors, so no repeat is missed.
3. Repeated edges go back to all coordinates of their paths, and adjacent ones
   become spans, which are cut from the source.

Paths and edges are compared by anchor and content hash, 128 bits together.
A passage that a third of all documents hold is one path with a count, however often
it occurs; no group's rows meet in one task.

Cases: null texts have no words; texts shorter than a window keep all words; words
are compared as bytes; equal rows are repeats of each other; repeats inside one
text, overlapping ones too, count; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretime.llm.common import Interned, rows_of, sized_groups, spaced_words, stored, text_key, with_text
from foretime.llm.minhash import mixed_bits

ANCHOR = 8
GROUP_BYTES = 4 << 20
_P = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes], number: Interned) -> np.ndarray:
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def hash_table(number: Interned) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))


class Text:
    """Rolling hashes over the words of one text."""

    def __init__(self, words: np.ndarray, window: int):
        self.n, self.window = len(words), window
        self.anchor = min(ANCHOR, window)
        self.words = words

    def runs(self, length: int) -> np.ndarray:
        """Hash of each run of ``length`` words."""
        n = self.n - length + 1
        total = np.zeros(max(0, n), np.uint64)
        for j in range(length if n > 0 else 0):
            total = total * _P + self.words[j:j + n]
        return mixed_bits(total)

    def paths(self) -> tuple[np.ndarray, ...]:
        """(anchor hash, content hash, first edge, edges) of the text's compact paths."""
        n = self.n - self.window + 1
        if n <= 0:
            return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
        g = self.runs(self.anchor)
        at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(g, self.window - self.anchor + 1).argmin(axis=1)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        count = np.diff(np.concatenate((first, [n])))
        length = count + self.window - 1
        total = np.zeros(len(first), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(int(length.max())):
                here = length > j
                total[here] = total[here] * _P + self.words[first[here] + j]
        return g[at[first]], mixed_bits(total + length.astype(np.uint64)), first, count


def path_table(docs: DataFrame, doc_id: str, text: str, window: int) -> DataFrame:
    """Per row: its key, counts, the digest of all its words, and its paths as arrays."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("tkey"), F.col(text).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        for b in batches:
            at = 0
            for group in sized_groups(rows_of([b], "text"), 0, GROUP_BYTES):
                number = Interned()
                words = [spaced_words(t) for t, in group]
                ids = [word_hashes(w, number) for w in words]
                table = hash_table(number)
                paths = [Text(table[i], window).paths() for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(group))), b.column("id").slice(at, len(group)), b.column("tkey").slice(at, len(group)),
                     pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string()),
                     pa.array([p[0].view(np.int64) for p in paths], longs), pa.array([p[1].view(np.int64) for p in paths], longs),
                     pa.array([p[2].astype(np.int32) for p in paths], ints), pa.array([p[3].astype(np.int32) for p in paths], ints)],
                    names=["row", "id", "tkey", "n_words", "digest", "m", "s", "first", "edges"])
                at, row = at + len(group), row + len(group)

    return stored(rows.mapInArrow(read, f"row long, id {kind}, tkey long, n_words long, digest string, m array<long>, s array<long>, first array<int>, edges array<int>"), "paths")


def open_edges(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(m, w, place, s, off, times): each edge of the wanted paths, read at their source;
    ``place`` tells path and offset."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for text, want, times in rows_of([b], "text", "want", "times"):
                number = Interned()
                ids = word_hashes(spaced_words(text), number)
                t = Text(hash_table(number)[ids], window)
                m, s, first, edges = t.paths()
                found = dict(zip(want, times, strict=True))
                seen: set[int] = set()
                keep = []
                for i, x in enumerate(s.view(np.int64).tolist()):
                    if x in found and x not in seen:
                        seen.add(x)
                        keep.append(i)
                if not keep:
                    continue
                n = edges[keep]
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                places = np.repeat(first[keep], n) + off
                w = t.runs(window)[places]
                of = np.repeat(s[keep], n)
                for to, v in zip(out, (np.repeat(m[keep], n).view(np.int64), w.view(np.int64), mixed_bits(of + off.astype(np.uint64)).view(np.int64), of.view(np.int64), off.astype(np.int32),
                                       np.repeat([found[x] for x in s[keep].view(np.int64).tolist()], n).astype(np.int64)), strict=True):
                    to.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["m", "w", "place", "s", "off", "times"])

    rows = docs.join(wanted, docs["id"].eqNullSafe(wanted["wid"]) & (docs["tkey"] == wanted["wkey"]))
    return stored(rows.select("text", "want", "times").mapInArrow(opened, "m long, w long, place long, s long, off int, times long"), "edges")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35) -> tuple[DataFrame, DataFrame]:
    """The path table, and (row, spans: array of first edge, edges, bits of the repeated ones) for rows that hold repeats."""
    docs = with_text(docs, text)
    table = path_table(docs, doc_id, text, window)
    texts = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("tkey"), F.col(text).alias("text"))
    places = table.select("row", F.explode(F.arrays_zip("m", "s", "first", "edges")).alias("p")).select("row", "p.*")
    paths = places.groupBy("m", "s").agg(F.count(F.lit(1)).alias("times"), F.min("row").alias("row"))
    anchors = paths.groupBy(F.col("m").alias("n")).agg(F.sum("times").alias("all"), F.min("times").alias("least")).where("all > 1")
    paths = stored(paths.join(anchors, F.col("m") == F.col("n")).select("m", "s", "times", "row", "least"), "repeated-anchors")
    # where an anchor occurs again and one of its paths only once, a repeat ends
    border = paths.where("least = 1")
    wanted = border.groupBy("row").agg(F.collect_list(F.struct("s", "times")).alias("want"))
    wanted = wanted.join(table.select("row", F.col("id").alias("wid"), F.col("tkey").alias("wkey")), "row").select(
        "wid", "wkey", F.col("want.s").alias("want"), F.col("want.times").alias("times"))
    edges = open_edges(texts, wanted, window)
    # an equal row's second reading gives the same place again and isn't a second one
    again = edges.groupBy("m", "w").agg(F.min("place").alias("x"), F.max("place").alias("y"), F.max("times").alias("most")).where(
        "x <> y or most > 1").select("m", "w")
    single = edges.where("times = 1").select("m", "w", "s", "off").join(again, ["m", "w"], "left_semi").groupBy("m", "s").agg(
        F.array_sort(F.collect_set("off")).alias("offs"))
    whole = paths.where("times > 1").select("m", "s", F.lit(None).cast("array<int>").alias("offs"))
    verdict = stored(whole.unionByName(single), "repeated-paths")
    spans = places.join(verdict, ["m", "s"]).groupBy("row").agg(F.collect_list(F.struct("first", "edges", "offs")).alias("spans"))
    return table, stored(spans, "spans")


def covered(n_words: int, spans: list[dict], window: int) -> np.ndarray:
    """Which words lie under a repeated window."""
    step = np.zeros(n_words + 1, np.int64)
    for s in spans:
        offs = np.arange(s["edges"]) if s["offs"] is None else np.array(s["offs"])
        np.add.at(step, s["first"] + offs, 1)
        np.add.at(step, s["first"] + offs + window, -1)
    return np.cumsum(step)[:n_words] > 0


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept): per row what is left of its words, joined by one space;
    ``kept`` is null where nothing was removed."""
    docs = with_text(docs, text)
    table, spans = repeated_spans(docs, doc_id, text, window)
    marked = table.select("row", "id", "tkey", "n_words", "digest").join(spans, "row", "left")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text_, found in rows_of([b], "text", "spans"):
                words = spaced_words(text_)
                gone = covered(len(words), found, window)
                kept = b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x)
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]],
                                             names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    clean = marked.where("spans is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    # equal rows have equal spans: one of them serves every such row of the source
    marks = marked.where("spans is not null").dropDuplicates(["id", "tkey"]).select(F.col("id").alias("i"), F.col("tkey").alias("t"), "spans")
    source = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("tkey"), F.col(text).alias("text"))
    rows = source.join(marks, F.col("id").eqNullSafe(F.col("i")) & (F.col("tkey") == F.col("t"))).select("id", "text", "spans")
    return clean.unionByName(rows.mapInArrow(cut, schema)).withColumnRenamed("id", doc_id)
