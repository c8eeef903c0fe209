"""Packing tokenized documents into sequences by vector best-fit.

A sequence has a capacity in each of three dimensions: tokens, documents, and attention
cost (the sum of squared piece lengths). Pieces go in falling length, and each into the open
sequence that holds it under every constraint and fits it best by its residual capacities:

``norm``  the smallest weighted norm of what is left after the piece;
``dot``   the largest weighted dot product of the piece's demand and what is left.

Documents are cut only where they are longer than a piece may be. A task encodes its
documents, packs them block by block and takes the pieces of its worst filled sequences on
into the next block. Sequences that end with room left are open: their pieces alone are
dealt out again by a hash and packed with those of other tasks, in rounds of fewer tasks,
until one task holds them all or a round saves too little. No task or driver sees
more than its share, and ids travel only for open pieces.

Cases: null and empty texts are an end id alone; rows with equal ids are packed each on
their own; an empty table gives no rows; only text and id columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType

from foretime.llm.common import arrow_rows, rows_of, stored
from foretime.llm.word_ids import default_word_tokenizer, word_encoder

#: Text bytes encoded at a time.
BATCH_BYTES = 12 << 20
#: Tokens packed at a time by one task, and those of a block that may go on into the next.
BLOCK_TOKENS = 4 << 20
CARRIED_TOKENS = BLOCK_TOKENS // 4
#: A sequence with more than this share of its tokens free is open.
OPEN_SHARE = 1 / 128
#: Open tokens that a task of a later round takes.
TASK_TOKENS = 32 << 20
#: Rounds end when one saves less than this share of the open sequences.
LEAST_SAVED = 0.02
ROWS_OUT = 2000

PIECES = "piece int, start long, length long, ids binary"
PACKED = f"{PIECES}, sequence_id long, offset long, open boolean"


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most; by default only tokens bind."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None

    @property
    def vector(self) -> np.ndarray:
        # at most one document a token, and squares of parts are below the square of the sum
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens ** 2], np.int64)

    @property
    def piece(self) -> int:
        """Longest piece that fits an empty sequence."""
        return min(self.tokens, isqrt(int(self.vector[2])))


@dataclass(frozen=True)
class Fit:
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)

    def __post_init__(self):
        if self.rule not in ("norm", "dot"):
            raise ValueError("rule is norm or dot")
        if min(self.weights) < 0:
            raise ValueError("weights aren't negative")

    def badness(self, left: np.ndarray, demand: np.ndarray, capacity: np.ndarray) -> np.ndarray:
        """Of each sequence (columns of ``left``) that takes the piece; the least is best."""
        weights = np.array(self.weights)
        if self.rule == "dot":
            return -((weights * demand / capacity ** 2) @ left)
        rest = (left - demand[:, None]) / capacity[:, None]
        return weights @ (rest * rest)


def best_fit(lengths: np.ndarray, limits: Limits = Limits(), fit: Fit = Fit()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per piece its sequence (from 0) and offset, and per sequence the residual tokens."""
    capacity = limits.vector
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    residual = np.zeros((3, n), np.int64)
    live, made = np.zeros(n, np.int64), 0  # sequences that may still take a piece
    n_live = 0
    shortest = int(lengths.min()) if n else 0
    least = np.array([shortest, 1, shortest ** 2])
    for i in order.tolist():
        size = int(lengths[i])
        demand = np.array([size, 1, size * size])
        open_ = live[:n_live]
        left = residual[:, open_]
        fits = np.flatnonzero((left >= demand[:, None]).all(axis=0))
        if len(fits):
            at = int(fits[np.argmin(fit.badness(left[:, fits], demand, capacity))])
            b = int(open_[at])
        else:
            if (demand > capacity).any():
                raise ValueError(f"a piece of {size} tokens fits no sequence")
            b, at = made, n_live
            residual[:, b] = capacity
            live[n_live] = b
            made, n_live = made + 1, n_live + 1
        bins[i], offsets[i] = b, capacity[0] - residual[0, b]
        residual[:, b] -= demand
        if (residual[:, b] < least).any():
            n_live -= 1
            live[at:n_live] = live[at + 1:n_live + 1].copy()
    return bins, offsets, residual[0, :made]


class Packer:
    """One task's blocks: pieces come in, packed rows go out."""

    def __init__(self, limits: Limits, fit: Fit, prefix: int, id_type: pa.DataType, last: bool):
        self.limits, self.fit, self.prefix, self.id_type, self.last = limits, fit, prefix, id_type, last
        self.pieces: list[tuple] = []
        self.tokens = self.made = 0

    def add(self, piece: tuple) -> Iterator[pa.RecordBatch]:
        self.pieces.append(piece)
        self.tokens += len(piece[3])
        if self.tokens >= BLOCK_TOKENS:
            yield from self.pack(final=False)

    def pack(self, final: bool = True) -> Iterator[pa.RecordBatch]:
        if not self.pieces:
            return
        lengths = np.array([len(p[3]) for p in self.pieces], np.int64)
        bins, offsets, free = best_fit(lengths, self.limits, self.fit)
        is_open = free > self.limits.tokens * OPEN_SHARE
        carried = np.zeros(len(free), bool)
        if not final:
            # the worst filled first, as far as they fit the next block
            worst = np.argsort(-free, kind="stable")
            carried[worst] = is_open[worst] & (np.cumsum(self.limits.tokens - free[worst]) <= CARRIED_TOKENS)
        number = np.cumsum(~carried) - 1 + self.made
        rows = np.flatnonzero(~carried[bins])
        rows = rows[np.lexsort((offsets[rows], bins[rows]))]
        for at in range(0, len(rows), ROWS_OUT):
            yield self._batch(rows[at:at + ROWS_OUT], bins, offsets, number, is_open & (not self.last))
        self.made += int((~carried).sum())
        self.pieces = [self.pieces[i] for i in np.flatnonzero(carried[bins])]
        self.tokens = sum(len(p[3]) for p in self.pieces)

    def _batch(self, rows, bins, offsets, number, is_open) -> pa.RecordBatch:
        out = [self.pieces[i] for i in rows.tolist()]
        lengths = np.array([len(p[3]) for p in out], np.int64)
        ids = pa.array([p[3].tobytes() for p in out], pa.binary())
        b = bins[rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in out], self.id_type), pa.array([p[1] for p in out], pa.int32()), pa.array([p[2] for p in out], pa.int64()), pa.array(lengths), ids,
             pa.array(self.prefix + number[b]), pa.array(offsets[rows]), pa.array(is_open[b])],
            names=["id", "piece", "start", "length", "ids", "sequence_id", "offset", "open"])


def blocks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Consecutive rows of about so many bytes of text; a longer text is a block alone."""
    held, size = [], 0
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy()
        start = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > most_bytes:
                yield pa.Table.from_batches([*held, b.slice(start, i - start)])
                held, size, start = [], 0, i
            size += n
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _prefix(round_: int) -> int:
    """Sequence numbers of one task of one round."""
    return round_ << 56 | TaskContext.get().partitionId() << 32


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits(), fit: Fit = Fit(),
         tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """(id, piece, start, length, ids, sequence_id, offset): the pieces of all documents, with
    their token ids, and where each stands. ``start`` counts its document's ids before it;
    ``ids`` are little-endian, of as many bytes as the vocabulary needs (``id_arrays`` unpacks them)."""
    tokenizer = tokenizer or default_word_tokenizer()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast(StringType()).alias("text"))
    id_type, kind = to_arrow_type(rows.schema["id"].dataType), rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {PACKED}"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, longest = Packer(limits, fit, _prefix(0), id_type, False), limits.piece
        for block in blocks(batches, BATCH_BYTES):
            ids, counts = word_encoder(tokenizer).encode_block(block.column("text").combine_chunks())
            ends = np.cumsum(counts)
            for id_, start, end in zip(block.column("id").to_pylist(), ends - counts, ends, strict=True):
                of = np.append(ids[start:end], ids.dtype.type(end_id))
                for k, at in enumerate(range(0, len(of), longest)):
                    yield from packer.add((id_, k, at, of[at:at + longest]))
        yield from packer.pack()

    with arrow_rows(rows.sparkSession, 1000):
        packed = stored(rows.mapInArrow(encoded, schema), "packed-0")
    rounds, round_ = [packed.where("not open")], 0
    left = packed.where("open")
    while True:
        tokens, before = left.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
        if not before:
            break
        tasks, round_ = -(-tokens // TASK_TOKENS), round_ + 1
        with arrow_rows(rows.sparkSession, 1000):
            again = stored(_repack(left, tasks, round_, limits, fit, id_type, schema), f"packed-{round_}")
        rounds.append(again.where("not open"))
        left = again.where("open")
        if tasks == 1 or again.select("sequence_id").distinct().count() > (1 - LEAST_SAVED) * before:
            rounds.append(left)
            break
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.drop("open").withColumnRenamed("id", doc_id)


def _repack(pieces: DataFrame, tasks: int, round_: int, limits: Limits, fit: Fit, id_type: pa.DataType, schema: str) -> DataFrame:
    """Pieces of any sequences, dealt out by a hash and packed anew."""
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, fit, _prefix(round_), id_type, tasks == 1)
        for *row, length, ids in rows_of(batches, "id", "piece", "start", "length", "ids"):
            yield from packer.add((*row, numbers(ids, length)))
        yield from packer.pack()

    dealt = pieces.repartition(tasks, F.xxhash64("sequence_id", "offset"))
    return dealt.select("id", "piece", "start", "length", "ids").mapInArrow(again, schema)


def numbers(ids: bytes, length: int) -> np.ndarray:
    """The ids of one piece."""
    return np.frombuffer(ids, f"<u{len(ids) // max(length, 1)}")


def id_arrays(packed: DataFrame) -> DataFrame:
    """``packed`` with ``ids`` as arrays of int."""
    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("ids")
            lists = [numbers(*x).astype(np.int32) for x in rows_of([b], "ids", "length")]
            yield b.set_column(at, "ids", pa.array(lists, pa.list_(pa.int32())))

    fields = ", ".join(f"`{f.name}` {'array<int>' if f.name == 'ids' else f.dataType.simpleString()}" for f in packed.schema)
    return packed.mapInArrow(unpacked, fields)


def sequences(packed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, documents): the packed sequences themselves, of at most their capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", F.col(doc_id).alias("doc"))))
    return id_arrays(packed).groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc"]).alias("documents"))


def digests(packed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``packed`` with the unsigned crc32 of each piece's ids, as little-endian unsigned 32-bit
    integers, in place of the ids."""
    kept = packed.select(F.col(doc_id).alias("id"), "piece", "start", "length", "sequence_id", "offset", "ids")
    kind = kept.schema["id"].dataType.simpleString()

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [zlib.crc32(numbers(*x).astype("<u4")) for x in rows_of([b], "ids", "length")]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(sums, pa.int64())], names=[*b.schema.names[:6], "ids_crc32"])

    schema = f"id {kind}, piece int, start long, length long, sequence_id long, offset long, ids_crc32 long"
    return kept.mapInArrow(crc, schema).withColumnRenamed("id", doc_id)
