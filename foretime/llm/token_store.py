"""Token ids of a corpus in files of one wavelet matrix per shard.

Documents are range-partitioned by id and encoded; a shard holds the ids of
consecutive documents, each closed by an end id, as bit planes from the highest bit
down. Below each plane the tokens stand stably sorted by its bits, so that ranks
follow a token from plane to plane: that gives the token at a place, the count of a
token before a place, and the place of its k-th occurrence, from the compressed
file alone.

File: the magic bytes, a JSON header (tokens, planes, zeros per plane, documents,
compressed sizes) and per plane its bits, then the documents' lengths, each part
compressed with zstd. Rank counts per 512 bits are derived when a plane is loaded.

Cases: null and empty texts are an end id alone; null ids come first; rows with
equal ids stand next to each other, ordered by text; an empty table gives no files.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from foretime.llm.common import new_folder, open_folder, stored, with_text, write_file
from foretime.llm.tokens import default_tokenizer, encoder

MAGIC = b"WVMX1\n"
#: Text bytes encoded at a time, and tokens per shard, which fit a core's cache.
BLOCK_BYTES = 12 << 20
SHARD_TOKENS = 1 << 20
WORD = 512


def build(tokens: np.ndarray, lengths: np.ndarray) -> bytes:
    """One file: ``tokens`` as bit planes and the token counts of its documents."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    planes = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    parts, zeros = [], []
    for b in range(planes - 1, -1, -1):
        ones = (tokens & tokens.dtype.type(1 << b)) != 0
        parts.append(press(np.packbits(ones).tobytes()))
        low = tokens.compress(~ones)
        zeros.append(len(low))
        tokens = np.concatenate((low, tokens.compress(ones)))
    parts.append(press(lengths.astype("<u4").tobytes()))
    head = json.dumps({"n": int(len(tokens)), "planes": planes, "zeros": zeros, "docs": int(len(lengths)), "sizes": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


class WaveletMatrix:
    """Rank, select and access over one file's bytes."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:6] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size, = struct.unpack("<I", data[6:10])
        head = json.loads(data[10:10 + size])
        self.n, self.planes, self.zeros = head["n"], head["planes"], head["zeros"]
        at, parts = 10 + size, []
        for s in head["sizes"]:
            parts.append(zstandard.ZstdDecompressor().decompress(data[at:at + s]))
            at += s
        self.bits = [np.frombuffer(p, np.uint8) for p in parts[:-1]]
        self.lengths = np.frombuffer(parts[-1], "<u4").astype(np.int64)
        self._counts: list[np.ndarray] | None = None

    def tokens(self) -> np.ndarray:
        """All ids in order: planes are undone from the lowest up."""
        out = np.zeros(self.n, np.uint32 if self.planes > 16 else np.uint16)
        for k in range(self.planes - 1, -1, -1):
            ones = np.unpackbits(self.bits[k], count=self.n).view(bool)
            out[self.zeros[k]:] |= out.dtype.type(1 << (self.planes - 1 - k))
            up = np.empty_like(out)
            up[np.flatnonzero(~ones)] = out[:self.zeros[k]]
            up[np.flatnonzero(ones)] = out[self.zeros[k]:]
            out = up
        return out

    def _ranks(self, k: int) -> np.ndarray:
        if self._counts is None:
            self._counts = []
            for bits in self.bits:
                per = np.pad(np.bitwise_count(bits), (0, -len(bits) % (WORD // 8))).reshape(-1, WORD // 8).sum(axis=1)
                self._counts.append(np.concatenate(([0], np.cumsum(per))).astype(np.int64))
        return self._counts[k]

    def rank1(self, k: int, i: int) -> int:
        """Ones before place i of plane k."""
        word, byte = i // WORD, i // 8
        n = int(self._ranks(k)[word]) + int(np.bitwise_count(self.bits[k][word * WORD // 8:byte]).sum())
        return n + ((int(self.bits[k][byte]) >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def _select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of plane k."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self.rank1(k, mid + 1)
            if (ones if bit else mid + 1 - ones) > j:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        token = 0
        for k in range(self.planes):
            ones = self.rank1(k, i)
            bit = int(self.bits[k][i // 8]) >> (7 - i % 8) & 1
            token = token << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return token

    def _path(self, token: int, i: int) -> tuple[int, int]:
        """Start of the token's run below the last plane, and the place that i comes to there."""
        start = 0
        for k in range(self.planes):
            bit = token >> (self.planes - 1 - k) & 1
            a, b = self.rank1(k, start), self.rank1(k, i)
            start, i = (self.zeros[k] + a, self.zeros[k] + b) if bit else (start - a, i - b)
        return start, i

    def count(self, token: int, before: int | None = None) -> int:
        """Occurrences of ``token`` before a place (of all, by default)."""
        if token >> self.planes:
            return 0
        start, end = self._path(token, self.n if before is None else before)
        return end - start

    def find(self, token: int, j: int) -> int:
        """Place of the j-th occurrence, from 0."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        i = self._path(token, 0)[0] + j
        for k in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, about BLOCK_BYTES of texts at a time."""
    held, size = [], 0
    for b in batches:
        # the text column's bytes are counted, and a batch may be many blocks
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(sizes // BLOCK_BYTES)) + 1).tolist(), b.num_rows]
        for lo, hi in pairwise(cuts):
            part = b.slice(lo, hi - lo)
            more = int(sizes[hi - 1] - (sizes[lo - 1] if lo else 0)) if hi else 0
            if held and size + more > BLOCK_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += more
    if held and sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def write_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2) -> tuple[str, DataFrame]:
    """Write the shards; the folder and its manifest: (part, shard, file, n_docs, n_tokens)
    in document order, with ``ids`` of the documents and ``first``, the tokens before the shard."""
    tokenizer = tokenizer or default_tokenizer()
    docs = with_text(docs, text).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    kind = docs.schema["id"].dataType.simpleString()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.repartitionByRange(parts, F.col("id").asc_nulls_first(), F.length("text")).sortWithinPartitions(
        F.col("id").asc_nulls_first(), F.length("text"), "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for block in blocks(batches):
            tokens, lengths = encoder(tokenizer).encode_block(block.column("text"), end_id)
            ends = np.cumsum(lengths)
            # documents are in one shard whose last tokens are in the same run of SHARD_TOKENS
            cuts = [0, *(np.flatnonzero(np.diff((ends - 1) // SHARD_TOKENS)) + 1).tolist(), len(ends)]
            for lo, hi in pairwise(cuts):
                held = tokens[ends[lo] - lengths[lo]:ends[hi - 1]]
                name = write_file(folder, f"shard-{part:05d}-{n:05d}", build(held, lengths[lo:hi]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part]), pa.array([n]), pa.array([name]), pa.array([len(held)]), pa.ListArray.from_arrays([0, hi - lo], block.column("id").slice(lo, hi - lo))],
                    names=["part", "shard", "file", "n_tokens", "ids"])
                n += 1
        pa.default_memory_pool().release_unused()

    manifest = stored(ordered.mapInArrow(shards, f"part long, shard long, file string, n_tokens long, ids array<{kind}>"), "token-manifest")
    # partitions are few rows: their sums give each one's start, and a window inside a partition the shard's
    sums = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        F.col("part").alias("p"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    inside = W.partitionBy("part").orderBy("shard")
    placed = manifest.join(sums, F.col("part") == F.col("p")).select(
        "part", "shard", "file", "n_tokens", "ids", (F.col("base") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("first"))
    return folder, stored(placed, "token-shards")


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, tokens as little-endian unsigned 32-bit bytes) per document, from the files."""
    kind = manifest.schema["ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        for b in batches:
            for i in range(b.num_rows):
                with store.open_input_stream(f"{path}/{b.column('file')[i].as_py()}") as f:
                    shard = WaveletMatrix(f.read())
                raw = shard.tokens().astype("<u4")
                ends = np.cumsum(shard.lengths)
                cuts = pa.py_buffer(np.append(0, 4 * ends).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids")[i].values, pa.array(ends - shard.lengths + b.column("first")[i].as_py()), pa.array(shard.lengths),
                     pa.Array.from_buffers(pa.binary(), len(ends), [None, cuts, pa.py_buffer(raw)])], names=["id", "start", "n_tokens", "tokens"])

    # shards are few rows in few files: deal them out anew
    parts = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return manifest.select("file", "first", "ids").repartition(parts, "file").mapInArrow(documents, f"id {kind}, start long, n_tokens long, tokens binary")


def digests(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return documents.select(F.col("id").alias(doc_id), "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
