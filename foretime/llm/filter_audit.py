"""What each quality filter removes alone, after others, and in every order of application.

A row's failures are a mask, one bit per filter. The mask fixes the step at which each of
the n! orders removes the row, so it is mapped to one big integer with a 64-bit field for
every (order, step), 600 of them for five filters, and a last field that counts the row.
A task adds the integers of its rows per part, the sums of tasks are added per part, and
the total is unpacked. A field holds at most the rows of a part, which stay below 2**63,
so no field ever carries into the next one. Other integers of the same layout add up only
the rows that bear a mark (a good document, a toxic one).

The sums answer the rest: rows that fail a filter are those that it removes as the first of
an order, rows that fail it alone are those that it removes as the last.

Cases: a null text is empty and a null part is the empty string; a null id has no smaller one
and no labels, and is nobody's smaller one; rows with equal ids count one by one and aren't
copies of each other; a document labelled several times bears a mark if any of its labels
says so; a part without failures has zeros everywhere; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretime.llm.common import SPACED_WORD_SQL, rows_of, stored

FIELD_BYTES = 8
#: Filters whose orders still fit an integer of a few ten KB.
MOST_FILTERS = 6
#: Parts that a task adds up at a time; beyond that it hands on what it has.
OPEN_PARTS = 1000

SUMS = "part string, sums array<binary>"
STEPS = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
         "unique_fails long, shapley long, marked array<long>")


class PackedSteps:
    """Big integers of every mask, and the way back from a sum to counts."""

    def __init__(self, filters: Sequence[str]):
        self.filters = list(filters)
        self.n = len(self.filters)
        self.orders = list(permutations(range(self.n)))
        self.of_mask = [self._packed(m) for m in range(1 << self.n)]

    @property
    def fields(self) -> int:
        return len(self.orders) * self.n + 1

    def _packed(self, mask: int) -> int:
        """One in the field of the step that removes such a row, for each order, and in the last field."""
        out = 1 << 8 * FIELD_BYTES * (self.fields - 1)
        for i, order in enumerate(self.orders):
            step = next((k for k, f in enumerate(order) if mask >> f & 1), None)
            if step is not None:
                out |= 1 << 8 * FIELD_BYTES * (i * self.n + step)
        return out

    def to_bytes(self, total: int) -> bytes:
        return total.to_bytes(FIELD_BYTES * self.fields, "little")

    def unpack(self, data: bytes) -> tuple[np.ndarray, int]:
        """Rows removed at each (order, step), and all rows."""
        fields = np.frombuffer(data, "<i8")
        if (fields < 0).any():
            raise OverflowError("a part has 2**63 rows or more")
        return fields[:-1].reshape(-1, self.n), int(fields[-1])


def add_up(batches: Iterator[pa.RecordBatch], steps: PackedSteps, marks: int) -> Iterator[tuple[str, list[int]]]:
    """Per part the sum over all its rows and over those of each mark, from (part, mask, marked bits)."""
    sums: dict[str, list[int]] = defaultdict(lambda: [0] * (marks + 1))
    for b in batches:
        part = b.column("part").dictionary_encode()
        code = b.column("marked").to_numpy().astype(np.int64) << steps.n | b.column("mask").to_numpy()
        each, times = np.unique(part.indices.to_numpy().astype(np.int64) << (steps.n + marks) | code, return_counts=True)
        names = part.dictionary.to_pylist()
        for x, t in zip(each.tolist(), times.tolist(), strict=True):
            row = steps.of_mask[x & (1 << steps.n) - 1] * t
            marked = x >> steps.n & (1 << marks) - 1
            held = sums[names[x >> steps.n + marks]]
            held[0] += row
            for k in range(marks):
                if marked >> k & 1:
                    held[k + 1] += row
        if len(sums) > OPEN_PARTS:
            yield from sums.items()
            sums.clear()
    yield from sums.items()


def interactions(rows: DataFrame, filters: Sequence[str], part: str, marks: Sequence[str] = ()) -> DataFrame:
    """One row per part, order of the ``filters`` (boolean columns, true: fails) and step.

    ``kept`` after the step; ``removed`` by it; ``redundant``: rows that fail its filter but are
    gone before; ``unique_fails``: rows that fail its filter only; ``shapley``: rows that its
    filter removes, summed over all orders; ``marked``: removed rows of each of ``marks``.
    """
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    n_marks = len(marks)
    bits = lambda names: reduce(Column.__add__, [F.when(F.col(c), 1 << i).otherwise(0) for i, c in enumerate(names)], F.lit(0))
    masks = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                        bits(filters).cast("int").alias("mask"), bits(marks).cast("int").alias("marked"))
    names = list(filters)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = PackedSteps(names)
        for p, sums in add_up(batches, steps, n_marks):
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([[steps.to_bytes(x) for x in sums]])], names=["part", "sums"])

    def unpacked(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = PackedSteps(names)
        total = [0] * (n_marks + 1)
        for row, in rows_of(batches, "sums"):
            total = [a + int.from_bytes(x, "little") for a, x in zip(total, row, strict=True)]
        (removed, size), *lost = [steps.unpack(steps.to_bytes(x)) for x in total]
        at = np.array(steps.orders)
        fails = np.array([removed[at[:, 0] == f, 0][0] for f in range(steps.n)])
        alone = np.array([removed[at[:, -1] == f, -1][0] for f in range(steps.n)])
        credit = np.bincount(at.ravel(), removed.ravel(), steps.n)
        if factorial(steps.n) * size >= 1 << 53:
            credit = np.array([sum(removed[at == f].tolist()) for f in range(steps.n)])
        columns = {
            "part": [key[0].as_py()] * at.size,
            "filter_order": np.repeat(["".join(steps.filters[f] for f in o) for o in steps.orders], steps.n),
            "step": np.tile(np.arange(1, steps.n + 1, dtype=np.int32), len(at)),
            "kept": (size - removed.cumsum(axis=1)).ravel(), "removed": removed.ravel(),
            "redundant": (fails[at] - removed).ravel(), "unique_fails": alone[at].ravel(),
            "shapley": credit.astype(np.int64)[at].ravel(),
            "marked": list(np.stack([x.ravel() for x, _ in lost], axis=1)) if lost else [[]] * at.size}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.list_(pa.int64())) if k == "marked" else pa.array(v) for k, v in columns.items()})

    return masks.mapInArrow(packed, SUMS).groupBy("part").applyInArrow(unpacked, STEPS)


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, A, B, C, D, E) per document; true: the document fails.

    A: under 50 words; B: under 65 % of the words are distinct; C: over 5 % of the characters are
    A-Z; D: holds one of ``#$%&*|``; E: a smaller id has the same text. Texts are compared by
    their SHA-256; only ids and digests are shuffled, and each row meets its text's smallest id
    by (digest, id), so that no task gathers the copies of one text.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("t"))
    rows = rows.withColumn("w", F.regexp_extract_all("t", F.lit(SPACED_WORD_SQL), F.lit(0)))
    n = F.size("w")
    rows = stored(rows.select(
        "id", "part", (n < 50).alias("A"), (100 * F.size(F.array_distinct("w")) < 65 * n).alias("B"),
        (100 * F.length(F.regexp_replace("t", "[^A-Z]+", "")) > 5 * F.length("t")).alias("C"),
        F.col("t").rlike(r"[#$%&*|]").alias("D"), F.unhex(F.sha2("t", 256)).alias("digest")), "filter-failures")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    return rows.join(first, ["digest", "id"], "left").select(
        "id", "part", "A", "B", "C", "D", (F.col("id").isNotNull() & F.col("first").isNull()).alias("E"))


def marked(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``rows`` with ``good`` and ``toxic``: some label of the document says so."""
    per = labels.groupBy(F.col(doc_id).alias("id")).agg(
        F.max(F.col(quality) == 1).alias("good"), F.max(F.col(toxic) == 1).alias("toxic"))
    return rows.join(per, "id", "left")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over ``docs``, per source, with good and toxic documents lost."""
    steps = interactions(marked(failures(docs), labels), list("ABCDE"), "part", ["good", "toxic"])
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                        F.col("marked")[0].alias("good_lost"), F.col("marked")[1].alias("toxic_lost"), "shapley")
