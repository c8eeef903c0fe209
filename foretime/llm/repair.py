"""Repairing the structure of conversations by an auction for shortest paths.

The roles of a sound conversation follow ``(s?(ua)+)?``: perhaps one system message, then user
and assistant in turns, or nothing at all. Edits lead there: Keep a row, Rerole it, Delete it,
Insert an empty message. Rows and the states of that grammar span a lattice of integer costs,
and the cheapest edits are a shortest path through it.

The auction keeps a price at each node, at first the least that its later rows must cost. A path
starts at an origin and is extended from its last node over the arc of least cost plus price; a
node priced below that raises its price to it and the path is contracted by one. At the end the
prices are a converged dual solution: every arc of a shortest path is tight, and the audit
is traced over tight arcs that lead on to the end, by the least letter first, which makes it the
ASCII-least among the cheapest. Origins stand every few rows, from the last to the first, and a
path ends where an earlier one has settled a price, so the work grows with the rows.

A conversation may hold most of the rows. Its rows are numbered from the offsets of a range
partitioning and cut into chunks; each chunk is solved from its entry states to its exit states,
and one row per chunk is put together from the last to the first. Texts meet only as a stream
sorted by conversation, whose hash takes them in one after another and holds none.

Cases: nulls in role and text are one space, so a null text is blank; null ids form one
conversation; rows of one turn go by role and SHA-256 of role and text, null turns first; equal rows
are duplicates of the first of them; a conversation without rows is sound at no cost; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretime.llm.common import arrow_rows, rows_of, stored
from foretime.operators.ordered import POS, attach, number_rows

#: Rows of a conversation solved at a time, and rows from one origin to the next.
CHUNK_ROWS = 512
STAGE_ROWS = 8

#: Grammar states: nothing yet, after system, after user, after assistant. NEXT is the state
#: behind the role that a state calls for, user but after user, where it is assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_INITIALS = "sua"
OTHER = 3
#: What is left to insert from each state at the end of a conversation.
TAIL = ((0, ""), (4, "II"), (2, "I"), (0, ""))
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
NEVER = 1 << 60

SEEN = "[^\\x20\\x09-\\x0D]"
CLOSED = "[.!?][\\x20\\x09-\\x0D]*\\z"

CELLS = "cells array<struct<entry: int, leave: int, cost: long, audit: string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def row_arcs(code: int) -> list[list[tuple[int, str, int]]]:
    """Per state the arcs over a row, by letter: (cost, letter, where the arc leads from 4 * row).

    ``code`` is the role's place in ROLE_INITIALS, plus 4 if the text is truncated, plus 8 if the row
    must be deleted.
    """
    role, cut, gone = code & 3, code >> 2 & 1, code >> 3 & 1
    arcs = []
    for state in range(4):
        out = [(DELETE, "D", 4 + state), (INSERT, "I", NEXT[state])]
        if not gone:
            called = 2 if state == USER else 1
            if state == START and role == 0:
                out.append((KEEP + cut, "K", 4 + SYSTEM))
            if role == called:
                out.append((KEEP + cut, "K", 4 + NEXT[state]))
            else:
                out.append((REROLE + cut, "R", 4 + NEXT[state]))
        arcs.append(out)
    return arcs


ARCS = [row_arcs(c) for c in range(16)]
FLOOR = [min(c for state in arcs for c, letter, _ in state if letter != "I") for arcs in ARCS]


class Auction:
    """Prices of a chunk's lattice: node 4 * i + state stands before row i; the nodes behind the
    last row are priced by ``ends`` (NEVER: no way on from there)."""

    def __init__(self, codes: list[int], ends: tuple[int, ...], entries: Iterable[int] = (START,)):
        self.codes, n = codes, len(codes)
        self.end = 4 * n
        price = self.price = [0] * self.end + list(ends)
        floor = min(ends)
        for i in range(n - 1, -1, -1):
            floor += FLOOR[codes[i]]
            price[4 * i:4 * i + 4] = [floor] * 4
        if max(ends) >= NEVER:
            self._close()
        settled = self.settled = bytearray(self.end) + b"\1" * 4
        for i in range((n - 1) // STAGE_ROWS * STAGE_ROWS, -1, -STAGE_ROWS):
            for state in range(4) if i else entries:
                if price[4 * i + state] < NEVER and n:
                    self._settle(4 * i + state)
        self.leads = self._leads()

    def _close(self) -> None:
        """Price nodes out from which no arc leads on."""
        price = self.price
        for i in range(len(self.codes) - 1, -1, -1):
            at, arcs = 4 * i, ARCS[self.codes[i]]
            on = [any(off >= 4 and price[at + off] < NEVER for _, _, off in arcs[s]) for s in range(4)]
            for _ in range(2):
                on = [x or on[NEXT[s]] for s, x in enumerate(on)]
            for s in range(4):
                if not on[s]:
                    price[at + s] = NEVER

    def _settle(self, origin: int) -> None:
        """Extend and contract a path from ``origin`` until it meets a settled node."""
        price, settled, codes = self.price, self.settled, self.codes
        path = [origin]
        while not settled[node := path[-1]]:
            at = node & ~3
            best, head = NEVER, -1
            for cost, _, off in ARCS[codes[node >> 2]][node & 3]:
                value = cost + price[at + off]
                if value < best:
                    best, head = value, at + off
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        settled[origin] = 1

    def _leads(self) -> bytearray:
        """Nodes from which tight arcs lead to the end."""
        price, leads = self.price, bytearray(self.end) + bytes(p < NEVER for p in self.price[self.end:])
        for i in range(len(self.codes) - 1, -1, -1):
            at, arcs = 4 * i, ARCS[self.codes[i]]
            for _ in range(3):  # insertions stay before the row
                for s in range(4):
                    p = price[at + s]
                    if p < NEVER and any(leads[at + off] and p == cost + price[at + off] for cost, _, off in arcs[s]):
                        leads[at + s] = 1
        return leads

    def trace(self, entry: int) -> tuple[int, str, int] | None:
        """Cost to the end, the least letters of a shortest path, and the state that it leaves in."""
        if self.price[entry] >= NEVER:
            return None
        price, leads, letters, node = self.price, self.leads, [], entry
        while node < self.end:
            at = node & ~3
            letter, node = next((x, at + off) for cost, x, off in ARCS[self.codes[node >> 2]][node & 3]
                                if leads[at + off] and price[node] == cost + price[at + off])
            letters.append(letter)
        return price[entry], "".join(letters), node & 3


def solve_chunk(codes: list[int], chunk: int) -> list[dict]:
    """Cheapest edits of a chunk from each entry to each exit; of a conversation's only chunk,
    those to its end (exit -1)."""
    if chunk == 0 and len(codes) < CHUNK_ROWS:
        cost, audit, state = Auction(codes, tuple(c for c, _ in TAIL)).trace(START)
        return [{"entry": START, "leave": -1, "cost": cost, "audit": audit + TAIL[state][1]}]
    out = []
    entries = range(4) if chunk else [START]
    for leave in range(4):
        auction = Auction(codes, tuple(0 if s == leave else NEVER for s in range(4)), entries)
        for entry in entries:
            if found := auction.trace(entry):
                out.append({"entry": entry, "leave": leave, "cost": found[0], "audit": found[1]})
    return out


def first_less(a: tuple | None, b: tuple | None) -> bool:
    """Whether the letters chained in ``a`` come before those in ``b``: (letters, rest)."""
    i = j = 0
    while True:
        while a is not None and i == len(a[0]):
            a, i = a[1], 0
        while b is not None and j == len(b[0]):
            b, j = b[1], 0
        if a is None or b is None or (a is b and i == j):
            return a is None and b is not None
        n = min(len(a[0]) - i, len(b[0]) - j)
        x, y = a[0][i:i + n], b[0][j:j + n]
        if x != y:
            return x < y
        i, j = i + n, j + n


def joined(cells: list[dict], rest: list[tuple | None]) -> list[tuple | None]:
    """(cost, letters) from each entry of a chunk, given those from each state behind it."""
    out: list[tuple | None] = [None] * 4
    for c in cells:
        after = (0, None) if c["leave"] < 0 else rest[c["leave"]]
        if after is None:
            continue
        mine, held = (c["cost"] + after[0], (c["audit"], after[1])), out[c["entry"]]
        if held is None or mine[0] < held[0] or mine[0] == held[0] and first_less(mine[1], held[1]):
            out[c["entry"]] = mine
    return out


def letters_of(chain: tuple | None) -> str:
    parts = []
    while chain is not None:
        parts.append(chain[0])
        chain = chain[1]
    return "".join(parts)


def or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults by the crc32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties
    its text, 2 takes out its sentence ends, 3 repeats it and 4 makes it a user's."""
    by = F.pmod(F.crc32(F.concat(or_space(conv_id), F.lit(":"), or_space(turn)).cast("binary")), F.lit(20))
    d = rows.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), or_space(role).alias("role"), or_space(text).alias("text"), by.alias("by"))
    d = d.where("by <> 0").select(
        "conv", "turn", F.when(F.col("by") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return d.drop("copy")


def sort_digest() -> Column:
    """Tells rows of one turn apart; equal rows share it."""
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)


def coded(rows: DataFrame) -> DataFrame:
    """(conv, chunk, codes in order, counts of faults) from (conv, turn, role, text) rows, without their texts."""
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    narrow = rows.select("conv", "turn", "role", sort_digest().alias("digest"), place.alias("place"),
                         (~F.col("text").rlike(SEEN)).alias("blank"), (~F.col("text").rlike(CLOSED)).alias("open"))
    numbered = number_rows(narrow, ["conv"], ["turn", "role", "digest"])
    # a row meets the first place of its text by that place, so copies don't gather
    firsts = numbered.groupBy("conv", "digest").agg(F.min(POS).alias(POS)).withColumn("first", F.lit(True))
    numbered = attach(numbered, firsts, ["conv", "digest", POS])
    blank, again = F.col("blank"), ~F.col("blank") & F.col("first").isNull()
    cut = ~blank & ~again & F.col("open")
    flag = lambda c: c.cast("int")
    rows = numbered.select("conv", POS, F.expr(f"{POS} div {CHUNK_ROWS}").alias("chunk"), flag(blank).alias("blank"), flag(again).alias("duplicate"),
                           flag(cut).alias("truncated"), (F.col("place") + 4 * flag(cut) + 8 * flag(blank | again)).alias("code"))
    codes = F.transform(F.array_sort(F.collect_list(F.struct(POS, "code"))), lambda x: x["code"])
    return rows.groupBy("conv", "chunk").agg(codes.alias("codes"), *[F.sum(c).alias(c) for c in COUNTS[:3]])


def solved(chunks: DataFrame) -> DataFrame:
    """(conv, counts, cost, audit) per conversation that has rows, from ``coded`` chunks."""
    kind = chunks.schema["conv"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)

    def chunk_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, illegal, ends = [], [], []
            for chunk, codes in rows_of([b], "chunk", "codes"):
                roles = [c & 3 for c in codes]
                illegal.append(sum((x, y) not in SOUND for x, y in zip(roles, roles[1:], strict=False)))
                ends.append([roles[0], roles[-1]])
                cells.append(solve_chunk(codes, chunk))
            made = pa.RecordBatch.from_pydict({"illegal": pa.array(illegal, pa.int64()), "ends": pa.array(ends, pa.list_(pa.int32())), "cells": pa.array(cells, CELL_TYPE)})
            keep = ["conv", "chunk", *COUNTS[:3]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made.columns], names=[*keep, *made.schema.names])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of one conversation come from the last to the first."""
        first, conv_type, out = None, None, []
        for b in batches:
            conv_type = b.column("conv").type
            for conv, chunk, *tally, ends, cells in rows_of([b], "conv", "chunk", *COUNTS, "ends", "cells"):
                if first is None:
                    rest, sums, first = [(c, (s, None)) for c, s in TAIL], [0] * len(COUNTS), -1
                rest = joined(cells, rest)
                sums = [x + y for x, y in zip(sums, tally, strict=True)]
                sums[3] += first >= 0 and (ends[1], first) not in SOUND
                first = ends[0]
                if chunk == 0:
                    cost, chain = rest[START]
                    out.append((conv, *sums, cost, letters_of(chain)))
                    first = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], conv_type), *(pa.array([r[k] for r in out], pa.int64()) for k in range(1, 6)),
                                                  pa.array([r[6] for r in out], pa.string())], names=["conv", *COUNTS, "cost", "audit"])
                out = []

    cells = chunks.mapInArrow(chunk_cells, f"conv {kind}, chunk long, blank long, duplicate long, truncated long, illegal long, ends array<int>, {CELLS}")
    ordered = cells.repartition("conv").sortWithinPartitions(F.col("conv"), F.col("chunk").desc())
    return ordered.mapInArrow(whole, f"conv {kind}, {counts}, cost long, audit string")


SOUND = {(0, 1), (1, 2), (2, 1)}
CELL_TYPE = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def edited(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired conversation, from its rows in order."""
    rows, state = iter(rows), START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s" and state == START:
            state = SYSTEM
        else:
            if edit != "K":
                role = "assistant" if state == USER else "user"
            state = NEXT[state]
        yield edit, role, text


def plans(rows: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """(conv, gaps, counts, cost, audit) of every conversation in (conv, turn, role, text) ``rows``, and of
    those in the ``conv`` column of ``conv_ids`` that have none."""
    ids = (rows if conv_ids is None else conv_ids).select("conv").distinct()
    turns = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    out = attach(attach(ids, turns, ["conv"]), solved(coded(rows)), ["conv"])
    return out.select("conv", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS, "cost")], F.coalesce("audit", F.lit("")).alias("audit"))


def _stream(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan, followed by its rows in order, in one partition."""
    head = planned.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit("").alias("text"),
                          F.struct(*[c for c in planned.columns if c != "conv"]).alias("plan"))
    body = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", sort_digest().alias("digest"), "text", F.lit(None).cast(head.schema["plan"].dataType).alias("plan"))
    order = ["conv", "kind", "turn", "role", "digest"]
    return head.unionByName(body).repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text", "plan")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict, Iterator[tuple[str, str]]]]:
    """(conv, plan, its rows as they stream by)."""
    rows = rows_of(batches, "conv", "kind", "role", "text", "plan")
    held: list[tuple] = []

    def body() -> Iterator[tuple[str, str]]:
        for row in rows:
            if row[1] == 0:
                held.append(row)
                return
            yield row[2], row[3]

    for row in rows:
        held.append(row)
        while held:
            head = held.pop()
            mine = body()
            yield head[0], head[4], mine
            for _ in mine:  # rows deleted at the end
                pass


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the messages of the repaired conversations."""
    stream = _stream(rows, planned)
    conv = stream.schema["conv"].dataType.simpleString()

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = []

        def noted():
            for b in batches:
                types.append(b.schema.field("conv").type)
                yield b

        out = []
        for key, plan, body in _conversations(noted()):
            for place, row in enumerate(edited(plan["audit"], body)):
                out.append((key, place, *row))
                if len(out) == 1000:
                    yield _rows(out, types[0])
                    out = []
        if out:
            yield _rows(out, types[0])

    return stream.mapInArrow(messages, f"conv {conv}, place long, edit string, role string, text string")


def _rows(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    kinds = [conv, pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", "place", "edit", "role", "text"])


def digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``planned`` with ``repaired_sha256`` of each repaired conversation: ``role:text``, joined by line feeds."""
    stream = _stream(rows, planned)
    names = [c for c in planned.columns if c != "conv"]
    kinds = ", ".join(f"`{c}` {planned.schema[c].dataType.simpleString()}" for c in planned.columns)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def noted():
            nonlocal schema
            for b in batches:
                schema = b.schema
                yield b

        out = []
        for key, plan, body in _conversations(noted()):
            digest = hashlib.sha256()
            for place, (_, role, text) in enumerate(edited(plan["audit"], body)):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            out.append((key, *(plan[c] for c in names), digest.hexdigest()))
            if len(out) == 1000:
                yield _batch(out, schema, names)
                out = []
        if out:
            yield _batch(out, schema, names)

    return stream.mapInArrow(hashed, f"{kinds}, repaired_sha256 string")


def _batch(rows: list[tuple], schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
    plan = schema.field("plan").type
    kinds = [schema.field("conv").type, *(plan.field(n).type for n in names), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", *names, "repaired_sha256"])


def repair_damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per original conversation: what was wrong after the damage, and its cheapest repair."""
    rows = damaged(conversations, conv_id, turn, role, text)
    with arrow_rows(rows.sparkSession, 1000):
        planned = stored(plans(rows, conversations.select(F.col(conv_id).alias("conv"))), "repair-plans")
    return digests(rows, planned).withColumnRenamed("conv", conv_id)
