"""Repair of conversations against trying all edits, and the auction's prices against shortest distances."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from foretime.llm import repair

TURNS = "conv_id long, turn long, role string, text string, conv string, chunk long, plan string, code long"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def all_edits(rows):
    """Least (cost, audit) of (initial, truncated, must go) rows, by trying everything."""

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []

        def add(cost, letter, rest):
            found.append((cost + rest[0], letter + rest[1]))

        if inserted < 3:
            for r in "ua":
                if (state, r) in STEP:
                    add(2, "I", best(i, STEP[state, r], inserted + 1))
        if i < len(rows):
            role, cut, gone = rows[i]
            add(3, "D", best(i + 1, state, 0))
            if not gone:
                for r in "sua":
                    if (state, r) in STEP and (r == role or r != "s"):
                        add((r != role) * 2 + cut, "K" if r == role else "R", best(i + 1, STEP[state, r], 0))
        return min(found, default=(1 << 30, ""))

    return best(0, 0, 0)


def brute(given):
    out = {}
    for conv in {r[0] for r in given}:
        rows = []
        for c, turn, role, text, *_ in given:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            key = ":".join(" " if x is None else str(x) for x in (c, turn))
            fault = zlib.crc32(key.encode()) % 20
            text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
            rows += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, codes, faults = set(), [], []
        for _, role, text in rows:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            codes.append((role[:1], int(fault == "truncated"), fault in ("blank", "duplicate")))
        cost, audit = all_edits(tuple(codes))
        state, i, said = 0, 0, []
        for edit in audit:
            role, text = ("", "") if edit == "I" else rows[i][1:]
            i += edit != "I"
            if edit != "D":
                initial = role[0] if edit == "K" else "a" if state == 2 else "u"
                said.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[initial]}:{text}")
                state = STEP[state, initial]
        turns = [r[0] for r in rows if r[0] is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def given(n=60, long=400):
    rng = random.Random(4)
    texts = [None, "", " \n", "Yes.", "No", "What? \t", "So it ends.\nthen", "é!", "w " * 5000, "Fine.", "Well.\x1f"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "Useful", "a"]
    rows = [(c, t * (1 + t % 2) if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"Line {rng.random()}.", "x", 1, "y", 2)
            for c in range(n) for t in range(rng.randint(1, 9))]
    rows += [(None, t, roles[t % 3], "Null id.", None, None, None, None) for t in range(5)]
    rows += [(1000, t, ["user", "assistant"][t % 2 if t % 11 else 0], f"Turn {t % 97}{'' if t % 7 == 0 else '.'}", "x", 1, "y", 2) for t in range(long)]
    return rows + rows[3:6]


@pytest.mark.parametrize("chunk", [512, 8])
def test_repair_against_all_edits(spark, monkeypatch, chunk):
    rows, size = given(long=130), repair.CHUNK_ROWS
    assert size == 512
    monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
    if chunk != size:  # workers read the module's own size: hand them the one under test
        monkeypatch.setattr(repair, "solve_chunk", small_chunks(chunk))
    got = repair.repair_damaged(spark.createDataFrame(rows, TURNS).repartition(5))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute(rows)


def small_chunks(size, solve=repair.solve_chunk):
    def solve_small(codes, chunk):
        from foretime.llm import repair as r

        r.CHUNK_ROWS = size
        return solve(codes, chunk)

    return solve_small


def test_auction_prices_are_shortest_distances(monkeypatch):
    rng = random.Random(2)
    for stage in (1, 3, 16):
        monkeypatch.setattr(repair, "STAGE_ROWS", stage)
        for _ in range(150):
            codes = [rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 8, 9]) for _ in range(rng.randint(1, 20))]
            ends = rng.choice([(0, 4, 2, 0), (repair.NEVER, 0, repair.NEVER, repair.NEVER), (repair.NEVER,) * 3 + (0,)])
            dist = [0] * 4 * len(codes) + list(ends)
            for i in range(len(codes) - 1, -1, -1):
                arcs = repair.row_arcs(codes[i])
                over = [min(c + dist[4 * i + off] for c, x, off in a if x != "I") for a in arcs]
                for s in range(4):
                    n = repair.NEXT[s]
                    dist[4 * i + s] = min(over[s], 2 + over[n], 4 + over[repair.NEXT[n]])
            a = repair.Auction(codes, ends, range(4))
            for node in range(4 * len(codes)):
                if dist[node] >= repair.NEVER:
                    assert a.price[node] >= repair.NEVER
                    continue
                # a dual solution: no arc is cheaper than the prices say, exact where a path has settled
                assert a.price[node] <= dist[node]
                assert all(a.price[node] <= c + a.price[(node & ~3) + off] for c, _, off in repair.row_arcs(codes[node >> 2])[node & 3])
                if a.settled[node]:
                    assert a.price[node] == dist[node]
            for entry in range(4):
                found = a.trace(entry)
                assert (found is None) == (dist[entry] >= repair.NEVER) and (found is None or found[0] == dist[entry])


def test_chained_letters_compare_as_text():
    rng = random.Random(3)
    for _ in range(2000):
        parts = [["".join(rng.choices("DI", k=rng.randint(0, 3))) for _ in range(rng.randint(1, 4))] for _ in range(2)]
        a, b = (None if not p else chain(p) for p in parts)
        assert repair.first_less(a, b) == ("".join(parts[0]) < "".join(parts[1]))


def chain(parts):
    out = None
    for p in reversed(parts):
        out = (p, out)
    return out


def test_repaired_messages_and_clean_conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (2, 0, "user", "Hi."), (2, 1, "user", "Hi."), (2, 2, "assistant", "Yes"), (3, 0, "tool", "x.")]
    d = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    plans = repair.plans(d)
    assert {r.conv: (r.cost, r.audit, r.duplicate, r.truncated, r.illegal) for r in plans.collect()} == {
        1: (0, "KKK", 0, 0, 0), 2: (4, "KDK", 1, 1, 1), 3: (3, "D", 0, 0, 0)}
    said = [(r.conv, r.place, r.edit, r.role, r.text) for r in repair.repaired(d, plans).orderBy("conv", "place").collect()]
    assert said == [(1, 0, "K", "system", "Be kind."), (1, 1, "K", "user", "Hi."), (1, 2, "K", "assistant", "Hello."), (2, 0, "K", "user", "Hi."), (2, 1, "K", "assistant", "Yes")]
    for r in repair.digests(d, plans).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{m[3]}:{m[4]}" for m in said if m[0] == r.conv).encode()).hexdigest()


def test_empty_table_and_conversations_without_rows(spark):
    d = spark.createDataFrame(given(3, 0), TURNS)
    assert repair.repair_damaged(d.limit(0)).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    only = spark.createDataFrame([(7, dropped, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    assert tuple(repair.repair_damaged(only).first()) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
