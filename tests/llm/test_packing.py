"""Packing against the plain library, the constraints, and the least number of sequences."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from foretime.llm import packing, word_ids  # noqa: E402
from foretime.llm.packing import Fit, Limits  # noqa: E402

DOCS = "doc_id long, text string, source string, id long, ids string, length long, sequence_id string"
ODD = [None, "", " ", "a", "Hello, World!!", "it's don't 'S ’s", "x y z \x1c\x1d q", "<|startoftext|>a b<|endoftext|> <|END",
       "é é É É ́x", "ΑΣ ΣΑΣ. İ ǅ ß ﬁ 中文字 12a3 a1. ½", "\x85 a\x0bb\x0cc\rd", "🙂🙂 👩‍👩‍👧 ... ?! ?", " A. B, C; ", "�\x00 \x7f"]


def docs(spark, n=300):
    rng = np.random.default_rng(5)
    texts = [*ODD, *(" ".join(rng.choice(["alpha", "Beta,", "x1", "été."], int(k))) for k in rng.integers(0, 400, n)), "long " * 5000, "b " * 4095, "b " * 4096]
    rows = [(i, t, "s", 1, "i", 2, "q") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], rows[20], (None, "null id", None, None, None, None, None)], DOCS)


def plain_ids(texts):
    library = word_ids.word_encoder(word_ids.default_word_tokenizer()).library
    return [[*e.ids, 1] for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_words_encode_as_the_library_does(monkeypatch):
    from tokenizers import Tokenizer

    e = word_ids.WordEncoder(word_ids.default_word_tokenizer())
    fresh = Tokenizer.from_file(word_ids.default_word_tokenizer())
    texts = [*ODD, " ".join(f"w{i} É{i}." for i in range(3000)), *ODD[::-1]]
    want = [x.ids for x in fresh.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    monkeypatch.setattr(word_ids, "CALL_WORDS", 7)
    assert [x.tolist() for x in e.encode(texts)] == want
    assert [e.encode([t])[0].tolist() for t in texts] == want


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(rule):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 400)
    limits = Limits(tokens=100, documents=4, attention=3600)
    bins, offsets, free = packing.best_fit(lengths, limits, Fit(rule, (1.0, 0.5, 0.5)))
    held = defaultdict(list)
    for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), lengths.tolist())):
        assert o == sum(held[b])
        held[b].append(n)
    for b, ns in held.items():
        assert sum(ns) <= 100 and len(ns) <= 4 and sum(n * n for n in ns) <= 3600 and free[b] == 100 - sum(ns)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([61]), limits)
    with pytest.raises(ValueError):
        Fit("first")


def test_best_fit_follows_the_rule():
    limits, cases = Limits(tokens=20, documents=3, attention=400), np.random.default_rng(3).integers(1, 14, (30, 25))
    for lengths in cases:
        for fit in (Fit("norm", (1, 0, 0)), Fit("norm", (1, 2, 1)), Fit("dot", (1, 1, 3))):
            left, want = [], []
            for n in sorted(lengths.tolist(), reverse=True):
                d, cap = np.array([n, 1, n * n]), np.array([20, 3, 400])
                w = np.array(fit.weights)
                score = lambda r: -(w * (d / cap) * (r / cap)).sum() if fit.rule == "dot" else (w * ((r - d) / cap) ** 2).sum()
                fits = [b for b, r in enumerate(left) if (r >= d).all()]
                b = min(fits, key=lambda b: (round(score(left[b]), 12), b)) if fits else len(left)
                if b == len(left):
                    left.append(cap.copy())
                left[b] = left[b] - d
                want.append((n, b))
            bins = packing.best_fit(lengths, limits, fit)[0]
            assert [x for _, x in want] == bins[np.argsort(-lengths, kind="stable")].tolist()
    assert packing.best_fit(np.array([4, 6, 4, 6]), Limits(10))[0].max() == 1


@pytest.mark.parametrize("parts", [1, 6])
def test_pieces_against_the_library(spark, monkeypatch, parts):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 20_000)
    monkeypatch.setattr(packing, "CARRIED_TOKENS", 8_000)
    d = docs(spark)
    packed = packing.pack(d.repartition(parts))
    rows = packing.digests(packed).collect()
    want = Counter()
    given = d.collect()
    for r, ids in zip(given, plain_ids([r.text for r in given]), strict=True):
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        ends = [0, *(o + n for o, n in sorted(pieces))]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 4096
    total = sum(r.length for r in rows)
    assert len(held) <= -(-total // 4096) + 1
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert {s: len(r.ids) for s, r in whole.items()} == {s: sum(n for _, n in p) for s, p in held.items()}
    one = next(r for r in rows if r.doc_id == 4)
    assert zlib.crc32(np.array(whole[one.sequence_id].ids[one.offset:one.offset + one.length], "<u4").tobytes()) == one.ids_crc32


def test_rounds_pack_what_tasks_leave_open(spark, monkeypatch):
    # every task alone would leave half of each sequence free
    monkeypatch.setattr(packing, "TASK_TOKENS", 20_000)
    d = spark.createDataFrame([(i, "b " * (2999 if i % 2 else 1095)) for i in range(60)], "doc_id long, text string")
    d = d.repartitionByRange(2, (d.doc_id % 2))
    rows = packing.pack(d).collect()
    assert len({r.sequence_id for r in rows}) == 30 and len(rows) == 60
    few = packing.pack(d, limits=Limits(4096, documents=1)).select("sequence_id").distinct().count()
    assert few == 60
    short = packing.pack(d, limits=Limits(4096, attention=1000 ** 2)).collect()
    assert max(r.length for r in short) == 1000 and sum(r.length for r in short) == sum(r.length for r in rows)


def test_empty_table_and_session_settings(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    assert packing.pack(docs(spark).limit(0)).count() == 0
    assert packing.digests(packing.pack(docs(spark).select("doc_id", "text").limit(0))).columns == [
        "doc_id", "piece", "start", "length", "sequence_id", "offset", "ids_crc32"]
    assert spark.conf.get(key) == before
