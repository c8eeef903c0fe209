"""Blocks of texts are encoded as the plain library does it, and what came before isn't encoded again."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from foretime.llm import minhash, token_store, tokens  # noqa: E402

ODD = [None, "", " ", "  ", "a  b", "x\n \n b", " lead, trail ", "a\t\n b", "don't  stop.", "a <|endoftext|> b", "x<|endoftext|>y", "it's 'tis o'clock' 12, 3.5 a1 1a (b) !! ?!x   y  ",
       "a  ", "q\x1c b\x1c ", "1234!! ab12 ß'S 's 'll\x85 \x85", "日本 語。 áb x́! ǅ ÿ Āɏ÷×", "\n", "a\n", "a b\nc d\n\ne 12\n12! x\n!y a!\n! é!!\nÈ.* a\n q", "u ab\n", " a", "~ \x7f a\x7f \x00 a\r\nb c\xadd"]


def split(found):
    ids, n = found
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []


def test_blocks_equal_the_library(monkeypatch):
    e = tokens.Encoder(tokens.default_tokenizer())
    plain = lambda texts: [x.ids for x in e.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    texts = pa.array(ODD, pa.string())
    assert split(e.encode_block(texts)) == plain(ODD)
    assert split(e.encode_block(texts.slice(3, 9), 2)) == [[*x, 2] for x in plain(ODD[3:12])]
    assert split(e.encode_block(texts.slice(0, 0), 2)) == []
    assert split(e.encode_block(pa.array([None, ""], pa.string()), 2)) == [[2], [2]]
    for most in (0, 500, 2000):
        monkeypatch.setattr(tokens, "SEEN_BYTES", most)
        for k in range(6):
            some = [" ".join(f"wörd{chr(97 + (i * k) % 26)}{chr(97 + i % 26)}" for i in range(30)), *ODD[k:k + 4]]
            assert split(e.encode_block(pa.array(some, pa.string()))) == plain(some)
            assert e.seen[0].nbytes + e.seen[1].nbytes + e.seen[2].nbytes <= most


def test_letters_are_encoded_once():
    e = tokens.Encoder(tokens.default_tokenizer())
    sent, units = [], e._units
    e._units = lambda stems, before: sent.extend((before, w) for w in stems.to_pylist()) or units(stems, before)
    texts = ["so wordish wordish, wordish!! Wordish", "so wordish. wordish\nwordish;"]
    for t in (texts, texts[::-1]):
        e.encode_block(pa.array(t, pa.string()))
    assert sorted(w for before, w in sent if before) == ["Wordish", "so", "wordish"]


def test_blocks_and_shards_keep_order(spark, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_BYTES", 50)
    sizes = [0, 10, 200, 49, 50, 51, 1, 0]
    batches = [pa.RecordBatch.from_pydict({"id": list(range(8)), "text": ["x" * n for n in sizes]}), pa.RecordBatch.from_pydict({"id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}),
               pa.RecordBatch.from_pydict({"id": [8, 9], "text": pa.array([None, "y"])})]
    got = [b.column("id").to_pylist() for b in token_store.blocks(iter(batches))]
    assert [i for g in got for i in g] == list(range(10)) and len(got) > 3
    assert list(token_store.blocks(iter(batches[1:2]))) == []


def test_pairs_of_sets_come_in_small_batches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(minhash, "stored", lambda df, name: seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or df)
    minhash.verified(spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([(1, b""), (2, b"")], "node long, set binary"), 0.8)
    assert seen == [str(minhash.PAIR_ROWS)] and minhash.PAIR_ROWS <= 100
