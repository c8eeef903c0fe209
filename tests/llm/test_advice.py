"""What the review of the document operators found to be less than the whole job."""

import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from foretime.llm import lm, minhash, token_counts, token_store  # noqa: E402


def train_ids(ids):
    return [i for i in ids if zlib.crc32(str(i).encode()) % 7 != 2]


def test_attention_learns_from_all_training_documents(spark, monkeypatch):
    seen, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda rows, *a, **k: seen.append(rows.count()) or fit(rows, *a, **k))
    # none of these documents was in the sample of one in 64
    ids = [i for i in train_ids(range(200)) if zlib.crc32(str(i).encode()) // 7 % 64][:60]
    lm.scores(spark.createDataFrame([(i, f"one two w{i % 5} three") for i in ids], "doc_id long, text string")).count()
    assert seen == [60]


def test_attention_sees_every_subword_id(spark):
    seen = np.random.default_rng(0).integers(0, 50, 400)
    symbols = lm.Symbols(seen, np.arange(400) % 2 == 0, 10)
    layout = {"starts": symbols.starts, "mass": symbols.mass, "n_bounds": symbols.n_bounds}
    assert sorted(symbols.number) == list(range(1, 401)) and len(symbols.starts) < 130
    a = lm.Attention(seed=3, **layout)
    ids, targets, counts = lm.windows(np.append(np.random.default_rng(1).integers(1, 401, 99), 0), 401)
    each = np.stack([a.log_probs(ids, np.full_like(ids, t)) for t in range(401)])
    assert np.allclose(np.exp(each).sum(axis=0), 1, atol=1e-4)
    # a word ends before the end and before ids that open words
    assert np.allclose(np.exp(each[:201]).sum(axis=0), np.exp(a.both(ids, targets)[1]), atol=1e-4)
    # any two ids are told apart as the past of what follows, also two of one class
    assert a.of[398] == a.of[399]
    other = np.where(np.arange(lm.WINDOW) == 5, 398, ids[:1]), np.where(np.arange(lm.WINDOW) == 5, 399, ids[:1])
    one, two = (a.log_probs(x, targets[:1])[0] for x in other)
    assert (one[:5] == two[:5]).all() and (one[5:] != two[5:]).all()
    g, flat = a.gradient(ids, targets, counts.astype(np.float32)), a.flat.astype(np.float64)
    loss = lambda f: -(lm.Attention(f, **layout).log_probs(ids, targets) * counts).sum(dtype=np.float64) / counts.sum()
    for i in np.argsort(-abs(g))[::60][:25]:
        d = np.zeros_like(flat)
        d[i] = 1e-2
        assert abs((loss(flat + d) - loss(flat - d)) / 2e-2 - g[i]) < 2e-3
    whole = [np.concatenate([x[c] for x, c in zip(p[1], p[2], strict=True)]) for p in (lm.windows(np.arange(1000) % 401, 401), [np.concatenate(x) for x in zip(*lm.batched([np.arange(1000) % 401], 401, 7), strict=True)])]
    assert (whole[0] == np.arange(1000) % 401).all() and (whole[1] == whole[0]).all()
    none = np.empty(0, np.int64)
    tokenizer = lm.default_tokenizer()
    words = [b"unbelievableness", b"of", b"xqzv77"]
    library = lm.encoder(tokenizer).library
    opens = np.array([library.id_to_token(i).startswith("Ġ") for i in range(library.get_vocab_size())])
    scorer = lm.Scorer(tokenizer, lm.Symbols(np.zeros(len(opens), int), opens, 0), None, none, none)
    scorer.learn(set(words))
    want = library.encode(" unbelievableness of xqzv77", add_special_tokens=False).ids
    assert len(want) > 5 and scorer.sequence(words)[1].tolist() == [*scorer.symbols.number[want], 0]


def test_every_training_word_has_its_unit_share(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common common w{i} v{i % 7} v{i % 3} v{i % 7}") for i in range(60)] + [(100, None), (101, "")], "doc_id long, text string")

    def scores():
        return {r.doc_id: (r.score, r.base_score, r.n_known) for r in lm.scores(docs).collect()}

    want = scores()
    for most in (0, 5):
        monkeypatch.setattr(lm, "FREQUENT", most)
        got = scores()
        assert all(np.allclose(got[d], want[d], rtol=1e-4) for d in want) and len(got) == 62


NAMED = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b", " <|endoftext|><|endoftext|> ", "x  <|endoftext|>\n y", "<|endoftext|>. end", "<|endoftext> |> no"]


def test_added_tokens_are_encoded_as_the_library_does(spark):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(lm.default_tokenizer())
    want = [fresh.encode(t, add_special_tokens=False).ids for t in NAMED]
    assert want[0] == [64, 220, 50256, 275]
    e = lm.encoder(lm.default_tokenizer())
    assert [x.tolist() for x in e.encode(NAMED)] == want
    assert [int(e.widths[x].sum()) for x in e.encode(NAMED)] == [len(t) for t in NAMED]
    words = ["<|endoftext|>", "a<|endoftext|>b", "plain"]
    assert [x.tolist() for x in e.encode_words(words)] == [fresh.encode(" " + w, add_special_tokens=False).ids for w in words]
    docs = spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string")
    rows = token_store.digests(token_store.read_tokens(*token_store.write_tokens(docs))).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in rows} == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(want)}
    counted = token_counts.section_tokens(docs).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in counted} == {i: len(x) for i, x in enumerate(want)}


def test_links_are_named_as_those_compared(spark):
    words = [f"k{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"end{i}"])) for i in range(3)], "doc_id long, text string")
    rows = minhash.classes(docs).collect()
    assert {r.class_id for r in rows} == {0} and "n_links" not in rows[0].asDict()
    # three similar texts are one class by two links or three
    assert sum(r.n_compared_links for r in rows) in (4, 6)


def test_near_copies_that_are_not_similar_enough_are_not_paired(spark, monkeypatch):
    rng, words = np.random.default_rng(7), [f"w{i}" for i in range(200)]

    def edited(name, n):
        at = set(rng.choice(200, n, replace=False).tolist())
        return " ".join(f"{name}x{i}" if i in at else w for i, w in enumerate(words))

    texts = [edited(f"m{i}", 1 + i % 3) for i in range(60)] + [edited(f"o{i}", 8) for i in range(40)]
    sets = [minhash.counted(x) for x in minhash.shingles(texts)]
    packed = [x.tobytes() + n.astype(np.uint32).tobytes() for x, n in sets]
    label = list(range(100))
    for a in range(100):
        for b in range(a):
            if label[a] != label[b] and minhash.similarity(packed[a], packed[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert 20 < len(set(label)) < 60
    compared, stored = [], minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda d, name: (out := stored(d, name), compared.append(out.count()) if name == "pairs" else None)[0])
    rows = minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(label))
    assert sum(compared) < 700
