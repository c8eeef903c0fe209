"""Operators of the document pipeline against brute force, on odd rows and the small tables."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")

from foretime.llm import balltree, decontamination, lm, minhash, mixing, substrings, token_counts, token_store, tokens, toxicity, warc  # noqa: E402
from foretime.llm.common import low_words  # noqa: E402
from foretime.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, id long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(9000))


def odd_docs(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", "  ", "a", "one two three", LONG, LONG, LONG + " tail", "x " + passage + " y", passage + "\n\n \n z", "A  b\n c " * 30, "*** &&&", "é " * 50, passage]
    rows = [(i, t, "en" if i % 2 else None, [None, "", "s1", "s2"][i % 4], 0, 7, 7, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[3], (None, "null id", None, None, None, 1, 1, 1)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(cur.fetchall())


def test_decontamination_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "x alpha beta gamma y"), (2, "Alpha, BETA gamma"), (3, "alpha beta q gamma"), (4, None), (4, "beta gamma alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma"), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items) for r in decontamination.summary(decontamination.contamination(docs, items)).collect()}
    assert got == {(1, 5): (3, 1), (2, 3): (3, 1), (3, 4): (0, 0), (4, 0): (0, 0), (4, 3): (0, 0)}
    near = decontamination.contamination(docs, items, window=None, within=4)
    assert sorted(r.id for r in near.collect() if r.hits) == [1, 2, 3, 4]
    assert sorted(r.doc_id for r in decontamination.decontaminated(docs, items).collect()) == [3, 4, 4]
    assert decontamination.decontaminated(empty(spark), items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).where("size(hits) > 0").count() == 0


def test_minhash_classes_and_signatures(spark):
    got = minhash.classes(odd_docs(spark)).collect()
    by_text = defaultdict(set)
    for r in got:
        by_text[r.doc_id].add(r.class_id)
    assert by_text[5] == by_text[6] == by_text[7] == {5}
    assert by_text[0] == {0} and by_text[11] == {11} and by_text[3] == {3}
    kept = minhash.deduplicated(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and sum(r.doc_id in (5, 6, 7) for r in kept.collect()) == 1
    assert minhash.deduplicated(empty(spark)).count() == 0
    a, b = np.arange(400, dtype=np.uint64), np.arange(100, 500, dtype=np.uint64)
    elements = minhash.mixed_bits(np.concatenate((a, b)) * np.uint64(77))
    r = minhash.darts(elements, np.repeat([0, 1], 400), np.full(800, 1.5), 2, 512)
    assert np.isfinite(r).all() and abs((r[0] == r[1]).mean() - 0.6) < 0.12


def test_mixing_reaches_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 40), "abcd"[i % 4] if i % 9 else None) for i in range(4000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    taken, target, size = defaultdict(int), {}, {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
        assert 0 <= r.taken <= 2 * r.size
    for s in taken:
        assert abs(taken[s] - target[s]) <= 40 and target[s] <= 2 * size[s] + 1e-6
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3
    assert sorted(rows, key=repr) == sorted(mixing.mix(docs.repartition(7)).collect(), key=repr)
    assert mixing.mix(odd_docs(spark)).count() == odd_docs(spark).count() and mixing.mixed(empty(spark)).count() == 0
    assert mixing.mixed(docs).count() == sum(r.taken // r.size for r in rows if r.size)


def test_encoding_and_token_counts(spark):
    e = tokens.encoder(tokens.default_tokenizer())
    texts = [None, "", " ", "  ", "a  b", "x\n \n b", " lead, trail ", "a\t\n b", "don't  stop.", "é ü  z", LONG]
    plain = [x.ids for x in e.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == plain
    for rule in token_counts.RULES:
        rows = token_counts.section_tokens(odd_docs(spark), rule=rule).collect()
        sums = defaultdict(float)
        for r in rows:
            if r.doc_id not in (3, 5, None):
                sums[r.doc_id, r.n_total] += r.n_tokens
        assert all(abs(n - total) < 1e-6 for (_, total), n in sums.items())
    assert token_counts.attribute(np.array([3, 6]), np.array([0, 4, 6]), "start").tolist() == [2, 0]
    assert token_counts.attribute(np.array([3, 6]), np.array([0, 4, 6]), "end").tolist() == [1, 1]
    assert np.allclose(token_counts.attribute(np.array([3, 6]), np.array([0, 4, 6]), "split"), [4 / 3, 2 / 3])
    fields = token_counts.section_tokens(odd_docs(spark), fields=("source", "text"), by_line=False)
    assert fields.count() == 2 * odd_docs(spark).count()
    assert token_counts.section_tokens(empty(spark)).count() == 0


def test_token_store_round_trip(spark):
    docs = odd_docs(spark)
    rows = token_store.digests(token_store.read_tokens(*token_store.write_tokens(docs))).collect()
    e = tokens.encoder(tokens.default_tokenizer())
    want = Counter()
    for r in docs.collect():
        ids = [*(e.library.encode(r.text, add_special_tokens=False).ids if r.text else []), 2]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    place = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    assert token_store.read_tokens(*token_store.write_tokens(empty(spark))).count() == 0
    t = (np.random.default_rng(0).zipf(1.3, 5000) % 300).astype(np.uint16)
    m = token_store.WaveletMatrix(token_store.build(t, np.array([5000])))
    assert (m.tokens() == t).all() and all(m.access(i) == t[i] for i in range(0, 5000, 397))
    for x in (1, 7, 299, 5000):
        at = np.flatnonzero(t == x)
        assert m.count(x) == len(at) and m.count(x, 777) == (at < 777).sum()
        assert all(m.find(x, j) == at[j] for j in range(0, len(at), max(1, len(at) // 3)))


def test_warc_round_trip(spark):
    big = "<p>" + "b" * 2000
    pages = spark.createDataFrame([(1, "http://a\nb", big), (2, None, big), (2, None, big), (None, "n", big), (3, "s", "x"), (4, "s", "x"), (5, "e", None)], "page_id long, url string, html string")
    folder, index = warc.write_archives(pages)
    got = {(r.id, r.record_type, r.refers_to, None if r.payload is None else len(r.payload), r.payload_bytes) for r in warc.read_records(folder, index).collect()}
    assert got == {(1, "revisit", "2", None, 2003), (2, "response", None, 2003, 2003), (None, "revisit", "2", None, 2003), (3, "response", None, 1, 1), (4, "response", None, 1, 1), (5, "response", None, 0, 0)}
    one = warc.read_records(folder, index.where("id = 3")).collect()
    assert [bytes(r.payload) for r in one] == [b"x"] and one[0].payload_digest == hashlib.sha1(b"x").hexdigest()
    assert warc.read_records(*warc.write_archives(pages.limit(0))).count() == 0


def test_substrings_against_counting(spark):
    docs = [tuple(r) for r in odd_docs(spark).select("doc_id", "text").collect()]
    docs += [(100 + k, " ".join(np.random.default_rng(k % 3).choice(["a", "b", "c"], 120 + k).tolist())) for k in range(6)] + [(200, "r " * 90)]
    words = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for (d, _), w in zip(docs, words, strict=True):
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i:i + 35])] > 1 for p in range(i, i + 35)}
        want[d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()] += 1
    got = substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want
    assert substrings.without_repeats(empty(spark)).count() == 0


def test_toxicity_orders_severity(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["fair", "calm", "kind", "tree", "road"], 30).tolist() + ["vileword"] * 1 + (["nastyword", "foulword"] if i % 6 == 0 else []) * 1 if i % 3 == 0 else rng.choice(["fair", "calm", "kind", "tree"], 30).tolist()), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows[:400]] + [(None, 1), (9000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert sum(got[i].toxic != bool(x) for i, _, x in rows[400:]) <= 4 and not got[9000].toxic and not got[9001].toxic
    assert got[600 - 6].expected_severity > got[600 - 3].expected_severity > got[599].expected_severity
    assert toxicity.rejected(docs, model).columns == docs.columns
    assert toxicity.scored(empty(spark), toxicity.fit(docs, labels.limit(0))).count() == 0


def test_top_k_cases(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [3.0]), (7, [-1.0, 0.0]), (100, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in balltree.top_k(v, v.where("vec_id % 100 = 0"), k=2).select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5 << 20), (0, 2, 2, 5 << 20), (100, 1, 6, 3 << 20)]
    assert balltree.top_k(v.limit(0), v.limit(0)).count() == 0


def test_lm_scores_and_gradient(spark):
    docs = [tuple(r) for r in odd_docs(spark).select("doc_id", "text").collect()]
    got = lm.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    words = [(d, (t or "").encode().lower().split()) for d, t in docs]
    c = Counter(w for d, ws in words if not held[d] for w in ws)
    ends = sum(not held[d] for d, _ in docs)
    n, v = sum(c.values()) + ends, len(c) + 1
    want = sorted((repr(d), len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws) + np.log10((ends + 1) / (n + v + 1)), 4)) for d, ws in words)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == n for r in got)
    assert lm.scores(empty(spark)).count() == 0
    a = lm.Attention(seed=3)
    ids, targets, counts = lm.windows(np.arange(70) % 9)
    assert counts.sum() == 70
    g, flat = a.gradient(ids, targets, counts.astype(np.float32)), a.flat.astype(np.float64)
    loss = lambda f: -(lm.Attention(f).log_probs(ids, targets) * counts).sum(dtype=np.float64) / counts.sum()
    for i in np.random.default_rng(0).choice(len(flat), 12, replace=False):
        d = np.zeros_like(flat)
        d[i] = 1e-2
        assert abs((loss(flat + d) - loss(flat - d)) / 2e-2 - g[i]) < 2e-3


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as c

    rows = {r.doc_id for r in c.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id: r.text for r in toxicity.rejected(docs, model).collect()}
    sets = {d: Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if (w := low_words(t)) else Counter() for d, t in clean.items()}
    head = {d: d for d in clean}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(clean)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = (sets[a] & sets[b]).total()
            if both and both >= 0.8 * (sets[a].total() + sets[b].total() - both):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    items = {tuple(w[i:i + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := low_words(r.text)) for i in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in items}
    left = {d for d in ids if find(d) == d and not any(tuple(w[i:i + k]) in items for w in [low_words(clean[d])] for k in sizes for i in range(len(w) - k + 1))}
    assert rows <= left
    mixed = {r.doc_id for r in mixing.mix(docs.where(docs.doc_id.isin(list(left)))).where("copies > 0").collect()}
    assert rows == mixed
