"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretime.llm import balltree, decontamination, filter_audit, lm, minhash, mixing, packing, repair, substrings, token_counts, token_store, toxicity, warc
from foretime.session import pin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Words of the two rules in DuckDB; null texts have none.
LOW_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: pin(spark).read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_decontamination", f"""
WITH d AS (SELECT doc_id, coalesce({LOW_WORDS.format(t="text")}, []) AS w FROM documents),
i AS (SELECT item_id, coalesce({LOW_WORDS.format(t="text")}, []) AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, len(g) AS k, array_to_string(g, ' ') AS g FROM (
  SELECT item_id, w[s:s + 9] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM i WHERE len(w) > 0))),
dw AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d)
  CROSS JOIN (SELECT DISTINCT k FROM iw) WHERE s + k - 1 <= len(w)),
h AS (SELECT doc_id, item_id, s, k FROM dw JOIN iw USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY 1),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""")
def decontamination_query(table):
    return decontamination.summary(decontamination.contamination(table("documents"), table("benchmark")))


@query("op3_mixing", f"""
WITH d AS (SELECT doc_id, source, coalesce(len({SPACED_WORDS.format(t="text")}), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS ss, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY 1),
o AS (SELECT source, ss, w, 2 * ss AS cap, sum(2 * ss) OVER (ORDER BY 2 * ss / w, encode(source) NULLS LAST) - 2 * ss AS before,
  sum(w) OVER (ORDER BY 2 * ss / w DESC, encode(source) DESC NULLS FIRST) AS rest, 1.5 * sum(ss) OVER () AS total FROM s),
l AS (SELECT min_by((total - before) / rest, cap / w) FILTER (WHERE (total - before) / rest * w <= cap) AS level FROM o),
t AS (SELECT source, ss, coalesce(least(cap, level * w), cap) AS target FROM o, l),
c AS (SELECT *, CASE WHEN ss > 0 THEN target / ss ELSE 0 END AS each FROM t),
p AS (SELECT *, least(2, floor(each)) AS certain, target - least(2, floor(each)) * ss AS rest_words FROM c),
r AS (SELECT d.doc_id, d.source, size, ss, target, certain, rest_words, each - certain AS pr,
  (('0x' || substr(md5('1|' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
x AS (SELECT *, sum(CASE WHEN pr > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, size, ss::BIGINT AS source_size, round(target, 6) AS target, (size * (certain + CASE WHEN pr > 0 AND upto - size / 2 <= rest_words THEN 1 ELSE 0 END))::BIGINT AS taken FROM x""")
def mixing_query(table):
    return mixing.mix(table("documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op4_token_counts")
def token_counts_query(table):
    return token_counts.section_tokens(table("documents"))


@query("op8_token_store")
def token_store_query(table):
    return token_store.digests(token_store.read_tokens(*token_store.write_tokens(table("documents"))))


@query("op5_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, payload_bytes, max(page_id) AS home FROM p WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN home <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN home <> page_id THEN home END AS refers_to FROM p LEFT JOIN m USING (payload_digest, payload_bytes)""")
def warc_query(table):
    folder, index = warc.write_archives(table("pages"))
    return warc.read_records(folder, index).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query("op9_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def top_k_query(table):
    vectors = table("embeddings")
    return balltree.top_k(vectors, vectors.where("vec_id % 100 = 0"))


@query("op2_minhash")
def minhash_query(table):
    return minhash.classes(table("documents")).select("doc_id", "class_id", "n_compared_links", "n_copies")


@query("op7_toxicity")
def toxicity_query(table):
    docs = table("documents")
    return toxicity.scored(docs, toxicity.fit(docs, table("labels")))


@query("op6_substrings", f"""
WITH d AS (SELECT doc_id, coalesce({SPACED_WORDS.format(t="text")}, []) AS w FROM documents),
g AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, list_sort(list_distinct(list(p))) AS gone FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM r) GROUP BY 1),
k AS (SELECT doc_id, w, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w
  ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1), list_transform(range(1, len(w) + 1), lambda i: list_contains(gone, i))), lambda z: NOT z[3]), lambda z: z[1]) END AS kept
  FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""")
def substrings_query(table):
    return substrings.without_repeats(table("documents")).drop("kept")


@query("op10_lm_scores")
def lm_query(table):
    return lm.scores(table("documents"))


@query("op11_filter_audit", f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {SPACED_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS g, max((toxic = 1)::INT) AS x FROM labels GROUP BY 1),
f AS (SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(g, 0) AS g, coalesce(x, 0) AS x
  FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
  || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n, sum(g) AS g, sum(x) AS x FROM f GROUP BY 1, 2),
o AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) q,
  (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) r, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) s, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) t
  WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
k AS (SELECT part, filter_order, step, filter_order[step] AS l, m.*,
  coalesce(list_min(list_filter(range(1, 6), lambda i: contains(fails, filter_order[i]))), 6) AS gone FROM m, o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, l, sum(n) FILTER (WHERE gone > step) AS kept, sum(n) FILTER (WHERE gone = step) AS removed,
  sum(n) FILTER (WHERE contains(fails, l) AND gone < step) AS redundant, sum(n) FILTER (WHERE fails = l) AS unique_fails,
  sum(g) FILTER (WHERE gone = step) AS good_lost, sum(x) FILTER (WHERE gone = step) AS toxic_lost FROM k GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, l), 0)::BIGINT AS shapley FROM r""")
def filter_audit_query(table):
    return filter_audit.audit(table("documents"), table("labels"))


@query("op12_packing")
def packing_query(table):
    return packing.digests(packing.pack(table("documents")))


def _plus(cost: str, letters: str, path: str) -> str:
    """A path (nine digits of cost, then letters) behind some more edits; text order is that of cost, then letters."""
    return f"lpad((substr({path}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || '{letters}' || substr({path}, 10)"


#: For each grammar state (nothing yet, after system, user, assistant) the one behind the role that it calls for.
_CALLED = (2, 2, 3, 2)
_OVER_ROW = ", ".join(
    "least({delete}, CASE WHEN NOT gone AND role IN ({called}) THEN {keep} END, {system}CASE WHEN NOT gone AND role NOT IN ({called}) THEN {rerole} END) AS b{s}".format(
        s=s, called="'a'" if s == 2 else "'u'", delete=_plus("3", "D", f"v{s}"), keep=_plus("cut", "K", f"v{n}"), rerole=_plus("2 + cut", "R", f"v{n}"),
        system=f"CASE WHEN NOT gone AND role = 's' THEN {_plus('cut', 'K', 'v1')} END, " if s == 0 else "")
    for s, n in enumerate(_CALLED))
_INSERTED = ", ".join(f"least(b{s}, {_plus('2', 'I', f'b{n}')}, {_plus('4', 'II', f'b{_CALLED[n]}')}) AS v{s}" for s, n in enumerate(_CALLED))


@query("op13_conversation_repair", f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
  lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
dealt AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
  lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS x FROM raw, tab),
d AS (SELECT conv_id, turn, CASE x WHEN 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, (SELECT unnest([0, 1]) AS copy) WHERE x <> 0 AND (copy = 0 OR x = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS open, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
r AS (SELECT conv_id, i, role AS whole, text, left(role, 1) AS role, blank OR again AS gone, (NOT blank AND NOT again AND open)::INT AS cut, turn, blank, NOT blank AND again AS duplicate,
  before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate, sum(cut) AS truncated,
  sum(illegal::INT) AS illegal, count(*) AS rows FROM r GROUP BY 1),
back AS (SELECT conv_id, rows AS i, '000000000' AS v0, '000000004II' AS v1, '000000002I' AS v2, '000000000' AS v3 FROM n
  UNION ALL SELECT conv_id, i - 1, {_INSERTED} FROM (SELECT conv_id, i, {_OVER_ROW} FROM back JOIN r USING (conv_id, i))),
best AS (SELECT conv_id, substr(v0, 1, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM back WHERE i = 0),
walk AS (SELECT conv_id, audit, 1 AS j, 1::BIGINT AS i, 0 AS state, []::VARCHAR[] AS said FROM best
  UNION ALL SELECT w.conv_id, audit, j + 1, CASE WHEN e = 'I' THEN w.i ELSE w.i + 1 END,
    CASE WHEN e = 'D' THEN state WHEN e = 'K' AND state = 0 AND r.role = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END,
    CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, whole || ':' || text)
      ELSE list_append(said, CASE WHEN state = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE e WHEN 'R' THEN text ELSE '' END) END
  FROM (SELECT *, audit[j] AS e FROM walk WHERE j <= length(audit)) w LEFT JOIN r ON w.conv_id = r.conv_id AND w.i = r.i),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN n USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN walk ON walk.conv_id = ids.conv_id AND walk.j = length(walk.audit) + 1""")
def conversation_repair_query(table):
    return repair.repair_damaged(table("conversations"))
