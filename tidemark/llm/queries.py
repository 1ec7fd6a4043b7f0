"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, near, packing, pages, quality, ranked, repair, secrets, suffixes, topk, toxicity, transducer, trie
from tidemark.llm.common import table


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = repair.write_shards(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2)
    return repair.read_documents(shards)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op3_concat_cut_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=1, with_ids=False).drop("ids")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality.EXTRA
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.links(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op10_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op13_hybrid_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_repair_tokens": op1_repair_tokens,
    "op2_secret_scan": op2_secret_scan,
    "op3_concat_cut_packing": op3_concat_cut_packing,
    "op4_token_counts": op4_token_counts,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_threshold_top_k": op10_threshold_top_k,
    "op11_burst_trie": op11_burst_trie,
    "op12_page_differencing": op12_page_differencing,
    "op13_hybrid_ranked_search": op13_hybrid_ranked_search,
}

_STOPS = ", ".join(f"('{w}'), ('{w.capitalize()}'), ('{w.upper()}')" for w in dict.fromkeys(quality.STOP_WORDS))

_SQL_TESTS = " AND ".join(
    t
    for r in quality.RULES
    for t in (
        ([f"coalesce(({r.measure.replace(' / ', '::DOUBLE / ')}) >= {r.low!r}, false)"] if r.low is not None else [])
        + ([f"coalesce(({r.measure.replace(' / ', '::DOUBLE / ')}) <= {r.high!r}, false)"] if r.high is not None else [])
    )
)

QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
p AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY rid),
stops AS (SELECT list(s) AS s FROM (VALUES {_STOPS}) v(s)),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(regexp_extract_all(t, '[!?]'))::BIGINT AS n_marks,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]')))::BIGINT AS n_bullets,
  len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…'))::BIGINT AS n_ellipsis,
  len(list_intersect(list_distinct(ws), s))::BIGINT AS n_stop,
  coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM w CROSS JOIN stops LEFT JOIN p USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {_SQL_TESTS} END AS kept,
  {', '.join(quality.EXTRA)}
FROM b
"""

TOP_K_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ws FROM documents),
n AS (SELECT rid, doc_id, len(ws)::BIGINT AS n FROM d WHERE len(ws) > 0),
tot AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS (SELECT rid, t, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ws) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, tot GROUP BY t, docs),
q AS (SELECT number, item_id, t, count(*)::BIGINT AS k FROM (SELECT number, item_id, unnest(ws) AS t
  FROM (SELECT row_number() OVER () AS number, item_id, {_TERMS} AS ws FROM benchmark)) GROUP BY ALL),
s AS (SELECT number, item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN df USING (t) JOIN tf USING (t) JOIN n USING (rid), tot GROUP BY number, item_id, rid, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

# CRC-32 bit by bit; 3988292384 is its reversed polynomial.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: list_reduce(list_concat([xor(a, x)], range(8)), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)))))"""

TRIE_SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
one AS (SELECT c, c - c % 20 AS b, {_CRC} % 4 AS h, had FROM (SELECT c, count(*) AS had FROM t GROUP BY c)),
conv AS (SELECT o.c, o.b, o.h, least(o.h, coalesce(l.had, 0)) AS taken, least(o.h, coalesce(l.had, 0)) + greatest(o.had - o.h, 0) AS n
  FROM one o LEFT JOIN one l ON l.c = o.b),
r AS (SELECT c, taken + pos - h AS i, role, text FROM conv JOIN t USING (c) WHERE pos >= h
  UNION ALL SELECT conv.c, pos, role, text FROM conv JOIN t ON t.c = conv.b WHERE pos < taken),
p AS (SELECT c, i + 1 AS d, string_agg(md5(length(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY i) AS k,
  len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r UNION ALL SELECT c, 0, '', 0 FROM conv),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends_sha256 FROM p JOIN conv USING (c) GROUP BY k, d),
up AS (SELECT *, CASE WHEN d > 1 THEN left(k, 33 * d - 34) WHEN d = 1 THEN '' END AS pk FROM node),
kids AS (SELECT pk AS k, count(*) AS n_children FROM up WHERE d > 0 GROUP BY pk),
a AS (SELECT CASE WHEN j = 0 THEN '' ELSE left(k, 33 * j - 1) END AS k, own, n_children IS NULL AS leaf
  FROM (SELECT up.*, n_children, unnest(range(0, d + 1)) AS j FROM up LEFT JOIN kids USING (k))),
s AS (SELECT k, count(*) FILTER (WHERE leaf) AS n_leaves, sum(own) AS saved FROM a GROUP BY k)
SELECT up.conv_id, up.d::BIGINT AS depth, q.conv_id AS parent_conv_id, up.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves, saved::BIGINT AS saved_tokens, up.ends_sha256
FROM up LEFT JOIN kids USING (k) JOIN s USING (k) LEFT JOIN node q ON q.k = up.pk
"""

ORACLE_SQL = {
    "op11_burst_trie": TRIE_SQL,
    "op13_hybrid_ranked_search": RANKED_SQL,
    "op10_threshold_top_k": TOP_K_SQL,
    "op6_quality_rules": QUALITY_SQL,
}
