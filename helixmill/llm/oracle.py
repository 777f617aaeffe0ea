"""DuckDB SQL for the queries of the training-data operators that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BM25 = f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS t FROM documents),
tf AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
df AS (SELECT t, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY t),
m AS (SELECT (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS mean),
s AS (SELECT q.doc_id AS query, tf.doc_id, round(sum(idf * tf.tf * 2.2 / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score
  FROM tf q JOIN df USING (t) JOIN tf ON tf.t = q.t JOIN dl ON dl.doc_id = tf.doc_id, m WHERE q.doc_id % 20 = 0 GROUP BY ALL)
SELECT query, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


def _spans(kind: str, pattern: str, holds: str) -> str:
    """doc_id, kind, start and stop of a pattern's matches, placed by the gaps between them."""
    return f"""
SELECT doc_id, '{kind}' AS kind, stop - n AS start, stop FROM (
  SELECT doc_id, v, length(v) AS n, sum(length(g) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
    SELECT doc_id, unnest(f) AS v, unnest(s[:len(f)]) AS g, unnest(range(len(f))) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS f, regexp_split_to_array(text, '{pattern}') AS s FROM documents) WHERE len(f) > 0)) WHERE {holds}"""


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["\'\']?\x20*[:=]\x20*["\'\']?([A-Za-z0-9+/_.=-]+)""".replace("\\'", "'")

SECRETS = f"""
WITH x AS (
  SELECT *, 0 AS k FROM ({_spans("assign", ASSIGN, f"length(regexp_extract(v, '{ASSIGN}', 1)) >= 8")})
  UNION ALL SELECT *, 1 FROM ({_spans("access", "AKIA[A-Z0-9]+", "n >= 16")})
  UNION ALL SELECT *, 2 FROM ({_spans("hex", "[0-9a-f]+", "n >= 32")})),
y AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN y USING (doc_id)
"""

TRIE = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS at FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, c - c % 5 AS b, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
  lambda r, v: list_reduce(list_prepend(xor(r, v), list_transform(range(8), lambda j: 0::BIGINT)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) ) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT cs.c, t.at AS k, t.role, t.text FROM cs JOIN t ON t.c = cs.b AND t.at <= h UNION ALL SELECT cs.c, t.at + 1000000, t.role, t.text FROM cs JOIN t ON t.c = cs.c AND t.at > h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, role, text FROM r),
p AS MATERIALIZED (SELECT c, 0 AS d, 0 AS n, '' AS x, '' AS px FROM cs UNION ALL
  SELECT c, d, n, x, coalesce(lag(x) OVER (PARTITION BY c ORDER BY d), '') FROM (SELECT c, d, strlen(text) AS n, string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY c ORDER BY d) AS x FROM q)),
e AS (SELECT c, max(d) AS last FROM p GROUP BY c),
nodes AS MATERIALIZED (SELECT x, any_value(px) AS px, any_value(d) AS d, any_value(n) AS n, min(p.c) AS c, count(*) AS m, sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (d = last), '')) AS ends FROM p JOIN e ON e.c = p.c GROUP BY x),
kids AS (SELECT px AS x, count(*) AS k FROM nodes WHERE d > 0 GROUP BY px),
below AS (SELECT a.x, count(*) FILTER (kids.k IS NULL) AS leaves, sum((b.m - 1) * b.n) AS saved FROM nodes a JOIN nodes b ON starts_with(b.x, a.x) LEFT JOIN kids ON kids.x = b.x GROUP BY a.x)
SELECT nodes.c AS conv_id, nodes.d::BIGINT AS depth, CASE WHEN nodes.d > 0 THEN up.c END AS parent_conv_id, nodes.m AS n_convs, coalesce(kids.k, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes JOIN below USING (x) LEFT JOIN kids USING (x) JOIN nodes up ON up.x = nodes.px
"""

NEGATIVES = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS anchor, a.label AS of, b.id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON b.id <> a.id WHERE a.id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS r FROM s WHERE label = of) WHERE r <= 5)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INT AS rank, id AS negative_id, positive_score, score AS negative_score FROM (
  SELECT p.anchor, p.id AS positive, p.score AS positive_score, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND s.label <> p.of AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score) WHERE rank <= 3
"""

ORACLE: dict[str, str] = {"op1_secret_scan": SECRETS, "op2_topk_search": BM25, "op11_hard_negatives": NEGATIVES, "op13_prefix_trie": TRIE}
