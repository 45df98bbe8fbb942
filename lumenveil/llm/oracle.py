"""DuckDB SQL with the same rows as the queries, where SQL can express them."""

from __future__ import annotations

OP8 = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split(translate(regexp_replace(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' '), lambda w: w <> '') AS w FROM documents),
bw AS (
  SELECT item_id, list_filter(string_split(translate(regexp_replace(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' '), lambda w: w <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, i, i + least(13, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
cand AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT a.doc_id, a.i, a.n, v.item_id FROM cand a JOIN win v ON a.n = v.n AND a.g = v.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
  coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN pos p USING (doc_id) LEFT JOIN its t USING (doc_id)
"""
OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY d)
SELECT p.page_id, CAST(octet_length(p.b) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN g.first IS NULL OR g.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.first IS NULL OR g.first = p.page_id THEN NULL ELSE g.first END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND octet_length(p.b) >= 100
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
d AS (SELECT q.vec_id AS query_id, o.vec_id, list_distance(q.e, o.e) AS score
  FROM q JOIN v o ON o.vec_id <> q.vec_id AND len(q.e) = len(o.e))
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS r FROM d) WHERE r <= 10
"""

OP6 = r"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT a, NULL, b, r, t FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(a, b, r, t)),
o AS (SELECT *, row_number() OVER w - 1 AS i, lag(r) OVER w AS p, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn DESC NULLS LAST, r DESC, t DESC) AS back
  FROM c WINDOW w AS (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, r, t)),
k AS (SELECT *, CASE WHEN p IS NULL AND i = 0 THEN r IN ('system', 'user') WHEN p = 'system' THEN r = 'user' WHEN p = 'user' THEN r = 'assistant' WHEN p = 'assistant' THEN r = 'user' ELSE false END AS ok,
  30 + length(r) + length(t) + length(regexp_replace(r || t, '[^<\[\\]', '', 'g')) AS n FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY i) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, bool_and(ok) AND bool_or(back = 1 AND r = 'assistant') AS valid, CAST(min(i) FILTER (WHERE NOT ok) AS INTEGER) AS first_invalid
FROM k GROUP BY conv_id, own
"""

ORACLE = {"op6_chat": OP6, "op2_warc": OP2, "op4_neighbours": OP4, "op8_decontaminate": OP8}
