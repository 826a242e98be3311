"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Groups of a table ``link`` (x, y): the smallest id that each linked id reaches.
_REACHED = """
pair AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(id, top) AS (SELECT x, x FROM pair UNION SELECT b.y, r.top FROM reach r JOIN pair b ON b.x = r.id),
low AS (SELECT id, min(top) AS top FROM reach GROUP BY id)"""

ORACLE = {
    "op1_ngram_join": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
{_REACHED}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low.top, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.id = d.doc_id""",
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS t FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, i FROM win JOIN (SELECT t FROM win GROUP BY t HAVING count(*) > 1) USING (t)),
gone AS (SELECT DISTINCT r, i + o AS k FROM rep, (SELECT unnest(range(35)) AS o)),
word AS (SELECT r, unnest(w) AS v, generate_subscripts(w, 1) AS k FROM d),
kept AS (SELECT r, string_agg(v, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (r, k) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)""",
    "op3_suffix_array": """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT r, i, b[i : i + 199] AS t FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
rep AS (SELECT r, i FROM win JOIN (SELECT t FROM win GROUP BY t HAVING count(*) > 1) USING (t)),
edge AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 200, 0) AS fresh FROM rep),
run AS (SELECT r, i, sum(fresh::INTEGER) OVER (PARTITION BY r ORDER BY i) AS g FROM edge),
span AS (SELECT r, g, min(i) AS a, max(i) + 200 AS z FROM run GROUP BY r, g),
lost AS (SELECT r, sum(z - a) AS n, count(*) AS spans FROM span GROUP BY r),
piece AS (
  SELECT r, a AS z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS a FROM span
  UNION ALL SELECT d.r, octet_length(b) + 1, coalesce(max(z), 1) FROM d LEFT JOIN span ON span.r = d.r GROUP BY d.r, b),
kept AS (SELECT r, string_agg(CASE WHEN p.z > p.a THEN hex(b[p.a : p.z - 1]) ELSE '' END, '' ORDER BY p.a) AS t FROM piece p JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(lost.n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.t)) AS kept_sha256
FROM d LEFT JOIN lost USING (r) JOIN kept USING (r)""",
    "op10_embedding_near_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
{_REACHED},
n AS (SELECT x, count(*) AS n FROM pair GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(low.top, vec_id) AS component_id, coalesce(low.top, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN low ON low.id = vec_id""",
    "op6_mixing": f"""
WITH s AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('mix-1|' || doc_id::VARCHAR) AS rank FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         sum(source_size) OVER () * 1.5::DOUBLE AS total, source_size * 2.0::DOUBLE AS cap FROM t),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT *, least(cap, max(CASE WHEN level <= ratio THEN level END) OVER () * weight) AS target FROM l),
p AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
c AS (
  SELECT s.*, p.source_size, p.target, p.whole, round(p.target - p.whole * p.source_size)::BIGINT AS part,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.rank, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, part - before)))::BIGINT AS taken FROM c
""",
}
