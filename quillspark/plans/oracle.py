"""DuckDB SQL for the catalogue's queries, built from common table expressions.

The tokenizer has no look-around there: separators inside words and numbers become markers first.
Oracles run without stemming; stems are tested by themselves.
"""

from __future__ import annotations

from quillspark.functions.analysis import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))


def _marked(text: str) -> str:
    t = text
    for _ in range(2):
        t = rf"regexp_replace({t}, '([\p{{L}}\p{{M}}])\.(\p{{L}})', '\1' || chr(57344) || '\2', 'g')"
        t = rf"regexp_replace({t}, '(\p{{Nd}})\.(\p{{Nd}})', '\1' || chr(57344) || '\2', 'g')"
        t = rf"regexp_replace({t}, '(\p{{Nd}}),(\p{{Nd}})', '\1' || chr(57345) || '\2', 'g')"
    return t


def all_words(text: str) -> str:
    found = rf"regexp_extract_all({_marked(text)}, '[\p{{L}}\p{{M}}\p{{N}}_\x{{E000}}\x{{E001}}]+')"
    return rf"list_filter(list_transform({found}, lambda x: replace(replace(x, chr(57344), '.'), chr(57345), ',')), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]'))"


def words(text: str) -> str:
    return f"list_filter(list_transform({all_words(text)}, lambda x: replace(lower(x), 'ё', 'е')), lambda x: x NOT IN ({_STOP}))"


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CLEAN = _TRIM.format("coalesce(text, '')")
DOCS = rf"""
raw AS (SELECT doc_id::VARCHAR AS id, {_CLEAN} AS t, coalesce(octet_length(encode(text)), 0)::BIGINT AS size FROM documents),
line AS (SELECT *, {_TRIM.format("split_part(t, chr(10), 1)")} AS first FROM raw),
docs AS (
  SELECT id, CASE WHEN length(first) > 200 THEN id ELSE first END AS title,
         CASE WHEN length(first) > 200 THEN t WHEN contains(t, chr(10)) THEN {_TRIM.format("substr(t, instr(t, chr(10)) + 1)")} ELSE '' END AS body, size
  FROM line)"""
TOKENS = f"""{DOCS},
a AS (SELECT id, {words("title")} AS tw, {words("body")} AS bw FROM docs),
lens AS (SELECT id, (2 * len(tw) + len(bw))::BIGINT AS len FROM a),
tok AS (
  SELECT id, unnest(tw) AS term, generate_subscripts(tw, 1) - 1 AS pos, 1 AS title FROM a
  UNION ALL SELECT id, unnest(bw), generate_subscripts(bw, 1) - 1 + len(tw) + 100, 0 FROM a),
post AS (SELECT term, id, list(pos ORDER BY pos) AS positions, sum(title)::BIGINT AS title_tf, (count(*) + sum(title))::BIGINT AS tf FROM tok GROUP BY term, id),
stat AS (SELECT count(*) AS n, sum(len)::BIGINT AS total_len, sum(len) / count(*) AS avgdl FROM lens),
vocab AS (SELECT term AS word, count(DISTINCT id) AS df FROM tok GROUP BY term)"""


def scored(weights: str, members: str = "") -> str:
    """CTEs up to ``base`` (id, s): weighted BM25 sums over a list of (term, weight) values."""
    return f"""{TOKENS},
q(term, w) AS (VALUES {weights}),
dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY term),
hit AS (SELECT p.id, p.term, p.positions, q.w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.len / avgdl)) AS s
  FROM post p JOIN q USING (term) JOIN dfs USING (term) JOIN lens l ON l.id = p.id CROSS JOIN stat),
base AS (SELECT id, sum(s) AS s, list(DISTINCT term) AS matched FROM hit GROUP BY id)"""


def near(groups: str) -> str:
    """CTE ``bonus`` (id, b) for (term, grp) values: the smallest window over one position of each group present."""
    return f""",
grp(term, g) AS (VALUES {groups}),
gp AS (SELECT DISTINCT t.id, g, pos FROM tok t JOIN grp USING (term)),
m AS (SELECT id, count(DISTINCT g) AS m FROM gp GROUP BY id HAVING count(DISTINCT g) >= 2),
nxt AS (SELECT s.id, s.pos, e.g, min(e.pos) AS p FROM (SELECT DISTINCT id, pos FROM gp) s JOIN gp e ON e.id = s.id AND e.pos >= s.pos GROUP BY s.id, s.pos, e.g),
win AS (SELECT nxt.id, max(p) - pos + 1 AS w FROM nxt JOIN m USING (id) GROUP BY nxt.id, pos, m HAVING count(*) = m),
bonus AS (SELECT id, (m - 1)::DOUBLE / greatest(1, min(w) + 1 - m) AS b FROM win JOIN m USING (id) GROUP BY id, m)"""


def ranked(where: str = "true", bonus: bool = False, limit: int = 10, offset: int = 0) -> str:
    total = "s + coalesce(b, 0)" if bonus else "s"
    join = "LEFT JOIN bonus USING (id)" if bonus else ""
    return f" SELECT id, round({total}, 6) AS score FROM base {join} WHERE {where} ORDER BY {total} DESC, id LIMIT {limit} OFFSET {offset}"


def located(source: str, terms: list[str]) -> str:
    """CTEs ``loc`` (id, body, k, s, e, sep, w, hit) of the words of ``source`` (id, body): their order, places, what stands before them."""
    w = r"[\p{L}\p{M}\p{N}_\x{E000}\x{E001}]"
    wanted = ", ".join(f"'{t}'" for t in terms)
    return rf"""
piece AS (SELECT id, body, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT id, body, regexp_extract_all({_marked('body')}, '[^\p{{L}}\p{{M}}\p{{N}}_\x{{E000}}\x{{E001}}]*{w}+') AS p FROM {source})),
token AS (SELECT id, body, k, regexp_extract(piece, '{w}+$') AS w, (sum(length(piece)) OVER (PARTITION BY id ORDER BY k))::BIGINT AS e FROM piece),
loc AS (
  SELECT id, body, row_number() OVER (PARTITION BY id ORDER BY k) AS k, e - length(w) AS s, e, coalesce(replace(lower(w), 'ё', 'е') IN ({wanted}), false) AS hit
  FROM token WHERE regexp_matches(w, '[\p{{L}}\p{{N}}]'))"""


def phrase(terms: list[str]) -> str:
    joins = " ".join(f"JOIN tok t{k} ON t{k}.id = t0.id AND t{k}.pos = t0.pos + {k} AND t{k}.term = '{t}'" for k, t in enumerate(terms[1:], 1))
    return f"id IN (SELECT t0.id FROM tok t0 {joins} WHERE t0.term = '{terms[0]}')"


#: Operations from the events table: an id's log, with some versions that come late.
OPS = """
ops AS (
  SELECT user_id::VARCHAR AS id, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'evict' ELSE 'put' END AS op,
         event_id - (event_id % 7) * 40 AS version, event_type AS payload,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE user_id IS NOT NULL),
fold AS (
  SELECT id, 0::BIGINT AS k, false AS live, false AS dead, 0::BIGINT AS version, NULL::VARCHAR AS payload, 0::BIGINT AS applied FROM (SELECT DISTINCT id FROM ops)
  UNION ALL
  SELECT f.id, o.k,
    CASE WHEN x.act IN ('add', 'put') THEN true WHEN x.act IN ('delete', 'evict') THEN false ELSE f.live END,
    CASE WHEN x.act IN ('add', 'put', 'evict') THEN false WHEN x.act = 'delete' THEN true ELSE f.dead END,
    CASE WHEN x.act = 'evict' THEN 0 WHEN x.act IS NOT NULL THEN o.version ELSE f.version END,
    CASE WHEN x.act IN ('add', 'put') THEN o.payload WHEN x.act IS NOT NULL THEN NULL ELSE f.payload END,
    f.applied + CASE WHEN x.act IS NULL THEN 0 ELSE 1 END
  FROM fold f JOIN ops o ON o.id = f.id AND o.k = f.k + 1,
  LATERAL (SELECT CASE
    WHEN o.op = 'add' AND NOT f.live AND (NOT f.dead OR o.version > f.version) THEN 'add'
    WHEN o.op = 'put' AND ((NOT f.live AND NOT f.dead) OR o.version > f.version) THEN 'put'
    WHEN o.op = 'delete' AND ((NOT f.live AND NOT f.dead) OR o.version > f.version) THEN 'delete'
    WHEN o.op = 'evict' AND f.live AND f.version <= o.version THEN 'evict' END AS act) x),
final AS (SELECT id, live, dead, version, payload, applied FROM fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1)"""
