"""The named queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.analysis import analyze, word_count, words
from quillspark.operators import index as ix
from quillspark.operators import listing, store
from quillspark.operators import search as se
from quillspark.operators import suggest as su
from quillspark.operators.highlight import plain, with_highlight
from quillspark.plans import catalog_store
from quillspark.plans import oracle as o
from quillspark.plans.query import Query, parse_query
from quillspark.sources import corpus, files
from quillspark.sources.shared import read_table, shared_dir

_CACHE: dict[tuple, ix.Index] = {}
OR_Q, AND_Q = "anon the onan ention", "ble onan"
PHRASE = "er \"er ble\""
FUZZY = "tionthing"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.from_table(read_table(spark, f"{sf_dir}/documents.parquet"), "doc_id", "text")


def index(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> ix.Index:
    """The index of a folder's documents; its tables stay on the executors' disks for later queries.

    One index is kept: another folder, changed files or a new session make a new one and free the old.
    """
    key = (spark.sparkContext.applicationId, sf_dir, stemmed, files.signature(spark, f"{sf_dir}/documents.parquet"))
    if key not in _CACHE:
        from pyspark import StorageLevel

        release()
        got = ix.build_index(documents(spark, sf_dir), stemmed, StorageLevel.DISK_ONLY)
        got.postings = got.postings.persist(StorageLevel.DISK_ONLY)
        got.words = got.words.persist(StorageLevel.DISK_ONLY)
        got.terms = ix.frequencies(got.postings).persist(StorageLevel.DISK_ONLY)
        _CACHE[key] = got
    return _CACHE[key]


def release() -> None:
    """Frees the kept index."""
    for kept in _CACHE.values():
        for part in (kept.postings, kept.words, kept.terms, *kept.kept):
            try:
                part.unpersist()
            except Exception:  # noqa: BLE001  its session is gone, and what it kept with it
                break
    _CACHE.clear()


def _ranked(found: DataFrame, offset: int = 0, size: int = 10) -> DataFrame:
    return se.page(found, offset, size).select("id", F.round("score", 6).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = se.search(ix.build_index(documents(spark, sf_dir)), 'reering "er" anon ention', fuzzy=True).hits
    return hits.select("id", "title", "score", plain(F.col("snippet")).alias("snippet"))


def _search(query: Query | str, all_terms: bool = False, near: bool = False, offset: int = 0, size: int = 10):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        i = index(spark, sf_dir)
        q = parse_query(query, False) if isinstance(query, str) else query
        return _ranked(se.matches(i, q, all_terms, near), offset, size)

    return run


def _fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index(spark, sf_dir)
    return _ranked(se.matches(i, se.plan(i, FUZZY, fuzzy=True, use_synonyms=False), near=False))


def _prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index(spark, sf_dir)
    return _ranked(se.matches(i, se.plan(i, "anon", prefix=True, use_synonyms=False), near=False))


def _total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.matches(index(spark, sf_dir), parse_query(OR_Q, False), near=False).agg(F.count("*").alias("total"))


def _expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([("anon",), ("onand",), (FUZZY,)], "term string")
    return su.expand(terms, index(spark, sf_dir).terms)


def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = su.complete(index(spark, sf_dir).words, "an", False)
    return spark.createDataFrame([(w,) for w in found], "term string")


def _suggest_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ix.analyzed(documents(spark, sf_dir), False)
    w = (
        a.select((F.col("id").cast("long") % 3).alias("shard"), F.explode(F.array_distinct(F.concat("title_words", "body_words"))).alias("word"))
        .groupBy("shard", "word")
        .agg(F.count("*").alias("df"))
    )
    return su.suggest_sharded(w, "th")


def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), words(F.col("text")).alias("terms"))
    return se.bulk_search(index(spark, sf_dir), q, 3).select("query_id", "id", F.round("score", 6).alias("score"))


def ops(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet") if events is None else events
    kind = (
        F.when(F.col("event_type") == "signup", "add")
        .when(F.col("event_type") == "error", "delete")
        .when(F.col("event_type") == "view", "evict")
        .otherwise("put")
    )
    return e.where("user_id is not null").select(
        F.col("user_id").cast("string").alias("id"),
        F.col("event_id").alias("seq"),
        kind.alias("op"),
        (F.col("event_id") - F.col("event_id") % 7 * 40).alias("version"),
        F.col("event_type").alias("payload"),
    )


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from quillspark.streaming.store_stream import run_to_table

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:8]}"
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return run_to_table(ops(spark, sf_dir, events), f"{out}/table", f"{out}/checkpoint").select("id", "live", "dead", "version", "payload")


def _replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the entries, each without some operations."""
    log, parts = ops(spark, sf_dir), []
    for k in (0, 1):
        e = store.entries(store.fold(log.where(F.col("seq") % 5 != k)))
        parts.append(e.select(F.lit(k).alias("replica"), "*"))
    return parts[0].union(parts[1])


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", store.shard_for(3)(F.col("id")).alias("shard"))


def _listing(**options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return listing.listing(documents(spark, sf_dir), **options).select("id", "title", "words", "size")

    return run


def _txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"),
    )
    return corpus.extract_files(files).where("error is null").select("id", "title", "body", "size")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "id",
        word_count(F.col("body")).cast("long").alias("all_words"),
        F.size(words(F.col("body"))).cast("long").alias("kept"),
        F.array_join(F.slice(words(F.col("body")), 1, 20), " ").alias("head"),
    )


def _all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.array_join(words(F.col("body")), " ").alias("words"))


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", analyze(F.col("body")).alias("terms"))


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.search(index(spark, sf_dir), "anon onan", near=False).hits.select("id", plain(F.col("snippet")).alias("snippet"))


def _highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_highlight(documents(spark, sf_dir), "anon onan", stemmed=False).select("id", F.col("matches").cast("long").alias("matches"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body with its highlighted segments in brackets."""
    rows = with_highlight(documents(spark, sf_dir), "anon onan", stemmed=False)
    text = F.transform("highlight", lambda s: F.when(s["hl"], F.concat(F.lit("["), s["text"], F.lit("]"))).otherwise(s["text"]))
    return rows.select("id", F.array_join(text, "").alias("marked"))


def _indexed(f):
    return lambda spark, sf_dir: f(index(spark, sf_dir))


_OR = Query(["anon", "ention", "onan"])
_SYN = Query(["anon", "ble"], [], {"anon": ["ention"], "ble": ["onan"]})
_MULTI = parse_query('"er ble" "in er"', False)

_QUERIES = {
    "analyze_words": _words,
    "analyze_all_words": _all_words,
    "analyze_stems": _stems,
    "index_postings": _indexed(
        lambda i: i.postings.select(
            "term",
            "id",
            F.col("title_tf").cast("long").alias("title_tf"),
            F.col("tf").cast("long").alias("tf"),
            F.col("positions")[0].cast("long").alias("first_pos"),
        )
    ),
    "index_positions": _indexed(
        lambda i: i.postings.select("term", "id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))
    ),
    "index_doc_lengths": _indexed(lambda i: i.lengths),
    "index_stats": _indexed(lambda i: ix.statistics(i.lengths).select("n", "total_len", F.round("avgdl", 6).alias("avgdl"))),
    "vocabulary": _indexed(lambda i: i.words),
    "term_idf": _indexed(
        lambda i: i.postings.groupBy("term").agg(F.count("*").alias("df")).select(
            "term",
            "df",
            F.round(se.idf(F.lit(i.n), F.col("df")), 6).alias("idf"),
        )
    ),
    "search_or": _search(OR_Q),
    "search_and": _search(AND_Q, True),
    "search_phrase": _search(PHRASE),
    "search_multi_phrase": _search(_MULTI),
    "search_proximity": _search(_OR, near=True),
    "search_synonyms_and": _search(_SYN, True, True),
    "search_paged": _search(OR_Q, offset=10, size=15),
    "search_total": _total,
    "search_fuzzy": _fuzzy,
    "search_prefix": _prefix,
    "expand_fuzzy": _expand,
    "complete_prefix": _complete,
    "suggest": _indexed(lambda i: su.suggest(i.words, " Th ")),
    "suggest_sharded": _suggest_sharded,
    "snippet": _snippets,
    "highlight": _highlight,
    "highlight_marked": _marked,
    "list_docs_id": _listing(),
    "list_docs_title_desc": _listing(sort="title", desc=True, size=20),
    "list_docs_size": _listing(sort="size", size=30),
    "list_docs_after": _listing(sort="size", after=f"{400:020d}{listing.SEPARATOR}5", size=25),
    "store_fold": lambda s, d: store.fold(ops(s, d)),
    "store_entries": lambda s, d: store.entries(store.fold(ops(s, d))),
    "digest": lambda s, d: store.digest(store.entries(store.fold(ops(s, d)))),
    "replica_diff": lambda s, d: store.replica_diff(_replicas(s, d)),
    "misplaced": lambda s, d: store.misplaced(_placed(s, d), 4),
    "rebalance_plan": lambda s, d: store.rebalance_plan(store.misplaced(_placed(s, d), 4)),
    "extract_txt": _txt,
    "bulk_bm25": _bulk,
    "stream_store": _stream,
}


def queries():
    return _QUERIES | catalog_store.QUERIES


def _replica_sql() -> str:
    parts = []
    for k in (0, 1):
        part = (
            o.OPS.replace("FROM events WHERE", f"FROM events WHERE event_id % 5 != {k} AND")
            .replace("ops AS", f"ops{k} AS")
            .replace("fold AS", f"fold{k} AS")
            .replace("final AS", f"final{k} AS")
            .replace("FROM ops)", f"FROM ops{k})")
            .replace("FROM fold f JOIN ops o", f"FROM fold{k} f JOIN ops{k} o")
            .replace("FROM fold QUALIFY", f"FROM fold{k} QUALIFY")
        )
        parts.append(part)
    return f"""WITH RECURSIVE {parts[0]}, {parts[1]},
e AS (SELECT 0 AS replica, id, version, dead AS deleted FROM final0 WHERE live OR dead UNION ALL SELECT 1, id, version, dead FROM final1 WHERE live OR dead),
best AS (SELECT id, version, deleted FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, deleted DESC) = 1)
SELECT r.replica, b.id, b.version, b.deleted, CASE WHEN b.deleted THEN 'delete' ELSE 'copy' END AS action
FROM best b CROSS JOIN (SELECT unnest([0, 1])::INTEGER AS replica) r LEFT JOIN e ON e.replica = r.replica AND e.id = b.id
WHERE e.id IS NULL OR e.version < b.version OR (e.version = b.version AND NOT e.deleted AND b.deleted)"""


_INFO = f"SELECT id, title, len({o.all_words('body')})::BIGINT AS words, size FROM docs"


def oracle_sql() -> dict[str, str]:
    t = f"WITH {o.TOKENS}"
    anon = "('anon', 1.0), ('ention', 1.0), ('onan', 1.0)"
    # the distance there counts bytes, and the terms asked for are ASCII
    band = r"abs(length(word) - length(q)) <= most AND (CASE WHEN most = 0 THEN word = q ELSE levenshtein(regexp_replace(word, '[^\x00-\x7F]', '?', 'g'), q) <= most END)"
    near_q = "(SELECT q, CASE WHEN length(q) <= 4 THEN 0 WHEN length(q) <= 8 THEN 1 ELSE 2 END AS most FROM (SELECT unnest({}) AS q))"
    fuzzy = f"SELECT word, 0.5 FROM vocab, {near_q.format(repr([FUZZY]))} WHERE {band} AND word <> '{FUZZY}' UNION ALL SELECT '{FUZZY}', 1.0"
    prefix = "SELECT word, CASE WHEN word = 'anon' THEN 1.0 ELSE 0.5 END FROM (SELECT word FROM vocab WHERE starts_with(word, 'anon') ORDER BY df DESC, word LIMIT 50) UNION SELECT 'anon', 1.0"
    info = f"WITH {o.DOCS} {_INFO}"
    replica_diff = _replica_sql()
    return catalog_store.oracle_sql(replica_diff) | {
        "analyze_words": f"WITH {o.DOCS} SELECT id, len({o.all_words('body')})::BIGINT AS all_words, len({o.words('body')})::BIGINT AS kept, array_to_string({o.words('body')}[1:20], ' ') AS head FROM docs",
        "analyze_all_words": f"WITH {o.DOCS} SELECT id, array_to_string({o.words('body')}, ' ') AS words FROM docs",
        "index_positions": f"{t} SELECT term, id, array_to_string(positions, ',') AS positions FROM post",
        "index_postings": f"{t} SELECT term, id, title_tf, tf, positions[1]::BIGINT AS first_pos FROM post",
        "index_doc_lengths": f"{t} SELECT id, len FROM lens",
        "index_stats": f"{t} SELECT n, total_len, round(avgdl, 6) AS avgdl FROM stat",
        "vocabulary": f"{t} SELECT word, df FROM vocab",
        "term_idf": f"{t} SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM post CROSS JOIN stat GROUP BY term",
        "search_or": f"WITH {o.scored(anon)} {o.ranked()}",
        "search_and": f"WITH {o.scored("('ble', 1.0), ('onan', 1.0)")} {o.ranked('len(matched) = 2')}",
        "search_phrase": f"WITH {o.scored("('er', 1.0), ('ble', 1.0)")} {o.ranked(o.phrase(['er', 'ble']))}",
        "search_multi_phrase": f"WITH {o.scored("('er', 1.0), ('ble', 1.0)")} {o.ranked(o.phrase(['er', 'ble']) + ' AND ' + o.phrase(['er']))}",
        "search_proximity": f"WITH {o.scored(anon)} {o.near("('anon', 0), ('ention', 1), ('onan', 2)")} {o.ranked(bonus=True)}",
        "search_synonyms_and": f"WITH {o.scored("('anon', 1.0), ('ble', 1.0), ('ention', 0.5), ('onan', 0.5)")} {o.near("('anon', 0), ('ention', 0), ('ble', 1), ('onan', 1)")} {o.ranked("list_has_any(matched, ['anon', 'ention']) AND list_has_any(matched, ['ble', 'onan'])", True)}",
        "search_paged": f"WITH {o.scored(anon)} {o.ranked(limit=15, offset=10)}",
        "search_total": f"WITH {o.scored(anon)} SELECT count(*) AS total FROM base",
        "search_fuzzy": f"WITH {o.scored('(NULL, 0.0)').replace('(VALUES (NULL, 0.0))', f'({fuzzy})')} {o.ranked()}",
        "search_prefix": f"WITH {o.scored('(NULL, 0.0)').replace('(VALUES (NULL, 0.0))', f'({prefix})')} {o.ranked()}",
        "expand_fuzzy": f"{t} SELECT q AS term, word AS variant FROM vocab, {near_q.format(repr(['anon', 'onand', FUZZY]))} WHERE {band}",
        "complete_prefix": f"{t} SELECT word AS term FROM (SELECT word FROM vocab WHERE starts_with(word, 'an') ORDER BY df DESC, word LIMIT 50)",
        "suggest": f"{t} SELECT word, df AS count FROM vocab WHERE starts_with(word, 'th') ORDER BY df DESC, word LIMIT 10",
        "suggest_sharded": f"{t} SELECT word, sum(df)::BIGINT AS count FROM (SELECT id::BIGINT % 3 AS shard, term AS word, count(DISTINCT id) AS df FROM tok WHERE starts_with(term, 'th') GROUP BY id::BIGINT % 3, term QUALIFY row_number() OVER (PARTITION BY shard ORDER BY df DESC, word) <= 10) GROUP BY word ORDER BY count DESC, word LIMIT 10",
        "digest": f"WITH RECURSIVE {o.OPS} SELECT count(*) AS count, coalesce(sum(('0x' || substr(md5(id || chr(0) || version || chr(0) || dead), 1, 15))::BIGINT), 0)::HUGEINT::VARCHAR AS hash FROM final WHERE live OR dead",
        "snippet": f"""WITH {o.scored("('anon', 1.0), ('onan', 1.0)")},
top AS (SELECT base.id, body FROM base JOIN docs ON docs.id = base.id ORDER BY s DESC, base.id LIMIT 10), {o.located('top', ['anon', 'onan'])},
n AS (SELECT id, body, count(*) AS n, coalesce(min(CASE WHEN hit THEN k END), 1) - 1 AS first FROM loc GROUP BY id, body),
b AS (SELECT *, least(greatest(first - 15, 0) + 30, n) AS stop, greatest(least(greatest(first - 15, 0) + 30, n) - 30, 0) AS start FROM n)
SELECT top.id, CASE WHEN b.id IS NULL THEN '' ELSE substr(top.body, x.s + 1, y.e - x.s) END AS snippet FROM top LEFT JOIN b ON b.id = top.id
LEFT JOIN loc x ON x.id = b.id AND x.k = b.start + 1 LEFT JOIN loc y ON y.id = b.id AND y.k = b.stop""",
        "highlight_marked": f"""WITH {o.DOCS}, {o.located('docs', ['anon', 'onan'])},
part AS (SELECT id, body, k, e, substr(body, lag(e, 1, 0::BIGINT) OVER (PARTITION BY id ORDER BY k) + 1, s - lag(e, 1, 0::BIGINT) OVER (PARTITION BY id ORDER BY k)) || CASE WHEN hit THEN '[' || substr(body, s + 1, e - s) || ']' ELSE substr(body, s + 1, e - s) END AS t FROM loc),
all_parts AS (SELECT id, string_agg(t, '' ORDER BY k) || substr(any_value(body), max(e) + 1) AS t FROM part GROUP BY id)
SELECT docs.id, coalesce(t, body) AS marked FROM docs LEFT JOIN all_parts ON all_parts.id = docs.id""",
        "highlight": f"WITH {o.DOCS} SELECT id, len(list_filter({o.words('body')}, lambda x: x IN ('anon', 'onan')))::BIGINT AS matches FROM docs",
        "list_docs_id": f"{info} ORDER BY id LIMIT 51",
        "list_docs_title_desc": f"{info} ORDER BY lower(title) DESC, id DESC LIMIT 21",
        "list_docs_size": f"{info} ORDER BY size, id LIMIT 31",
        "list_docs_after": f"{info} WHERE (size, id) > (400, '5') ORDER BY size, id LIMIT 26",
        "store_fold": f"WITH RECURSIVE {o.OPS} SELECT id, live, dead, version, payload, applied FROM final",
        "store_entries": f"WITH RECURSIVE {o.OPS} SELECT id, version, dead AS deleted FROM final WHERE live OR dead",
        "stream_store": f"WITH RECURSIVE {o.OPS} SELECT id, live, dead, version, payload FROM final",
        "replica_diff": replica_diff,
        "extract_txt": f"WITH {o.DOCS} SELECT id, title, body, size FROM docs WHERE title <> '' OR body <> ''",
        "bulk_bm25": f"""{t},
q AS (SELECT DISTINCT item_id AS query_id, unnest({o.words('text')}) AS term FROM benchmark),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
hit AS (SELECT query_id, p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.len / avgdl))) AS s
  FROM post p JOIN q USING (term) JOIN dfs USING (term) JOIN lens l ON l.id = p.id CROSS JOIN stat GROUP BY query_id, p.id)
SELECT query_id, id, round(s, 6) AS score FROM hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) <= 3""",
    }
