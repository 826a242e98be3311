"""Queries over the durable store, index upkeep, ingestion and listings, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.analysis import words
from quillspark.operators import index as ix
from quillspark.operators import listing, store
from quillspark.operators import search as se
from quillspark.operators.docstore import DocumentStore
from quillspark.plans import oracle as o
from quillspark.sources import corpus
from quillspark.sources.shared import read_table, shared_dir

#: Versions of the events' operations are moved up by this, so that all are given ones.
SHIFT = 1_000_000
NOW = 1_700_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.plans.catalog import documents

    return documents(spark, sf_dir)


def _lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "lang")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _store(spark: SparkSession, **options) -> DocumentStore:
    return DocumentStore(spark, _folder(spark, "store"), **options)


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.plans.catalog import ops

    return ops(spark, sf_dir).select(
        F.col("seq").alias("n"),
        "id",
        "op",
        (F.col("version") + SHIFT).alias("version"),
        F.col("payload").alias("title"),
        F.lit("").alias("body"),
    )


def _in_batches(s: DocumentStore, ops: DataFrame, count: int) -> list[DataFrame]:
    """Applies operations in batches of their order."""
    last = (ops.agg(F.max("n")).first()[0] or 0) + 1
    bounds = [last * k // count for k in range(count + 1)]
    return [s.apply(ops.where((F.col("n") >= a) & (F.col("n") < b))) for a, b in zip(bounds, bounds[1:], strict=False)]


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _in_batches(_store(spark, snapshot_every=10**9), _ops(spark, sf_dir), 3)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("n", "id", "op", "result")


def _entries(s: DocumentStore) -> DataFrame:
    return s.entries().select("id", "version", F.col("dead").alias("deleted"))


def _reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries after batches of stores of their own, with a snapshot between them."""
    root, ops = _folder(spark, "store"), _ops(spark, sf_dir)
    last = (ops.agg(F.max("n")).first()[0] or 0) + 1
    for k in range(4):
        s = DocumentStore(spark, root, snapshot_every=10**9)
        s.apply(ops.where((F.col("n") >= last * k // 4) & (F.col("n") < last * (k + 1) // 4)))
        if k == 1:
            s.snapshot()
    return _entries(DocumentStore(spark, root))


def _unversioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store gives the versions: its clock, or one more than an id's last."""
    s = _store(spark, snapshot_every=10**9, clock=lambda: 5_000_000)
    s.apply(_ops(spark, sf_dir).withColumn("version", F.lit(None).cast("long")))
    return _entries(s)


def _loaded(spark: SparkSession, sf_dir: str) -> DocumentStore:
    """The documents in a store, and the original files of those in English."""
    s = _store(spark)
    files = (
        spark.read.parquet(f"{sf_dir}/documents.parquet")
        .where("lang = 'en'")
        .select(F.col("doc_id").cast("string").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    )
    docs = documents(spark, sf_dir).join(_lang(spark, sf_dir), "id").withColumn("file", F.coalesce(F.col("lang") == "en", F.lit(False))).drop("lang")
    s.add(docs, version=7)
    s.put_files(files)
    return s


def _point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark)
    s.add(documents(spark, sf_dir), version=7)
    s.snapshot()
    return s.get("17").select("id", "title", "body", "format", "size")


def _downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).downloads().select("id", "name", F.md5("content").alias("content_md5"))


def _replica_ops(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return _ops(spark, sf_dir).where(F.col("n") % 5 != k)


def _sync_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas that miss some operations; the entries of the first after it takes over what it lacks."""
    stores = [_store(spark, snapshot_every=10**9) for _ in (0, 1)]
    for k, s in enumerate(stores):
        s.apply(_replica_ops(spark, sf_dir, k))
    both = _entries(stores[0]).withColumn("replica", F.lit(0)).unionByName(_entries(stores[1]).withColumn("replica", F.lit(1)))
    lacks = store.replica_diff(both).where("replica = 0").select("id", "version", "deleted")
    docs = stores[1].documents().select("id", "title", "body")
    stores[0].sync(lacks.join(docs, "id", "left").withColumn("n", F.lit(0)))
    return _entries(stores[0])


def _holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.plans.catalog import ops

    state = store.fold(ops(spark, sf_dir))
    return state.select("id", store.holds(state, 300, False).alias("live_300"), store.holds(state, 300, True).alias("deleted_300"))


def _diff_here(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.plans.catalog import _replicas

    return store.replica_diff(_replicas(spark, sf_dir), F.col("id").cast("long") % 3 == 1)


def _put_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents are replaced by others of their first 30 characters, and as many new ones come."""
    old = (
        documents(spark, sf_dir)
        .join(_lang(spark, sf_dir), "id")
        .withColumn("created", F.lit(5))
        .withColumn("format", F.coalesce("lang", F.lit("txt")))
        .withColumn("file", F.col("id").endswith("3"))
    )
    new = old.where("lang = 'en'").select("id", "title", F.substring("body", 1, 30).alias("body"))
    new = new.union(new.select(F.concat(F.lit("new-"), "id"), "title", "body"))
    return store.put_metadata(old, new, NOW).drop("title", "body")


def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document twice, against those in English: which rows an insert takes."""
    docs = documents(spark, sf_dir).select("id", "size")
    batch = docs.withColumn("seq", F.lit(0)).union(docs.withColumn("seq", F.lit(1)))
    return ix.insert(_lang(spark, sf_dir).where("lang = 'en'"), batch, "seq").select("id", "seq", "indexed")


def _without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary once documents in German are deleted."""
    docs = ix.delete(documents(spark, sf_dir), _lang(spark, sf_dir).where("lang = 'de'"))
    return ix.build_index(docs, False).words


def _updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths once documents in English are replaced by their titles alone."""
    docs = documents(spark, sf_dir)
    new = docs.join(_lang(spark, sf_dir).where("lang = 'en'").select("id"), "id", "left_semi").withColumn("body", F.lit(""))
    return ix.build_index(ix.update(docs, new), False).lengths


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.plans.catalog import index

    i = index(spark, sf_dir)
    return ix.inventory(i.docs, i.postings, (F.col("id").cast("long") % 4).alias("shard"))


def _contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.plans.catalog import index

    i = index(spark, sf_dir)
    asked = i.docs.select("id").union(i.docs.select(F.concat("id", F.lit("x"))))
    return i.contains(asked)


def _formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        documents(spark, sf_dir)
        .join(_lang(spark, sf_dir), "id")
        .withColumn("format", F.coalesce("lang", F.lit("txt")))
        .withColumn("created", F.col("size") * 3)
        .withColumn("updated", F.col("size") + 1)
        .drop("lang")
    )


def _list_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.listing(_formatted(spark, sf_dir), sort="created", desc=True, fmt="en", size=40).drop("key")


def _list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = listing.list_docs(_formatted(spark, sf_dir), sort="size", fmt="en", size=25)
    return spark.createDataFrame([(p.total, len(p.docs), p.next)], "total long, rows long, next string")


def _json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through JSON files, some of them without format, size and time."""
    docs = documents(spark, sf_dir).join(_lang(spark, sf_dir), "id")
    rows = docs.select(
        "id",
        "title",
        "body",
        F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("format"),
        F.when(F.col("lang") == "en", 0).otherwise(F.col("size")).alias("size"),
        F.when(F.col("lang") == "fr", 12).otherwise(0).alias("created"),
    )
    path = _folder(spark, "json")
    rows.write.json(path)
    return corpus.read_json(spark, path, NOW).select("id", "title", "body", "format", "size", "created", "updated", "file")


def _upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a file; English ones exist already, French ones come as an unknown format."""
    rows = read_table(spark, f"{sf_dir}/documents.parquet")
    ext = F.when(F.col("lang") == "fr", ".xyz").otherwise(".TXT")
    files = rows.select(
        F.concat(F.lit("a\\b/"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"),
    )
    return corpus.upload(files, _lang(spark, sf_dir).where("lang = 'en'")).select("path", "status")


def _parse_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return corpus.parse_txt(
        rows.select(
            F.concat(F.lit("dir/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
            F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"),
        )
    ).select("id", "title", "body", "format", "size")


def _extract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every file, broken ones included: texts in German lose their encoding, French ones their extension."""
    rows = read_table(spark, f"{sf_dir}/documents.parquet")
    path = F.concat(F.col("doc_id").cast("string"), F.when(F.col("lang") == "fr", "").otherwise(".txt"))
    broken = F.unhex(F.lit("FF"))
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    content = F.when(F.col("lang") == "de", F.concat(broken, content)).otherwise(content)
    return corpus.extract_files(rows.select(path.alias("path"), content.alias("content"))).select("path", "id", "error")


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring helper over each document's (tf, df) pairs of three terms, one of which no document has."""
    from quillspark.plans.catalog import index

    i = index(spark, sf_dir)
    p = i.postings.where(F.col("term").isin("anon", "ention")).join(i.terms, "term")
    pairs = F.concat(F.collect_list(F.struct("tf", "df")), F.array(F.struct(F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("df"))))
    rows = p.groupBy("id", "len").agg(pairs.alias("pairs"))
    return rows.select("id", F.round(se.bm25(F.col("pairs"), i.n, F.col("len"), F.lit(i.avgdl)), 6).alias("score"))


def _response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response of a search with two terms that must both occur: total and hits."""
    from quillspark.plans.catalog import AND_Q, index

    r = se.search(index(spark, sf_dir), AND_Q, size=7, operator="and", use_synonyms=False, near=False, snippets=False)
    return r.hits.select("id", F.round("score", 6).alias("score"), F.lit(r.total).cast("long").alias("total"))


def _phrases(query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quillspark.plans.catalog import _ranked, index
        from quillspark.plans.query import parse_query

        return _ranked(se.matches(index(spark, sf_dir), parse_query(query, False), near=False), size=30)

    return run


def _bulk(all_terms: bool, phrases: bool):
    """Every benchmark item as a query: all of its words, or any of them with its first three in a row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quillspark.plans.catalog import index

        q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), words(F.col("text")).alias("terms"))
        if phrases:
            q = q.withColumn("phrases", F.array(F.slice("terms", 1, 3)))
        return se.bulk_search(index(spark, sf_dir), q, 5, all_terms).select("query_id", "id", F.round("score", 6).alias("score"))

    return run


#: Documents with synonyms, beside those of the table.
_BAKERY = [
    (900001, "Bread and butter"),
    (900002, "Shop\na loaf with some butter, butter"),
    (900003, "bread"),
    (900004, "Loaf loaf\nbutter far away from any other bread"),
]


def _synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both words of a query or their synonyms, as its plan finds them, with the proximity bonus."""
    more = corpus.from_table(spark.createDataFrame(_BAKERY, "doc_id long, text string"), "doc_id", "text")
    i = ix.build_index(documents(spark, sf_dir).unionByName(more), False)
    found = se.matches(i, se.plan(i, "bread butter"), True, True)
    return se.page(found, 0, 10).select("id", F.round("score", 6).alias("score"))


def _docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a docx file with a paragraph a line, and what is extracted from it."""
    rows = read_table(spark, f"{sf_dir}/documents.parquet").select(
        F.concat("doc_id", F.lit(".docx")).alias("path"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    files = rows.mapInPandas(_docx_files, "path string, content binary")
    return corpus.extract_files(files).select("path", "title", "body", "error")


def _docx_files(parts):
    import io
    import zipfile
    from xml.sax.saxutils import escape

    import pandas as pd

    def packed(text: str) -> bytes:
        paragraphs = "".join(f"<w:p><w:r><w:t>{escape(line, {chr(13): '&#13;'})}</w:t></w:r></w:p>" for line in text.split("\n"))
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{paragraphs}</w:body></w:document>')
        return raw.getvalue()

    for p in parts:
        yield pd.DataFrame({"path": p["path"], "content": [packed(t) for t in p["text"]]})


def _stem_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the whole vocabulary through the column function, against one call for each word."""
    from quillspark.functions.analysis import stem_all

    a = ix.analyzed(documents(spark, sf_dir), False)
    w = ix.vocabulary(a).select("word")
    return w.select("word", stem_all(F.array("word"))[0].alias("stem"))


QUERIES = {
    "store_results": _results,
    "store_reopened": _reopened,
    "store_unversioned": _unversioned,
    "store_point_get": _point_get,
    "store_downloads": _downloads,
    "sync_apply": _sync_apply,
    "holds": _holds,
    "replica_diff_placed": _diff_here,
    "put_metadata": _put_metadata,
    "index_insert": _insert,
    "index_delete": _without,
    "index_update": _updated,
    "index_inventory": _inventory,
    "index_contains": _contains,
    "list_docs_format": _list_format,
    "list_docs_page": _list_page,
    "ingest_json": _json_ingest,
    "upload": _upload,
    "parse_txt": _parse_txt,
    "extract_outcomes": _extract_errors,
    "bm25_helper": _bm25,
    "search_response": _response,
    "search_phrase_found": _phrases('"eriner thanea"'),
    "search_phrases_found": _phrases('attion "thanedble anea eriner" "attion thanedble"'),
    "bulk_all_words": _bulk(True, False),
    "bulk_phrases": _bulk(False, True),
    "search_synonyms": _synonyms,
    "extract_docx": _docx,
    "stem_vocabulary": _stem_vocabulary,
}


def _results_sql(unversioned: bool = False) -> str:
    """The recursive fold with what came of each operation."""
    version = "NULL::BIGINT" if unversioned else f"event_id - (event_id % 7) * 40 + {SHIFT}"
    given = "coalesce(o.version, greatest(5000000, f.version + 1))"
    return f"""
ops AS (
  SELECT user_id::VARCHAR AS id, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'evict' ELSE 'put' END AS op,
         {version} AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE user_id IS NOT NULL),
fold AS (
  SELECT id, 0::BIGINT AS k, false AS live, false AS dead, 0::BIGINT AS version, NULL::VARCHAR AS act, NULL::VARCHAR AS op, false AS was, -1::BIGINT AS seq FROM (SELECT DISTINCT id FROM ops)
  UNION ALL
  SELECT f.id, o.k,
    CASE WHEN x.act IN ('add', 'put') THEN true WHEN x.act IN ('delete', 'evict') THEN false ELSE f.live END,
    CASE WHEN x.act IN ('add', 'put', 'evict') THEN false WHEN x.act = 'delete' THEN true ELSE f.dead END,
    CASE WHEN x.act = 'evict' THEN 0 WHEN x.act IS NOT NULL THEN {given} ELSE f.version END,
    x.act, o.op, f.live, o.seq
  FROM fold f JOIN ops o ON o.id = f.id AND o.k = f.k + 1,
  LATERAL (SELECT CASE
    WHEN o.op = 'add' AND NOT f.live AND {given} > f.version THEN 'add'
    WHEN o.op = 'put' AND ((NOT f.live AND NOT f.dead) OR {given} > f.version) THEN 'put'
    WHEN o.op = 'delete' AND (o.version IS NOT NULL OR f.live) AND {given} > f.version THEN 'delete'
    WHEN o.op = 'evict' AND f.live AND f.version <= coalesce(o.version, 0) THEN 'evict' END AS act) x),
final AS (SELECT id, live, dead, version FROM fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1)"""


def _replicas_sql() -> str:
    """Entries of two replicas that miss some operations, and the newest of each id."""
    parts = []
    for k in (0, 1):
        part = _results_sql().replace("WHERE user_id IS NOT NULL", f"WHERE user_id IS NOT NULL AND event_id % 5 <> {k}")
        for name in ("ops", "fold", "final"):
            part = (
                part.replace(f"{name} AS", f"{name}{k} AS")
                .replace(f"FROM {name} ", f"FROM {name}{k} ")
                .replace(f"FROM {name})", f"FROM {name}{k})")
                .replace(f"JOIN {name} ", f"JOIN {name}{k} ")
            )
        parts.append(part)
    return f"""{parts[0]}, {parts[1]},
e AS (SELECT 0 AS replica, id, version, dead AS deleted FROM final0 WHERE live OR dead UNION ALL SELECT 1, id, version, dead FROM final1 WHERE live OR dead),
best AS (SELECT id, version, deleted FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, deleted DESC) = 1)"""


def oracle_sql(replica_diff: str) -> dict[str, str]:
    raw = "coalesce(text, '')"
    entries = "SELECT id, version, dead AS deleted FROM final WHERE live OR dead"
    lang = "(SELECT doc_id::VARCHAR AS id, lang FROM documents) g"
    formatted = f"WITH {o.DOCS}, f AS (SELECT id, title, len({o.all_words('body')})::BIGINT AS words, coalesce(lang, 'txt') AS format, size, size * 3 AS created, size + 1 AS updated, false AS file FROM docs JOIN {lang} USING (id))"
    kept = o.TOKENS.replace("FROM line)", "FROM line WHERE id NOT IN (SELECT doc_id::VARCHAR FROM documents WHERE lang = 'de'))")
    trim = o._TRIM
    bulk = f"""WITH {o.TOKENS},
item AS (SELECT item_id AS query_id, {o.words('text')} AS t FROM benchmark),
q AS (SELECT DISTINCT query_id, unnest(t) AS term FROM item),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
hit AS (SELECT query_id, p.id, count(*) AS met, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.len / avgdl))) AS s
  FROM post p JOIN q USING (term) JOIN dfs USING (term) JOIN lens l ON l.id = p.id CROSS JOIN stat GROUP BY query_id, p.id)"""
    bakery = ", ".join(f"({k}, '{t.replace(chr(10), "' || chr(10) || '")}')" for k, t in _BAKERY)
    with_bakery = o.scored("('bread', 1.0), ('butter', 1.0), ('loaf', 0.5)").replace(
        "FROM documents)",
        f"FROM (SELECT doc_id, text FROM documents UNION ALL VALUES {bakery}))",
    )
    best = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) <= 5"
    return {
        "search_synonyms": f"WITH {with_bakery} {o.near("('bread', 0), ('loaf', 0), ('butter', 1)")} {o.ranked("list_has_any(matched, ['bread', 'loaf']) AND list_contains(matched, 'butter')", True)}",
        "extract_docx": f"""WITH {o.DOCS} SELECT id || '.docx' AS path, CASE WHEN title <> '' OR body <> '' THEN title END AS title, CASE WHEN title <> '' OR body <> '' THEN body END AS body, CASE WHEN title = '' AND body = '' THEN 'the file is empty' END AS error FROM docs""",
        "bulk_all_words": f"{bulk} SELECT query_id, id, round(s, 6) AS score FROM hit WHERE met = (SELECT count(*) FROM q WHERE q.query_id = hit.query_id) {best}",
        "bulk_phrases": f"""{bulk}, seen AS (SELECT DISTINCT query_id, a.id FROM item JOIN tok a ON a.term = t[1] JOIN tok b ON b.id = a.id AND b.pos = a.pos + 1 AND b.term = t[2] JOIN tok c ON c.id = a.id AND c.pos = a.pos + 2 AND c.term = t[3])
SELECT query_id, id, round(s, 6) AS score FROM hit JOIN seen USING (query_id, id) {best}""",
        "store_results": f"""WITH RECURSIVE {_results_sql()}
SELECT seq AS n, id, op, CASE op
  WHEN 'add' THEN CASE WHEN act IS NULL THEN 'skipped' ELSE 'indexed' END
  WHEN 'put' THEN CASE WHEN act IS NULL THEN 'ignored' WHEN was THEN 'updated' ELSE 'created' END
  WHEN 'delete' THEN CASE WHEN act IS NULL OR NOT was THEN 'not_found' ELSE 'deleted' END
  ELSE CASE WHEN act IS NULL THEN 'ignored' ELSE 'applied' END END AS result FROM fold WHERE k > 0""",
        "store_reopened": f"WITH RECURSIVE {_results_sql()} {entries}",
        "store_unversioned": f"WITH RECURSIVE {_results_sql(True)} {entries}",
        "store_point_get": f"WITH {o.DOCS} SELECT id, title, body, 'txt' AS format, size FROM docs WHERE id = '17'",
        "store_downloads": f"WITH {o.DOCS} SELECT id, id || '.txt' AS name, md5(CASE WHEN lang = 'en' THEN t ELSE title || chr(10) || chr(10) || body || chr(10) END) AS content_md5 FROM docs JOIN (SELECT doc_id::VARCHAR AS id, lang, {raw} AS t FROM documents) USING (id)",
        "sync_apply": f"WITH RECURSIVE {_replicas_sql()} SELECT id, version, deleted FROM best",
        "holds": f"WITH RECURSIVE {o.OPS} SELECT id, (live OR dead) AND version >= 300 AS live_300, (live OR dead) AND (version > 300 OR version = 300 AND dead) AS deleted_300 FROM final",
        "replica_diff_placed": f"SELECT * FROM ({replica_diff}) WHERE id::BIGINT % 3 = 1",
        "put_metadata": f"""WITH {o.DOCS}, old AS (SELECT id, title, body, size, lang, ends_with(id, '3') AS file FROM docs JOIN {lang} USING (id)),
new AS (SELECT id, title, left(body, 30) AS body, size, lang, file, true AS had FROM old WHERE lang = 'en' UNION ALL SELECT 'new-' || id, title, left(body, 30), 0, NULL, false, false FROM old WHERE lang = 'en')
SELECT id, coalesce(lang, 'txt') AS format, CASE WHEN file THEN size ELSE octet_length(encode(title)) + 1 + octet_length(encode(body)) END::BIGINT AS size,
  CASE WHEN had THEN 5 ELSE {NOW} END::BIGINT AS created, CASE WHEN had THEN {NOW} ELSE 0 END::BIGINT AS updated, file, CASE WHEN had THEN 'updated' ELSE 'created' END AS result FROM new""",
        "index_insert": "SELECT doc_id::VARCHAR AS id, seq::INTEGER AS seq, seq = 0 AND lang IS DISTINCT FROM 'en' AS indexed FROM documents CROSS JOIN (SELECT unnest([0, 1]) AS seq)",
        "index_delete": f"WITH {kept} SELECT word, df FROM vocab",
        "index_update": f"WITH {o.DOCS}, a AS (SELECT id, {o.words('title')} AS tw, CASE WHEN lang = 'en' THEN [] ELSE {o.words('body')} END AS bw FROM docs JOIN {lang} USING (id)) SELECT id, (2 * len(tw) + len(bw))::BIGINT AS len FROM a",
        "index_inventory": f"WITH {o.TOKENS} SELECT d.shard, docs, coalesce(terms, 0) AS terms FROM (SELECT id::BIGINT % 4 AS shard, count(DISTINCT id) AS docs FROM a GROUP BY 1) d LEFT JOIN (SELECT id::BIGINT % 4 AS shard, count(DISTINCT term) AS terms FROM post GROUP BY 1) t USING (shard)",
        "index_contains": "SELECT doc_id::VARCHAR AS id, true AS known FROM documents UNION ALL SELECT doc_id::VARCHAR || 'x', false FROM documents",
        "list_docs_format": f"{formatted} SELECT * FROM f WHERE format = 'en' ORDER BY created DESC, id DESC LIMIT 41",
        "list_docs_page": f"{formatted}, p AS (SELECT id, size, row_number() OVER (ORDER BY size, id) AS k, count(*) OVER () AS total FROM f WHERE format = 'en') SELECT total, least(total, 25) AS rows, CASE WHEN total > 25 THEN lpad(size::VARCHAR, 20, '0') || chr(31) || id END AS next FROM p WHERE k = least(25, total)",
        "ingest_json": f"""WITH {o.DOCS} SELECT id, title, body, CASE WHEN lang = 'en' THEN 'txt' ELSE coalesce(lang, 'txt') END AS format,
  CASE WHEN lang = 'en' OR size = 0 THEN octet_length(encode(title)) + 1 + octet_length(encode(body)) ELSE size END::BIGINT AS size, CASE WHEN lang = 'fr' THEN 12 ELSE {NOW} END::BIGINT AS created, 0::BIGINT AS updated, false AS file FROM docs JOIN {lang} USING (id)""",
        "upload": f"WITH r AS (SELECT doc_id::VARCHAR AS id, lang, {trim.format(raw)} AS t FROM documents) SELECT 'a\\b/' || id || CASE WHEN lang = 'fr' THEN '.xyz' ELSE '.TXT' END AS path, CASE WHEN lang = 'fr' OR t = '' THEN 'error' WHEN lang = 'en' THEN 'exists' ELSE 'indexed' END AS status FROM r",
        "parse_txt": f"WITH r AS (SELECT doc_id::VARCHAR AS id, {raw} AS t FROM documents) SELECT id, {trim.format('split_part(t, chr(10), 1)')} AS title, CASE WHEN contains(t, chr(10)) THEN {trim.format('substr(t, instr(t, chr(10)) + 1)')} ELSE '' END AS body, 'txt' AS format, octet_length(encode(t))::BIGINT AS size FROM r",
        "extract_outcomes": f"""WITH r AS (SELECT doc_id::VARCHAR AS id, lang, {trim.format(raw)} AS t FROM documents), e AS (SELECT id, lang, CASE WHEN lang = 'fr' THEN 'file name has no stem or extension: ' || id WHEN lang = 'de' THEN 'the text is not UTF-8' WHEN t = '' THEN 'the file is empty' END AS error FROM r)
SELECT CASE WHEN lang = 'fr' THEN id ELSE id || '.txt' END AS path, CASE WHEN error IS NULL THEN id END AS id, error FROM e""",
        "bm25_helper": f"WITH {o.scored("('anon', 1.0), ('ention', 1.0)")} SELECT id, round(s, 6) AS score FROM base",
        "search_response": f"WITH {o.scored("('ble', 1.0), ('onan', 1.0)")}, b AS (SELECT *, count(*) OVER () AS total FROM base WHERE len(matched) = 2) SELECT id, round(s, 6) AS score, total FROM b ORDER BY s DESC, id LIMIT 7",
        "search_phrase_found": f"WITH {o.scored("('eriner', 1.0), ('thanea', 1.0)")} {o.ranked(o.phrase(['eriner', 'thanea']), limit=30)}",
        "search_phrases_found": f"WITH {o.scored("('attion', 1.0), ('thanedble', 1.0), ('anea', 1.0), ('eriner', 1.0)")} {o.ranked(o.phrase(['thanedble', 'anea', 'eriner']) + ' AND ' + o.phrase(['attion', 'thanedble']), limit=30)}",
    }
