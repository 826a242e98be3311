"""Ranked search: matching, BM25, phrases, proximity and paging as one plan over the postings."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.highlight import snippet_udf
from quillspark.operators.index import Index
from quillspark.operators.suggest import complete, expand
from quillspark.plans.query import VARIANT_WEIGHT, Query, check_window, last_prefix, parse_query, synonyms

K1, B, PROXIMITY = 1.2, 0.75, 1.0
HIT = "id string, title string, score double"
#: Rows (query, term) up to which queries go to all tasks, and the postings need not be dealt and sorted by term.
FEW = 100_000


def idf(n, df) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def term_score(idf_: Column, tf: Column, length: Column, avgdl) -> Column:
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


def bm25(pairs: Column, n, length: Column, avgdl) -> Column:
    """Score of an array of (tf, df), zeros skipped."""
    kept = F.filter(pairs, lambda p: (p["tf"] > 0) & (p["df"] > 0))
    return F.aggregate(
        F.transform(kept, lambda p: term_score(idf(F.lit(n), p["df"]), p["tf"].cast("double"), length, avgdl)),
        F.lit(0.0),
        lambda a, x: a + x,
    )


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def phrase_match(by_term: Column, phrase: list[str]) -> Column:
    """Is there a start from which the phrase's terms stand one after another: each term's positions, moved back by its place, meet."""

    def starts(place: int, term: str) -> Column:
        return F.transform(F.coalesce(by_term[term], F.array().cast("array<int>")), lambda p: p - place)

    return F.size(reduce(F.array_intersect, [starts(*x) for x in enumerate(phrase)])) > 0


def proximity(groups: Column) -> Column:
    """(m - 1) / gap for the m groups with positions, from the smallest window that has one of each.

    The positions of all groups are walked once in order; the last place of each group is kept, and
    where every group has one, the window reaches back to the earliest of them.
    """
    full = F.filter(groups, lambda g: F.size(g) > 0)
    m = F.size(full)
    far = 2_000_000_000
    state = "struct<last:array<int>,best:int>"
    start = F.struct(F.array_repeat(F.lit(-far), m).alias("last"), F.lit(far).alias("best")).cast(state)
    walk = F.sort_array(F.flatten(F.transform(full, lambda g, k: F.transform(g, lambda p: F.struct(p.alias("p"), k.alias("k"))))))

    def to(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda v, k: F.when(k == x["k"], x["p"]).otherwise(v))
        first = F.array_min(last)
        return F.struct(
            last.alias("last"),
            F.when(first > -far, F.least(s["best"], x["p"] - first + 1)).otherwise(s["best"]).alias("best"),
        ).cast(state)

    best = F.aggregate(walk, start, to)["best"]
    return F.when(m < 2, F.lit(0.0)).otherwise(PROXIMITY * (m - 1) / F.greatest(F.lit(1), best + 1 - m).cast("double"))


def frequencies(index: Index, terms: list[str]) -> dict[str, int]:
    """Document frequencies of a query's terms, those of the index alone."""
    return {r["term"]: r["df"] for r in index.terms.where(F.col("term").isin(*terms)).collect()} if terms else {}


def matches(index: Index, query: Query, all_terms: bool = False, near: bool = True, df: dict[str, int] | None = None) -> DataFrame:
    """(id, score) of every document that matches.

    Only the query's terms are read from the postings. Their document frequencies are a few numbers,
    so they come to the driver and the rest is a single aggregation by document.
    """
    weighted = query.weighted
    hit = index.postings.where(F.col("term").isin(*[t for t, _ in weighted])) if weighted else index.postings.where(F.lit(False))
    df = frequencies(index, [t for t, _ in weighted]) if df is None else df
    live = [(k, t, w) for k, (t, w) in enumerate(weighted) if t in df]
    if not live or index.n == 0 or index.avgdl <= 0:
        return index.lengths.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    facts = F.create_map(
        *[x for k, t, w in live for x in (F.lit(t), F.struct(F.lit(k).alias("ord"), F.lit(float(w)).alias("w"), F.lit(df[t]).alias("df")))],
    )
    f = facts[F.col("term")]
    score = f["w"] * term_score(idf(F.lit(index.n), f["df"]), F.col("tf").cast("double"), F.col("len"), F.lit(index.avgdl))
    rows = hit.select("id", "term", "positions", F.struct(f["ord"].alias("ord"), score.alias("s")).alias("part"))
    where = query.phrases or (near and len(query.terms) > 1)
    gathered = [F.sort_array(F.collect_list("part")).alias("parts"), F.collect_set("term").alias("matched")]
    if where:
        gathered.append(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    docs = rows.groupBy("id").agg(*gathered)
    if all_terms:
        for t in query.terms:
            docs = docs.where(F.arrays_overlap("matched", _texts(query.covers(t))))
    for phrase in query.phrases:
        docs = docs.where(phrase_match(F.col("at"), phrase))
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["s"])
    if near and len(query.terms) > 1:
        none = F.array().cast("array<int>")
        groups = F.array(*[F.flatten(F.array(*[F.coalesce(F.col("at")[t], none) for t in query.covers(q)])) for q in query.terms])
        total = total + proximity(groups)
    return docs.select("id", total.alias("score"))


def page(found: DataFrame, offset: int, size: int) -> DataFrame:
    """The best documents, ties by id as bytes."""
    return found.orderBy(F.desc("score"), "id").offset(offset).limit(size)


@dataclass
class Response:
    took_ms: int
    total: int
    offset: int
    size: int
    hits: DataFrame
    terms: list[str]
    failed_shards: tuple[str, ...] = ()


def plan(index: Index, q: str, fuzzy: bool = False, prefix: bool = False, use_synonyms: bool = True) -> Query:
    """The query with its variants."""
    query = parse_query(q, index.stemmed)
    if use_synonyms:
        for t in query.terms:
            query.add_variants(t, synonyms(t))
    if not query.terms:
        return query
    if fuzzy:
        spark: SparkSession = index.postings.sparkSession
        for r in expand(spark.createDataFrame([(t,) for t in query.terms], "term string"), index.terms).collect():
            query.add_variants(r["term"], [r["variant"]])
    if prefix and (last := last_prefix(q, index.stemmed)) and last[1] in query.terms:
        query.add_variants(last[1], complete(index.words, last[0], index.stemmed))
    return query


def search(
    index: Index,
    q: str,
    offset: int = 0,
    size: int | None = None,
    k: int | None = None,
    operator: str = "or",
    fuzzy: bool = False,
    prefix: bool = False,
    use_synonyms: bool = True,
    near: bool = True,
    snippets: bool = True,
) -> Response:
    """Ranked hits (id, title, score, snippet).

    The matches are computed once: their number is observed while the page is taken. The page is at
    most MAX_WINDOW rows, so it comes to the driver and only its documents are read, by their ids.
    """
    began = time.monotonic()
    size = size if size is not None else k if k is not None else 10
    check_window(operator, offset, size)
    query = plan(index, q, fuzzy, prefix, use_synonyms)
    terms = sorted(t for t, _ in query.weighted)
    df = frequencies(index, terms)
    rows, total = [], 0
    if df and index.n and index.avgdl > 0:
        seen = Observation()
        found = matches(index, query, operator == "and", near, df).observe(seen, F.count(F.lit(1)).alias("total"))
        rows = [(r["id"], r["score"]) for r in page(found, offset, max(size, 1)).collect()][:size]
        total = seen.get["total"]
    spark = index.docs.sparkSession
    hits = F.broadcast(spark.createDataFrame(rows, "id string, score double"))
    joined = index.docs.where(F.col("id").isin(*[i for i, _ in rows]) if rows else F.lit(False)).join(hits, "id")
    columns = ["id", "title", "score"]
    if snippets:
        joined = joined.withColumn("snippet", snippet_udf(terms, index.stemmed)(F.col("body")))
        columns.append("snippet")
    return Response(int((time.monotonic() - began) * 1000), total, offset, size, joined.select(columns).orderBy(F.desc("score"), "id"), terms)


def _are_few(rows: DataFrame) -> bool:
    return rows.limit(FEW + 1).count() <= FEW


def bulk_search(index: Index, queries: DataFrame, top: int, all_terms: bool = False) -> DataFrame:
    """(query_id, id, score, place) of the best documents for many queries at once.

    ``queries``: query_id, terms (array), and if wanted variants (array of (term, variant)) and phrases
    (array of arrays of terms, which all must occur). Terms join the postings on the term: up to FEW of
    them are broadcast, and of more Spark can split the frequent ones; document frequencies ride on the
    query side. With ``all_terms`` each
    term or one of its variants must occur. No proximity bonus.
    """
    from pyspark.sql import Window as W

    have = set(queries.columns)
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("asked"))
    q = terms.select("query_id", "asked", F.col("asked").alias("term"), F.lit(1.0).alias("w"))
    if "variants" in have:
        extra = queries.select("query_id", "terms", F.explode("variants").alias("v")).where(
            F.array_contains("terms", F.col("v.term")) & ~F.array_contains("terms", F.col("v.variant"))
        )
        q = q.union(extra.select("query_id", "v.term", "v.variant", F.lit(VARIANT_WEIGHT)).distinct())
    # a variant of two terms counts once in the score and for both in the match
    q = q.groupBy("query_id", "term").agg(F.max("w").alias("w"), F.collect_set("asked").alias("asked"))
    few = F.broadcast if _are_few(q) else lambda rows: rows
    q = few(few(q).join(index.terms, "term"))
    hit = index.postings.select("term", "id", "tf", "len").join(q, "term")
    score = F.col("w") * term_score(idf(F.lit(index.n), F.col("df")), F.col("tf").cast("double"), F.col("len"), F.lit(index.avgdl))
    gathered = [F.sum(score).alias("score")]
    if all_terms:  # only then: sets make an aggregation of objects, which sorts all of a task's hits
        met = F.size(F.array_distinct(F.flatten(F.collect_set("asked")))) if "variants" in have else F.count("*")
        gathered.append(met.alias("met"))
    found = hit.groupBy("query_id", "id").agg(*gathered)
    if all_terms:
        found = found.join(terms.groupBy("query_id").agg(F.count("*").alias("n")), "query_id").where(F.col("met") == F.col("n"))
    if "phrases" in have:
        found = _with_phrases(index, queries, found)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id"))
    return found.select("query_id", "id", "score").withColumn("place", place).where(F.col("place") <= top)


def _with_phrases(index: Index, queries: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``found`` whose document has all of the query's phrases."""
    p = queries.select("query_id", F.posexplode("phrases").alias("phrase", "words")).where(F.size("words") > 0)
    needed = p.groupBy("query_id").agg(F.count("*").alias("needed"))
    words = p.select("query_id", "phrase", F.size("words").alias("n"), F.posexplode("words").alias("nth", "term"))
    at = index.postings.select("term", "id", "positions").join(F.broadcast(words) if _are_few(words) else words, "term")
    at = at.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi")
    starts = at.select("query_id", "id", "phrase", "n", "nth", F.explode("positions").alias("pos"))
    whole = starts.groupBy("query_id", "id", "phrase", "n", (F.col("pos") - F.col("nth")).alias("start")).agg(F.count("*").alias("c")).where("c = n")
    met = whole.select("query_id", "id", "phrase").distinct().groupBy("query_id", "id").agg(F.count("*").alias("has"))
    rows = found.join(needed, "query_id", "left").join(met, ["query_id", "id"], "left")
    return rows.where(F.coalesce("needed", F.lit(0)) == F.coalesce("has", F.lit(0)))
