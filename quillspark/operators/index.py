"""The positional inverted index as DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.analysis import stem_all, words
from quillspark.sources import files

#: Positions between a title's end and the body's beginning.
FIELD_GAP = 100


@dataclass
class Index:
    """docs; postings (term, id, positions, title_tf, tf, len); lengths (id, len); vocabulary (word, df); terms (term, df).

    ``n`` and ``total_len`` are the corpus statistics that ranking needs; queries look document
    frequencies and fuzzy variants up in ``terms`` and never scan the postings for them.
    """

    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame
    words: DataFrame
    n: int
    total_len: int
    stemmed: bool = True
    terms: DataFrame | None = None
    kept: tuple[DataFrame, ...] = ()

    def __post_init__(self) -> None:
        if self.terms is None:
            self.terms = frequencies(self.postings)

    def __len__(self) -> int:
        return self.n

    def contains(self, ids: DataFrame) -> DataFrame:
        """(id, known) for each row of ``ids``."""
        have = self.docs.select(F.col("id").alias("_have")).distinct()
        return ids.select("id").join(have, F.col("id") == F.col("_have"), "left").select("id", F.col("_have").isNotNull().alias("known"))

    @property
    def avgdl(self) -> float:
        return self.total_len / self.n if self.n else 0.0

    def save(self, path: str, partitions: int = 64) -> None:
        """Writes a new version of the index and then names it the current one, so that a failed save leaves the old one.

        Postings and terms go sorted by term, words by word and documents by id, so that lookups and
        prefixes skip row groups.
        """
        spark = self.docs.sparkSession
        version = f"{path}/version-{uuid.uuid4().hex[:12]}"
        small = max(1, partitions // 8)
        by = lambda df, n, *c: df.repartitionByRange(n, c[0]).sortWithinPartitions(*c)
        by(self.docs, partitions, "id").write.parquet(f"{version}/docs")
        by(self.postings, partitions, "term", "id").write.parquet(f"{version}/postings")
        self.lengths.write.parquet(f"{version}/lengths")
        by(self.words, small, "word").write.parquet(f"{version}/words")
        by(self.terms, small, "term").write.parquet(f"{version}/terms")
        files.publish(spark, path, version.rpartition("/")[2])

    @staticmethod
    def load(spark: SparkSession, path: str, stemmed: bool = True) -> Index:
        version = f"{path}/{files.current(spark, path)}"
        docs, postings, lengths, vocabulary, terms = (spark.read.parquet(f"{version}/{x}") for x in ("docs", "postings", "lengths", "words", "terms"))
        n, total = statistics(lengths).first()[:2]
        return Index(docs, postings, lengths, vocabulary, n, total, stemmed, terms)


def analyzed(docs: DataFrame, stemmed: bool = True) -> DataFrame:
    """(id, title_words, body_words, title_terms, body_terms), a single pass over the texts."""
    a = docs.select("id", words(F.col("title")).alias("title_words"), words(F.col("body")).alias("body_words"))
    return a.select("*", *((stem_all(F.col(f"{f}_words")) if stemmed else F.col(f"{f}_words")).alias(f"{f}_terms") for f in ("title", "body")))


def lengths(a: DataFrame) -> DataFrame:
    """A title counts twice."""
    return a.select("id", (2 * F.size("title_terms") + F.size("body_terms")).cast("long").alias("len"))


#: Tokens of documents that a task codes and sorts at once, unless a single document has more.
TOKENS = 250_000
POSTING = "term string, id string, positions array<int>, title_tf long, tf long, len long"


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut between documents, so that what a task holds does not depend on the batch's size."""
    total = np.cumsum(sum(np.diff(batch.column(k).offsets.to_numpy()).astype(np.int64) for k in (1, 2)))
    start = 0
    while start < batch.num_rows:
        before = int(total[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + TOKENS, "right")))
        yield batch.slice(start, end - start)
        start = end


def _posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of whole documents: tokens are coded, sorted by document, term and position, and cut into groups."""
    for batch in (piece for whole in batches for piece in _pieces(whole)):
        sizes = [np.diff(batch.column(k).offsets.to_numpy()) for k in (1, 2)]
        n = batch.num_rows
        coded = pa.concat_arrays([batch.column(k).flatten() for k in (1, 2)]).dictionary_encode()
        if not len(coded):
            continue
        doc = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
        at = np.concatenate([np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s) for s in sizes])
        title = np.arange(doc.size) < sizes[0].sum()
        at = np.where(title, at, at + sizes[0][doc] + FIELD_GAP)
        order = np.lexsort((at, coded.indices.to_numpy(), doc))
        doc, code, at, title = doc[order], coded.indices.to_numpy()[order], at[order], title[order]
        start = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])))
        tf = np.diff(np.append(start, doc.size))
        in_title = np.add.reduceat(title.astype(np.int64), start)
        length = 2 * sizes[0] + sizes[1]
        columns = [
            coded.dictionary.take(pa.array(code[start])),
            batch.column(0).take(pa.array(doc[start])),
            pa.ListArray.from_arrays(pa.array(np.append(start, doc.size).astype(np.int32)), pa.array(at.astype(np.int32))),
            pa.array(in_title),
            pa.array(tf + in_title),
            pa.array(length[doc[start]].astype(np.int64)),
        ]
        out = pa.RecordBatch.from_arrays(columns, names=["term", "id", "positions", "title_tf", "tf", "len"])
        for k in range(0, out.num_rows, 20_000):
            yield out.slice(k, 20_000)


def postings(a: DataFrame) -> DataFrame:
    """One row a term and document. A document's tokens are in one row already, so nothing is shuffled."""
    return a.select("id", "title_terms", "body_terms").mapInArrow(_posting_rows, POSTING)


def frequencies(index_postings: DataFrame) -> DataFrame:
    """(term, df) of every term."""
    return index_postings.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(a: DataFrame) -> DataFrame:
    """Documents of each surface word."""
    return a.select(F.explode(F.array_distinct(F.concat("title_words", "body_words"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def statistics(length_rows: DataFrame) -> DataFrame:
    return length_rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len")).withColumn(
        "avgdl",
        F.when(F.col("n") > 0, F.col("total_len") / F.col("n")).otherwise(0.0),
    )


def build_index(docs: DataFrame, stemmed: bool = True, keep=None) -> Index:
    """Indexes documents with distinct ids (see :func:`insert` for repeated ones).

    ``keep``: a storage level for the analysed texts, which postings, lengths and words all read, and for the
    lengths. Without stems the terms are the words, which are kept once.
    """
    a, kept = analyzed(docs, stemmed), ()
    if keep is not None:
        words_ = (a if stemmed else a.drop("title_terms", "body_terms")).persist(keep)
        a = words_ if stemmed else words_.withColumns({f"{f}_terms": F.col(f"{f}_words") for f in ("title", "body")})
        kept = (words_, lengths(a).persist(keep))
    rows = kept[1] if kept else lengths(a)
    n, total, _ = statistics(rows).first()
    return Index(docs, postings(a), rows, vocabulary(a), n, total, stemmed, kept=kept)


def insert(live: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Batch rows marked ``indexed``: the first of its id in ``order``, and not live already."""
    from pyspark.sql import Window as W

    first = batch.withColumn("_nth", F.row_number().over(W.partitionBy("id").orderBy(order)))
    known = live.select(F.col("id").alias("_known")).distinct()
    return (
        first.join(known, F.col("id") == F.col("_known"), "left")
        .withColumn("indexed", (F.col("_nth") == 1) & F.col("_known").isNull())
        .drop("_nth", "_known")
    )


def delete(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("id"), "id", "left_anti")


def update(docs: DataFrame, new: DataFrame) -> DataFrame:
    return delete(docs, new).unionByName(new)


def inventory(docs: DataFrame, index_postings: DataFrame, shard) -> DataFrame:
    """Documents and distinct terms of each shard; ``shard`` is a column of id."""
    d = docs.groupBy(shard.alias("shard")).agg(F.countDistinct("id").alias("docs"))
    t = index_postings.groupBy(shard.alias("shard")).agg(F.countDistinct("term").alias("terms"))
    return d.join(t, "shard", "left").select("shard", "docs", F.coalesce("terms", F.lit(0)).alias("terms"))
