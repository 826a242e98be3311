"""Quality score by nearest-neighbour voting in a latent-semantic space.

Documents are counted by words, hashed to a fixed number of terms, and by character-shape trigrams
(letter case, digits, blanks, line breaks, each ASCII punctuation mark). Both are weighted by inverse
document frequency over all documents and projected on the leading singular vectors of a bounded sample
of labelled documents. Each document is compared by exact cosine, in blocks, with every labelled vector;
its neighbours vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.textarrays import chunks, span_hashes, tidy, words

#: Trigrams and words that are told apart.
SHAPES, TERMS = 2048, 2048
DIM = SHAPES + TERMS
#: Labelled rows that are fitted at most, the first by a hash of doc_id: 6000 x 4096 counts, 96 MB.
SAMPLE = 6000
COMPONENTS = 48
NEIGHBOURS = 25

_CLASS = np.full(256, 6, dtype=np.uint32)  # beyond ASCII
_CLASS[:32], _CLASS[10], _CLASS[32] = 1, 2, 3
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 4, 5, 0
for _k, _c in enumerate([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)]):
    _CLASS[_c] = 7 + _k


def term_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of DIM hashed counts for each document: trigrams (none under three bytes), then words."""
    n = off.size - 1
    out = np.zeros((n, DIM), dtype=np.float32)
    if buf.size >= 3:
        c = _CLASS[buf]
        tri = ((c[:-2] * np.uint32(64) + c[1:-1]) * np.uint32(64) + c[2:]) * np.uint32(2654435761) >> np.uint32(21)
        doc = np.repeat(np.arange(n), np.diff(off))
        inside = doc[:-2] == doc[2:]
        out[:, :SHAPES] = np.bincount(doc[:-2][inside] * SHAPES + tri[inside], minlength=n * SHAPES).reshape(n, SHAPES)
    s, e, first = words(buf, off)
    term = (span_hashes(buf, s, e, lower=True) >> np.uint64(32)).astype(np.int64) % TERMS
    doc = np.repeat(np.arange(n), np.diff(first))
    out[:, SHAPES:] = np.bincount(doc * TERMS + term, minlength=n * TERMS).reshape(n, TERMS)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted counts, trigrams and words each of length one."""
    x = np.sqrt(counts) * idf
    return np.concatenate([_unit(x[:, :SHAPES]), _unit(x[:, SHAPES:])], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each trigram and word occurs, and their number: DIM counts from each task."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, dtype=np.int64), 0
        for batch in batches:
            for a, b, buf, off in chunks(batch.column(0)):
                df += (term_counts(buf, off) > 0).sum(axis=0)
                n += b - a
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(DIM + 1)), "n": pa.array(np.append(df, n))})

    rows = (
        docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
        .mapInArrow(count, "i long, n long")
        .groupBy("i")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    df = np.zeros(DIM + 1, dtype=np.int64)
    for r in rows:
        df[r["i"]] = r["n"]
    return df[:-1], int(df[-1])


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int) -> DataFrame:
    """doc_id, text and label of at most ``limit`` labelled documents, by a hash of doc_id.

    The ids are cut first, so that only their texts are read to the end. Of rows that repeat a doc_id
    the smallest text counts, of its labels the largest; rows without doc_id or label are left out.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
    )


class QualityModel:
    """Broadcast parts: idf, projection and labelled vectors (DIM x COMPONENTS and SAMPLE x COMPONENTS)."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.idf, self.axes, self.vectors, self.labels = idf, axes, vectors, labels
        self.prior = float(labels.mean()) if labels.size else 0.5

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int = SAMPLE) -> QualityModel:
        df, n = document_frequencies(docs)
        idf = np.log1p(n / np.maximum(df, 1)).astype(np.float32)

        @tidy
        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, buf, off in chunks(batch.column(1)):
                    c = term_counts(buf, off).astype("<f4")
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": batch.column(0).slice(a, b - a),
                            "y": batch.column(2).slice(a, b - a),
                            "c": pa.array([pa.compress(r.tobytes(), "lz4", asbytes=True) for r in c], pa.binary()),
                        }
                    )

        sample = sample_rows(docs, labels, label, allowed, limit).select("doc_id", "text", "y")
        got = sample.mapInArrow(counts, "doc_id long, y int, c binary").toArrow().sort_by("doc_id")
        if not len(got):
            return cls(idf, np.zeros((DIM, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
        x = np.empty((len(got), DIM), dtype=np.float32)
        for k, c in enumerate(got.column("c")):
            x[k] = weighted(np.frombuffer(pa.decompress(c.as_py(), 4 * DIM, "lz4", asbytes=True), "<f4")[None], idf)
        q = np.random.default_rng(7).standard_normal((DIM, COMPONENTS + 16)).astype(np.float32)
        for _ in range(5):  # randomized subspace iteration
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        axes = (q @ vt.T)[:, :COMPONENTS].astype(np.float32)
        return cls(idf, axes, _unit(x @ axes).astype(np.float32), got.column("y").to_numpy().astype(np.float32))

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by cosine; without any likeness the sample's mean."""
        k = min(neighbours, self.labels.size)
        if not k:
            return np.full(counts.shape[0], self.prior)
        out = np.empty(counts.shape[0])
        for a in range(0, counts.shape[0], 256):
            sims = _unit(weighted(counts[a : a + 256], self.idf) @ self.axes) @ self.vectors.T
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sims, near, axis=1), 0).astype(np.float64) ** 4
            total = w.sum(axis=1)
            vote = (w * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[a : a + 256] = np.where(total > 1e-9, vote, self.prior)
        return np.clip(out, 0.0, 1.0)


def score_quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row, in its own partition.

    Null and empty texts, which are like nothing, get the sample's mean label, as does everything where
    the sample is empty (0.5 then). Of neighbours that tie for the last place any may vote. Rows that
    repeat a doc_id each get a score, a null doc_id too; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in chunks(batch.column(1)):
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column(0).slice(a, b - a), "score": pa.array(shared.value.score(term_counts(buf, off)))}
                )

    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    ).mapInArrow(run, "doc_id long, score double")
