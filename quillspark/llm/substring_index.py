"""Incremental substring deduplication over a log-structured fingerprint index.

The index is a folder of immutable runs: tables of (fingerprint, count) rows, bucketed and sorted by
fingerprint. A new batch of documents becomes a run and is merge-joined with each live run, bucket by
bucket and without a shuffle, to find the fingerprints that history already has. When runs pile up the
two smallest are merged, again bucket by bucket. Fingerprints are the anchor hashes of all windows of 35
words (see :mod:`segments`), so any repeated window shows up as a hit of one of these joins; hits are
then verified, by the words of their windows, before anything is removed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import segments
from quillspark.llm.scratch import Scratch
from quillspark.llm.textarrays import rolling, string_buffers, tidy, words

KIND = segments.Kind("word", 35, 8)
#: Runs that may be live at a time.
MAX_RUNS = 3
BLOCK_BYTES = 4 << 20


class FingerprintIndex:
    """Sorted runs of fingerprints in a scratch folder, with a manifest from which they can be opened again.

    Each change writes a new version of the manifest as its last step, so that what a failed change has
    written is not seen. ``buckets`` is fixed when the index is made; it should grow with the data that
    the index is meant for (the default is the session's number of shuffle partitions).
    """

    def __init__(self, scratch: Scratch, kind: segments.Kind = KIND, buckets: int | None = None):
        self.scratch, self.kind, self.spark = scratch, kind, scratch.spark
        versions = scratch.names("manifest")
        if versions:
            row = self.spark.read.text(scratch.path(f"manifest/{versions[-1]}")).first()
            state = json.loads(row[0])
        else:
            state = {"buckets": buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions")), "next": 0, "runs": [], "matches": []}
        self.buckets, self._n = state["buckets"], state["next"]
        self.runs: list[tuple[str, DataFrame]] = [(name, self._open(name)) for name in state["runs"]]
        self.matches: list[str] = state["matches"]

    def _publish(self) -> None:
        state = {"buckets": self.buckets, "next": self._n, "runs": [name for name, _ in self.runs], "matches": self.matches}
        version = f"{len(self.scratch.names('manifest')):08d}"
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(self.scratch.path(f"manifest/{version}"))

    def _name(self, kind: str) -> str:
        self._n += 1
        return f"{kind}-{self._n:06d}-{uuid.uuid4().hex[:8]}"

    def _table(self, name: str) -> str:
        return "fingerprints_" + name.replace("-", "_")

    def _open(self, name: str) -> DataFrame:
        """A run as a bucketed table; one of another session is made known to this one first."""
        table = self._table(name)
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(
                f"CREATE TABLE {table} (fp BIGINT, n BIGINT, m BIGINT) USING parquet "
                f"CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.scratch.path(name)}'"
            )
        return self.spark.table(table)

    def _write(self, rows: DataFrame) -> tuple[str, DataFrame]:
        name = self._name("run")
        rows.write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet").option("path", self.scratch.path(name)).saveAsTable(self._table(name))
        return name, self.spark.table(self._table(name))

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of (rk, text); returns the fingerprints (fp, n, m) that it repeats, in itself or from history."""
        rows = segments.keys(batch, self.kind).groupBy("fp").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        name, run = self._write(rows.repartition(self.buckets, "fp"))
        found = run.where("n > 1")
        for _, old in self.runs:
            found = found.union(self.joined(run, old))
        match = self._name("match")
        found = self.scratch.save(found, match)
        self.matches.append(match)
        self.runs.append((name, run))
        while len(self.runs) > MAX_RUNS:
            self.compact()
        self._publish()
        return found

    @staticmethod
    def joined(run: DataFrame, old: DataFrame) -> DataFrame:
        """The fingerprints of both runs, by a merge join of their buckets."""
        new = run.select("fp", F.col("n").alias("n1"), F.col("m").alias("m1")).hint("merge")
        both = new.join(old.select("fp", F.col("n").alias("n2"), F.col("m").alias("m2")), "fp")
        return both.select("fp", (F.col("n1") + F.col("n2")).alias("n"), (F.col("m1") + F.col("m2")).alias("m"))

    def compact(self) -> None:
        """Merges the two smallest runs, bucket by bucket, and drops them."""
        if len(self.runs) < 2:
            return
        size = {name: self.scratch.size(name) for name, _ in self.runs}
        small = sorted(self.runs, key=lambda r: size[r[0]])[:2]
        a, b = (r.select("fp", F.col("n").alias(f"n{k}"), F.col("m").alias(f"m{k}")) for k, (_, r) in enumerate(small))
        both = a.hint("merge").join(b, "fp", "full")
        total = lambda c: (F.coalesce(f"{c}0", F.lit(0)) + F.coalesce(f"{c}1", F.lit(0))).cast("long").alias(c)
        merged = self._write(both.select("fp", total("n"), total("m")))
        gone = {name for name, _ in small}
        self.runs = [r for r in self.runs if r[0] not in gone] + [merged]
        for name in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
            self.scratch.drop(name)

    def repeated(self) -> DataFrame:
        """(fp, n, m) of the fingerprints that occur twice in all that was added: the hits of all batches."""
        hits = self.spark.createDataFrame([], "fp long, n long, m long")
        for name in self.matches:
            hits = hits.union(self.spark.read.schema("fp long, n long, m long").parquet(self.scratch.path(name)))
        return hits.groupBy("fp").agg(F.max("n").alias("n"), F.max("m").alias("m"))

    def close(self) -> None:
        """Forgets the session's tables; the folder stays and can be opened again."""
        for name, _ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")


def _judge(key: np.ndarray, n: np.ndarray, payload: list[bytes], length: int) -> np.ndarray:
    """Which windows of these contents occur twice, by their hashes and then by their words."""
    size = np.array([len(p) for p in payload], dtype=np.int64)
    off = np.append(0, np.cumsum(size + 1))
    buf = np.frombuffer(b" ".join(payload) + b" ", np.uint8)
    items = segments.Kind("word", length, 1).items(buf, off)
    at = segments._spread(items.first[:-1], n)
    h = rolling(items.hashes, length)[at]
    begin, end = items.begin[at], items.end[at + length - 1]
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order][1:] != h[order][:-1])
    group = np.empty(h.size, dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    head = order[new][group]
    # windows in a row that stand equally far from their first occurrences are compared as one stretch
    far = begin[head] - begin
    odd = (end - begin) != (end[head] - begin[head])
    row = np.repeat(np.arange(n.size), n)
    start = np.flatnonzero(np.append(True, (far[1:] != far[:-1]) | (row[1:] != row[:-1]) | odd[1:] | odd[:-1]))
    last = np.append(start[1:], h.size) - 1
    bad = segments._unequal(items.data, begin[start], begin[start] + far[start], np.where(odd[start], 0, end[last] - begin[start]))
    odd |= np.repeat(bad, last - start + 1)
    flags = np.bincount(group)[group] > 1
    for g in np.unique(group[odd]):  # a hash has met several windows: tell them apart by their words
        own = np.flatnonzero(group == g)
        text = [items.data[begin[w] : end[w]].tobytes() for w in own]
        flags[own] = [text.count(t) > 1 for t in text]
    return flags


def dedup(docs: DataFrame, scratch: Scratch, batches: int = 4, kind: segments.Kind = KIND, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) after removing every word of a repeated window.

    Documents enter the index in ``batches`` by a hash of their id; together the batches are all rows,
    and what the merge joins of the batches hit is what is compared.
    Null and empty texts have no words; a text of fewer words than a window is never removed from
    except as part of none; rows with one doc_id are documents of their own, as are null ids; equal
    rows repeat each other. An empty table gives no row; other columns are not read.
    """
    rows = segments.keyed(docs, doc_id, text)
    index = FingerprintIndex(scratch, kind)
    for k in range(batches):
        index.add(rows.where(F.pmod(F.col("rk"), F.lit(batches)) == k))
    hits = scratch.save(index.repeated(), "hits")
    index.close()
    spans = segments.repeated(rows, kind, hits, BLOCK_BYTES, lambda key, n, payload: _judge(key, n, payload, kind.length), scratch)

    @tidy
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts, found = batch.column(1), batch.column(2)
            total, gone, sha, kept = [], [], [], []
            data, off = string_buffers(texts)
            for k in range(batch.num_rows):
                buf = data[off[k] : off[k + 1]]
                s, e, _ = words(buf, np.array([0, buf.size]))
                hit = segments.covered(s.size, found[k].as_py(), kind.length)
                raw = buf.tobytes()
                rest = b" ".join([raw[a:b] for a, b in zip(s[~hit].tolist(), e[~hit].tolist(), strict=True)])
                total.append(s.size)
                gone.append(int(hit.sum()))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    t = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(F.col(doc_id), t).alias("rk"))
    return (
        named.join(spans, "rk", "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    )
