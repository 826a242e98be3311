"""A durable versioned document store in a folder: log segments, snapshots, original files, point reads.

A batch of operations is folded id by id against the current state and leaves one log segment, which holds
what came of every operation and the new state of every id that changed. The current state is the newest
row of each id in the snapshot and the segments behind it. A numbered manifest names both and is written
last, so a batch or a snapshot that fails half-way is never seen, and of two writers at once one is refused.

An id's operations of one batch are walked in order by one task, row by row, with the id's state alone in
memory; what earlier batches did to it is a single row. So a log of any length costs no more than its batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.highlight import with_highlight
from quillspark.operators.store import stamp
from quillspark.sources import files
from quillspark.sources.shared import small_tasks

DOC = "title string, body string, format string, size long, created long, updated long, file boolean"
#: An operation: its place in the batch, what to do, a version (0 or null: the store gives one) and, for add, put and copy, a document.
OPS = f"n long, id string, op string, version long, {DOC}"
#: Of an id: is there a document or a tombstone, its version, when an original file was last removed.
STATE = f"id string, live boolean, dead boolean, version long, cleared long, seq long, {DOC}"
#: What came of an operation, and in the last row of each id that changed its state.
LOG = f"n long, op string, result string, applied boolean, last boolean, {STATE}"
FILES = "id string, seq long, content binary"
#: Rows, and characters of their texts, that a task gives back at once.
OUT_ROWS, OUT_CHARS = 5000, 2 << 20
_DOC = [c.split()[0] for c in DOC.split(", ")]
_STATE = [c.split()[0] for c in STATE.split(", ")]
_LOG = [c.split()[0] for c in LOG.split(", ")]


def _size(title: str, body: str) -> int:
    return len(title.encode()) + 1 + len(body.encode())


class _Walk:
    """One id's state as its operations go by."""

    def __init__(self, key: str):
        self.id, self.live, self.dead, self.version, self.cleared, self.seq = key, False, False, 0, -1, -1
        self.doc: tuple = (None,) * len(_DOC)
        self.changed = False

    def load(self, r) -> None:
        self.live, self.dead, self.version, self.cleared, self.seq = bool(r.live), bool(r.dead), int(r.version), int(r.cleared), int(r.seq)
        self.doc = tuple(getattr(r, c) for c in _DOC)

    def _next(self, given, now: int) -> int:
        return int(given) if given and given > 0 else max(now, self.version + 1)

    def _become(self, live: bool, dead: bool, version: int, doc: tuple, seq: int) -> None:
        self.live, self.dead, self.version, self.doc, self.seq, self.changed = live, dead, version, doc, seq, True
        if not live:
            self.cleared = seq

    def step(self, r, seq: int, now: int) -> tuple[str, bool]:
        """Applies an operation: (result word, applied)."""
        none = (None,) * len(_DOC)
        given = None if pd.isna(r.version) else r.version
        known, op = self.live or self.dead, r.op
        if op == "add":
            v = self._next(given, now)
            if self.live or v <= self.version:
                return "skipped", False
            self._become(True, False, v, tuple(getattr(r, c) for c in _DOC), seq)
            return "indexed", True
        if op in ("put", "copy"):
            v = int(given or 0) if op == "copy" else self._next(given, now)  # another store's versions are taken as they are
            if known and v <= self.version:
                return "ignored", False
            existed = self.live
            doc = dict(zip(_DOC, (getattr(r, c) for c in _DOC), strict=True))
            if op == "put":  # created, format and file of the old document stay
                at = int(r.updated) if r.updated and r.updated > 0 else now // 1000
                old = dict(zip(_DOC, self.doc, strict=True)) if existed else {"format": "txt", "created": at, "updated": 0, "file": False, "size": 0}
                size = old["size"] if old["file"] else _size(r.title or "", r.body or "")
                doc = {
                    "title": r.title,
                    "body": r.body,
                    "format": old["format"],
                    "size": size,
                    "created": old["created"],
                    "updated": at if existed else old["updated"],
                    "file": old["file"],
                }
            self._become(True, False, v, tuple(doc[c] for c in _DOC), seq)
            return ("applied" if op == "copy" else "updated" if existed else "created"), True
        if op in ("delete", "remove"):
            if op == "delete" and not given and not self.live:
                return "not_found", False
            v = int(given or 0) if op == "remove" else self._next(given, now)
            if v <= self.version:
                return ("ignored" if op == "remove" else "not_found"), False
            existed = self.live
            self._become(False, True, v, none, seq)
            return ("applied" if op == "remove" else "deleted" if existed else "not_found"), True
        if op == "evict":
            if not self.live or self.version > (given or 0):
                return "ignored", False
            self._become(False, False, 0, none, seq)
            return "applied", True
        raise ValueError(f"unknown operation: {op}")

    def row(self, n: int, op: str, result: str, applied: bool, last: bool) -> tuple:
        return (n, op, result, applied, last, self.id, self.live, self.dead, self.version, self.cleared, self.seq, *self.doc)


def _walked(base: int, now: int):
    """Folds rows sorted by id and place; an id's state, if it has one, is the row at place -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk: _Walk | None = None
        held: tuple | None = None
        out: list[tuple] = []
        chars = 0
        for batch in batches:
            for r in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                if walk is None or walk.id != r.id:
                    if held:
                        out.append(walk.row(*held, walk.changed))
                    walk, held = _Walk(r.id), None
                if r.n < 0:
                    walk.load(r)
                    continue
                if held:
                    out.append(walk.row(*held, False))
                result, applied = walk.step(r, base + int(r.n), now)
                held = (int(r.n), r.op, result, applied)
                chars += len(r.body or "") + len(r.title or "")
                if len(out) > OUT_ROWS or chars > OUT_CHARS:  # texts are far longer than the rest of a row
                    yield pd.DataFrame(out, columns=_LOG)
                    out, chars = [], 0
        if held:
            out.append(walk.row(*held, walk.changed))
        yield pd.DataFrame(out, columns=_LOG)

    return run


class DocumentStore:
    """The store in ``root``; opening a folder again continues where its last manifest stands.

    ``snapshot_every``: operations in the log after which a snapshot is made. ``clock`` gives milliseconds.
    """

    def __init__(self, spark: SparkSession, root: str, snapshot_every: int = 1000, clock=None):
        small_tasks(spark)
        self.spark, self.root, self.snapshot_every, self.clock = spark, root, snapshot_every, clock
        try:
            self.manifest = json.loads(files.current(spark, root))
        except FileNotFoundError:
            self.manifest = {"number": 0, "snapshot": None, "segments": [], "files": [], "operations": 0, "seq": 0, "stamp": 0}

    def _publish(self, **changes) -> None:
        new = self.manifest | changes | {"number": self.manifest["number"] + 1}
        if not files.write_new(self.spark, f"{self.root}/CURRENT/{new['number']:08d}", json.dumps(new)):
            raise RuntimeError("another writer has changed the store; open it again")
        self.manifest = new

    def _read(self, names: list[str], schema: str) -> DataFrame:
        # paths hold their rows for good: a name is never written again
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """The newest row (:data:`STATE`) of every id that has a document or a tombstone."""
        return self._state().where("live or dead")

    def _state(self) -> DataFrame:
        m = self.manifest
        rows = self._read(m["segments"], LOG).where("last").select(_STATE)
        if m["snapshot"]:
            rows = self._read([m["snapshot"]], STATE).unionByName(rows)
        newest = F.max_by(F.struct(*_STATE), F.col("seq")).alias("s")
        return rows.groupBy("id").agg(newest).select("s.*") if m["segments"] else rows

    def documents(self) -> DataFrame:
        """The live documents."""
        return self._state().where("live").select("id", *_DOC)

    def get(self, doc_id: str, hl: str = "") -> DataFrame:
        """One live document, or no row; ``hl``: terms to mark in it."""
        found = self._state_of(F.col("id") == doc_id).where("live").select("id", *_DOC)
        return with_highlight(found, hl) if hl.split() else found

    def _state_of(self, which: Column) -> DataFrame:
        """States of some ids: the condition reaches the scans, ahead of the aggregation."""
        m = self.manifest
        rows = self._read(m["segments"], LOG).where("last").where(which).select(_STATE)
        if m["snapshot"]:
            rows = self._read([m["snapshot"]], STATE).where(which).unionByName(rows)
        return rows.groupBy("id").agg(F.max_by(F.struct(*_STATE), F.col("seq")).alias("s")).select("s.*")

    def apply(self, ops: DataFrame) -> DataFrame:
        """Applies a batch (:data:`OPS`, missing columns are null) in order of ``n`` and returns (n, id, op, result, version).

        Rows without an id are left out. The segment is written before the manifest names it.
        """
        have = set(ops.columns)
        typed = [F.col(f"`{c}`").cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in OPS.split(", "))]
        batch = ops.select(typed).where(F.col("id").isNotNull())
        now = stamp(self.manifest["stamp"], self.clock() if self.clock else None)
        base = self.manifest["seq"] + 1
        touched = self._state().join(batch.select("id").distinct(), "id", "left_semi")
        names = ["n", "op", *_STATE]
        before = touched.select(F.lit(-1).cast("long").alias("n"), F.lit(None).cast("string").alias("op"), *_STATE)
        rows = batch.select(
            "n",
            "op",
            "id",
            F.lit(None).cast("boolean").alias("live"),
            F.lit(None).cast("boolean").alias("dead"),
            "version",
            F.lit(None).cast("long").alias("cleared"),
            F.lit(None).cast("long").alias("seq"),
            *_DOC,
        )
        walked = before.unionByName(rows.select(names)).repartition("id").sortWithinPartitions("id", "n").mapInPandas(_walked(base, now), LOG)
        name = f"log/{uuid.uuid4().hex}"
        walked.write.parquet(f"{self.root}/{name}")
        log = self._read([name], LOG)
        row = log.agg(F.count(F.when(F.col("applied"), 1)).alias("applied"), F.max("n").alias("n"), F.max("version").alias("version")).first()
        if row["applied"]:
            m = self.manifest
            self._publish(
                segments=[*m["segments"], name],
                operations=m["operations"] + row["applied"],
                seq=base + row["n"],
                stamp=max(now, row["version"]),
            )
            if self.manifest["operations"] > self.snapshot_every:
                self.snapshot()
                log = self._read([name], LOG)
        return log.select("n", "id", "op", "result", F.col("version"))

    def _given(self, rows: DataFrame, op: str, version: int) -> DataFrame:
        order = F.row_number().over(W.orderBy("id")) if "n" not in rows.columns else F.col("n")
        return self.apply(
            (
                rows.withColumn("n", order.cast("long"))
                .withColumn("op", F.lit(op))
                .withColumn("version", F.lit(version).cast("long") if version or "version" not in rows.columns else F.col("version"))
            )
        )

    def add(self, docs: DataFrame, version: int = 0) -> tuple[int, int]:
        """Adds documents that are not live: (indexed, skipped). The first row of an id counts, in order of ``n`` if there is one."""
        if "n" not in docs.columns:
            docs = docs.withColumn("n", F.monotonically_increasing_id())
        done = {r["result"]: r["count"] for r in self._given(docs, "add", version).groupBy("result").count().collect()}
        return done.get("indexed", 0), done.get("skipped", 0)

    def put(self, doc: dict, version: int = 0) -> str:
        return self._one({"updated": 0} | doc, "put", version)

    def delete(self, doc_id: str, version: int = 0) -> str:
        return self._one({"id": doc_id}, "delete", version)

    def _one(self, row: dict, op: str, version: int) -> str:
        rows = self.spark.createDataFrame(
            [tuple(row.values())],
            ", ".join(f"{c} {'long' if isinstance(v, int) else 'string'}" for c, v in row.items()),
        )
        return self._given(rows.withColumn("n", F.lit(0)), op, version).first()["result"]

    def evict(self, rows: DataFrame) -> tuple[int, int]:
        """Forgets live documents (id, version) that are not newer: (applied, ignored)."""
        return self._counts(self._given(rows, "evict", 0))

    def sync(self, items: DataFrame) -> tuple[int, int, DataFrame]:
        """Takes over entries (id, version, deleted and a document's columns): (applied, ignored, state of their ids)."""
        op = F.when(F.col("deleted"), "remove").otherwise("copy")
        order = F.row_number().over(W.orderBy("id")) if "n" not in items.columns else F.col("n")
        done = self._counts(self.apply(items.withColumn("n", order).withColumn("op", op)))
        state = self.entries().join(items.select("id").distinct(), "id", "left_semi")
        return *done, state.select("id", "version", (~F.col("live")).alias("deleted"))

    @staticmethod
    def _counts(results: DataFrame) -> tuple[int, int]:
        done = {r["result"]: r["count"] for r in results.groupBy("result").count().collect()}
        return done.get("applied", 0), done.get("ignored", 0)

    # original files

    def put_files(self, rows: DataFrame) -> DataFrame:
        """Stores original files (id, content, version: 0 or the document's) and returns (id, result).

        stored: the document is live; ignored: it has another version; not_found. Of rows that repeat an
        id the one with the greatest content is kept.
        """
        if "version" not in rows.columns:
            rows = rows.withColumn("version", F.lit(0))
        state = self._state().select(F.col("id").alias("_id"), "live", F.col("version").alias("_version"))
        given = F.coalesce("version", F.lit(0))
        result = (
            F.when((given > 0) & (given != F.coalesce("_version", F.lit(0))), "ignored")
            .when(F.coalesce("live", F.lit(False)), "stored")
            .otherwise("not_found")
        )
        judged = rows.where("id is not null").join(state, F.col("id") == F.col("_id"), "left").select("id", "content", result.alias("result"))
        seq = self.manifest["seq"] + 1
        name = f"files/{uuid.uuid4().hex}"
        stored = judged.where("result = 'stored'").groupBy("id").agg(F.max("content").alias("content"))
        stored.select("id", F.lit(seq).cast("long").alias("seq"), "content").write.parquet(f"{self.root}/{name}")
        out = self.spark.createDataFrame(judged.select("id", "result").collect(), "id string, result string")
        self._publish(files=[*self.manifest["files"], name], seq=seq)
        return out

    def stored_files(self) -> DataFrame:
        """(id, content) of the live documents' files: the last stored since the document was last deleted or evicted."""
        last = self._read(self.manifest["files"], FILES).groupBy("id").agg(F.max("seq").alias("seq"))
        live = self._state().where("live").select("id", "cleared")
        kept = last.join(live, "id").where(F.col("seq") > F.col("cleared")).select("id", "seq")
        return self._read(self.manifest["files"], FILES).join(kept, ["id", "seq"])

    def downloads(self) -> DataFrame:
        """(id, name, format, content) of every live document: its file where it has one, else its text."""
        from quillspark.sources.corpus import download_text

        own = self.stored_files().select(F.col("id").alias("_id"), F.col("content").alias("_content"))
        j = self.documents().join(own, F.col("id") == F.col("_id"), "left")
        has = F.col("file") & F.col("_content").isNotNull()
        fmt = F.when(has, F.col("format")).otherwise("txt")
        content = F.when(has, F.col("_content")).otherwise(F.encode(download_text(), "UTF-8"))
        return j.select("id", F.concat("id", F.lit("."), fmt).alias("name"), fmt.alias("format"), content.alias("content"))

    # snapshots

    def snapshot(self) -> str:
        """Writes all states sorted by id and the files still in use, then drops log and files behind them."""
        old = dict(self.manifest)
        name, kept = f"snapshot/{uuid.uuid4().hex}", f"files/{uuid.uuid4().hex}"
        self.entries().repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.root}/{name}")
        if old["files"]:
            self.stored_files().select("id", "seq", "content").write.parquet(f"{self.root}/{kept}")
        self._publish(snapshot=name, segments=[], files=[kept] if old["files"] else [], operations=0)
        for gone in [*old["segments"][:-1], *old["files"], *([old["snapshot"]] if old["snapshot"] else [])]:
            files.remove(self.spark, f"{self.root}/{gone}")  # the last segment stays: its results may still be read
        return "saved"


def load_folder(store: DocumentStore, folder: str) -> tuple[int, int]:
    """Bulk load of a folder of txt files: (indexed, skipped)."""
    from quillspark.sources.corpus import read_txt_folder

    return store.add(read_txt_folder(store.spark, folder))
