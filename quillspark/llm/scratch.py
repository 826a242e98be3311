"""Shared scratch tables and bounded bitmap filters used by the operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.textarrays import tidy


#: Bytes of an Arrow batch between Spark and a Python worker, where the session has Spark's default of 64 MB.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keeps batches small enough for several workers with long texts to share an executor; another setting of the user's stays."""
    if spark.conf.get(_BATCH, "64MB") in ("67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="quillspark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode an own one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(_own_dir())
    return _own_dir()


class Scratch:
    """Written tables of one operator run, which cut lineage and survive lost executors.

    The tables live below :func:`shared_dir`; ``drop`` frees one as soon as nothing reads it, and
    :func:`clear_since` all that a step has left once its result is written elsewhere.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        """A new folder, or ``root``, one that is there already."""
        small_batches(spark)
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if not root:
            Scratch.made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _at(self, path: str):
        """The Hadoop path and its file system."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        for name in names:
            p, files = self._at(self.path(name))
            files.delete(p, True)

    def move(self, name: str, to: str) -> None:
        """Renames a file within the folder."""
        p, files = self._at(self.path(name))
        q, _ = self._at(self.path(to))
        files.mkdirs(q.getParent())
        if not files.rename(p, q):
            raise OSError(f"{name} can't be renamed to {to}")

    def clear(self) -> None:
        """Frees the whole folder; nothing that was read from it may be used after that."""
        p, files = self._at(self.root)
        files.delete(p, True)

    def names(self, name: str) -> list[str]:
        """What stands below a name, sorted; nothing if there is no such folder."""
        p, files = self._at(self.path(name))
        return sorted(x.getPath().getName() for x in files.listStatus(p)) if files.exists(p) else []

    def size(self, name: str) -> int:
        """Bytes below a name."""
        p, files = self._at(self.path(name))
        return files.getContentSummary(p).getLength()


def clear_since(count: int) -> None:
    """Frees the folders made after the first ``count``."""
    while len(Scratch.made) > count:
        Scratch.made.pop().clear()


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name with as many underscores ahead as keep it apart from ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: log2 of the bits of a filter, at least and at most (32 MB), and bits for each key.
FILTER_BITS, KEY_BITS = (16, 28), 16
#: Blocks in which a filter comes to the driver (32 kB each at most); a power of two.
FILTER_BLOCKS = 1 << 10


def filter_bits(count: int) -> int:
    """log2 of the bits of a filter for so many keys."""
    return min(max(int(count * KEY_BITS).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])


def bitmap(df: DataFrame, key: Column, log2_bits: int) -> np.ndarray:
    """Bit set over the low ``log2_bits`` bits of ``key`` (a well-mixed long), as uint64 words.

    Its size is fixed by ``log2_bits`` whatever the input, so it may be broadcast. Tasks set the bits, and
    the driver gets them packed, in blocks, so it holds about twice that size. A test against it has false
    positives, never false negatives: use it only to skip work that an exact step follows.
    """
    pos = key.bitwiseAND(F.lit((1 << log2_bits) - 1))
    size = (1 << (log2_bits - 6)) // FILTER_BLOCKS

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size * FILTER_BLOCKS, dtype=np.uint64)  # pages of other tasks' blocks are never touched
        mine = np.zeros(FILTER_BLOCKS, dtype=bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.unique(batch.column(1).to_numpy())
            w = at >> 6
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            words[w[first]] |= np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
            mine[w[first] // size] = True
        for k in np.flatnonzero(mine).tolist():
            columns = [pa.array([k], pa.int32()), pa.array([words[k * size : (k + 1) * size].astype("<u8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "words"])

    dealt = df.select(F.shiftright(pos, log2_bits - FILTER_BLOCKS.bit_length() + 1).cast("int").alias("block"), pos.alias("at")).repartition(F.col("block"))
    out = np.zeros(size * FILTER_BLOCKS, dtype=np.uint64)
    for batch in dealt.mapInArrow(pack, "block int, words binary").toArrow().to_batches():
        for k, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out[k * size : (k + 1) * size] = np.frombuffer(words.as_buffer(), "<u8")
    return out


def bit_test(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each uint64 key is in the :func:`bitmap`."""
    k = keys & np.uint64(words.size * 64 - 1)
    return (words[k >> np.uint64(6)] >> (k & np.uint64(63))) & np.uint64(1) != 0


def without(docs: DataFrame, gone: DataFrame, doc_id: str) -> DataFrame:
    """The rows of ``docs`` but those whose id is in ``gone``, a written table of one column of distinct longs.

    Only rows that a :func:`bitmap` of ``gone`` hits are shuffled with their texts, for the exact join; the
    others can't be in it and stay where they are.
    """
    name, block, words = unused(docs.columns, "gone", "block", "words")
    gone = gone.toDF(name)
    bits = filter_bits(gone.count())
    rows = bitmap(gone, F.xxhash64(name), bits).view(np.int64)
    size = rows.size // FILTER_BLOCKS
    ends = pa.array(np.arange(FILTER_BLOCKS + 1, dtype=np.int32) * size)
    columns = [pa.array(np.arange(FILTER_BLOCKS)), pa.ListArray.from_arrays(ends, pa.array(rows))]
    blocks = F.broadcast(docs.sparkSession.createDataFrame(pa.table(columns, names=[block, words])))
    own = F.col(doc_id).cast("long")
    pos = F.xxhash64(own).bitwiseAND(F.lit((1 << bits) - 1))
    at = F.shiftright(pos, 6)
    word = F.get(F.col(words), at.bitwiseAND(F.lit(size - 1)).cast("int"))
    bit = F.call_function("shiftright", word, pos.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    # by an outer join, of which no row may lack its word: Spark would move the exact join ahead of an inner one
    tested = docs.join(blocks, F.shiftright(at, size.bit_length() - 1) == F.col(block), "left")
    hit = word.isNull() | (bit == 1)
    clear, near = (tested.where(x).select(*[F.col(f"`{c}`") for c in docs.columns]) for x in (~hit, hit))
    return clear.union(near.join(gone, own == F.col(name), "left_anti"))
