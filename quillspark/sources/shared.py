"""The folder that driver and executors share, and how much of a table a task takes at once."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, and of a table's files or of shuffled rows for a task, where the session has Spark's
#: defaults of 64, 128 and 64 MB. 64 MB of shuffled pairs (query, document) take 700 MB of a task's memory.
BATCH_BYTES, TASK_BYTES = 4 << 20, 16 << 20
_SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": (64 << 20, BATCH_BYTES),
    "spark.sql.files.maxPartitionBytes": (128 << 20, TASK_BYTES),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": (64 << 20, TASK_BYTES),
}
_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="quillspark-")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode, where all is one machine, an own folder if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(_own_dir())
    return _own_dir()


def _bytes(text: str) -> int | None:
    digits = text.strip().rstrip("bBkKmMgG")
    unit = _UNITS.get(text.strip()[len(digits) :].lower())
    return int(digits) << unit if digits.isdigit() and unit is not None else None


def small_tasks(spark: SparkSession) -> None:
    """Keeps what a task reads and what a worker holds the same on larger tables: they get more tasks. Other settings of the user's stay."""
    for key, (default, ours) in _SETTINGS.items():
        if _bytes(spark.conf.get(key, str(default))) == default:
            spark.conf.set(key, f"{ours}b")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of texts in small tasks, and in one for each core at least: a single small file would be a single task."""
    small_tasks(spark)
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
