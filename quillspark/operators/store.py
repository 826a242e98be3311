"""Versioned document store: ordered fold of an operation log, replica comparison and placement."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATE = "struct<live:boolean,dead:boolean,version:bigint,payload:string,applied:bigint>"


def stamp(last: int, now_ms: int | None = None) -> int:
    """A version above the last, by the clock where it is ahead."""
    return max(int(time.time() * 1000) if now_ms is None else now_ms, last + 1)


def step(state: Column, op: Column) -> Column:
    """One operation (op, version, payload) on an id's state.

    add: only if not live and newer; put: if newer; delete: if newer, leaving a tombstone; evict: a live
    document not newer than the operation is forgotten.
    """
    live, dead, version = state["live"], state["dead"], state["version"]
    known = live | dead
    newer = ~known | (op["version"] > version)
    kind = op["op"]
    n = state["applied"] + 1

    def to(is_live: bool, is_dead: bool, v: Column, payload: Column) -> Column:
        return F.struct(
            F.lit(is_live).alias("live"),
            F.lit(is_dead).alias("dead"),
            v.alias("version"),
            payload.alias("payload"),
            n.alias("applied"),
        ).cast(STATE)

    none = F.lit(None).cast("string")
    return (
        F.when((kind == "add") & ~live & newer, to(True, False, op["version"], op["payload"]))
        .when((kind == "put") & newer, to(True, False, op["version"], op["payload"]))
        .when((kind == "delete") & newer, to(False, True, op["version"], none))
        .when((kind == "evict") & live & (version <= op["version"]), to(False, False, F.lit(0).cast("long"), none))
        .otherwise(state)
    )


def fold(ops: DataFrame) -> DataFrame:
    """(id, live, dead, version, payload, applied) after the log (seq, id, op, version, payload) in order of seq."""
    start = F.struct(
        F.lit(False).alias("live"),
        F.lit(False).alias("dead"),
        F.lit(0).cast("long").alias("version"),
        F.lit(None).cast("string").alias("payload"),
        F.lit(0).cast("long").alias("applied"),
    ).cast(STATE)
    log = F.sort_array(F.collect_list(F.struct("seq", "op", "version", "payload")))
    return ops.groupBy("id").agg(F.aggregate(log, start, step).alias("s")).select("id", "s.*")


def entries(state: DataFrame) -> DataFrame:
    """(id, version, deleted) of live documents and tombstones."""
    return state.where("live or dead").select("id", "version", F.col("dead").alias("deleted"))


def digest(entry_rows: DataFrame) -> DataFrame:
    """(count, hash): equal for equal entries, whatever their order. The hash sums 60 bits of each entry's md5."""
    text = F.concat_ws("\0", "id", F.col("version").cast("string"), F.col("deleted").cast("string"))
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return entry_rows.agg(F.count("*").alias("count"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("hash"))


def replica_diff(replicas: DataFrame, here: Column | None = None) -> DataFrame:
    """(replica, id, version, deleted, action) that bring each replica to the newest entry; a delete wins a tie.

    ``replicas``: (replica, id, version, deleted). Replicas are the few copies of one shard, a handful of
    names that come to the driver, so ids times replicas is small work. ``here``: a condition on the id,
    entries that are placed elsewhere are left alone. One replica alone has nothing to take over.
    """
    replicas = replicas.where(here) if here is not None else replicas
    best = replicas.groupBy("id").agg(F.max(F.struct("version", "deleted")).alias("best"))
    names = [r["replica"] for r in replicas.select("replica").distinct().collect()]
    wanted = best.select("id", "best", F.explode(F.array(*[F.lit(n) for n in names])).alias("replica"))
    have = replicas.select(F.col("replica").alias("r"), F.col("id").alias("i"), F.struct("version", "deleted").alias("own"))
    j = wanted.join(have, (F.col("replica") == F.col("r")) & (F.col("id") == F.col("i")), "left")
    behind = j.where(F.col("own").isNull() | (F.col("own") < F.col("best")))
    return behind.select(
        "replica",
        "id",
        F.col("best.version").alias("version"),
        F.col("best.deleted").alias("deleted"),
        F.when(F.col("best.deleted"), "delete").otherwise("copy").alias("action"),
    )


def holds(state: DataFrame, version: int, deleted: bool) -> Column:
    """Whether an id's state is at least (version, deleted)."""
    own = F.struct(F.col("version"), F.col("dead").alias("deleted"))
    return (F.col("live") | F.col("dead")) & (own >= F.struct(F.lit(version).alias("version"), F.lit(deleted).alias("deleted")))


def jump_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Jump consistent hash of uint64 keys."""
    key, b, j = keys.copy(), np.full(keys.size, -1, np.int64), np.zeros(keys.size, np.int64)
    live = j < buckets
    while live.any():
        b[live] = j[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        j[live] = ((b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = j < buckets
    return b


def shard_for(buckets: int):
    """Column function: the shard of an id."""

    def run(ids: pd.Series) -> pd.Series:
        import xxhash

        return pd.Series(jump_hash(np.array([xxhash.xxh3_64_intdigest(i.encode()) for i in ids], dtype=np.uint64), buckets).astype(np.int32))

    return F.pandas_udf(run, "int")


def misplaced(placed: DataFrame, buckets: int, drain: tuple[int, ...] = ()) -> DataFrame:
    """(id, source, target) of documents (id, shard) that belong elsewhere; a drained shard keeps none."""
    out = placed.select("id", F.col("shard").alias("source"), shard_for(buckets)(F.col("id")).alias("target"))
    return out.where((F.col("source") != F.col("target")) | F.col("source").isin(*drain)) if drain else out.where("source != target")


def placed_here(buckets: int, shard: int) -> Column:
    """Whether an id belongs to the shard."""
    return shard_for(buckets)(F.col("id")) == shard


def rebalance_plan(moves: DataFrame, batch: int = 200) -> DataFrame:
    """(source, target, batch, ids): moves in batches."""
    nth = F.row_number().over(W.partitionBy("source", "target").orderBy("id")) - 1
    return moves.withColumn("batch", F.floor(nth / batch)).groupBy("source", "target", "batch").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def put_metadata(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Rows as a replace stores them: created, format and file of the old document stay, size is counted again unless it has a file."""
    o = old.select(
        F.col("id").alias("o_id"),
        F.col("created").alias("o_created"),
        F.col("format").alias("o_format"),
        F.col("file").alias("o_file"),
        F.col("size").alias("o_size"),
    )
    j = new.select("id", "title", "body").join(o, F.col("id") == F.col("o_id"), "left")
    had = F.col("o_id").isNotNull()
    size = (F.octet_length("title") + 1 + F.octet_length("body")).cast("long")
    return j.select(
        "id",
        "title",
        "body",
        F.coalesce("o_format", F.lit("txt")).alias("format"),
        F.when(F.coalesce("o_file", F.lit(False)), F.col("o_size")).otherwise(size).alias("size"),
        F.when(had, F.col("o_created")).otherwise(F.lit(now)).cast("long").alias("created"),
        F.when(had, F.lit(now)).otherwise(F.lit(0)).cast("long").alias("updated"),
        F.coalesce("o_file", F.lit(False)).alias("file"),
        F.when(had, "updated").otherwise("created").alias("result"),
    )
