"""Connected components of an edge table, by local forests and alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.scratch import Scratch

MAX_ROUNDS = 60
#: Edges that one task turns into stars at a time: 8 MB.
TASK_EDGES = 500_000


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for every node of the edges that isn't the smallest itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    low = np.arange(nodes.size)
    while True:
        lx, ly = low[x], low[y]
        if (lx == ly).all():
            break
        m = np.minimum(lx, ly)
        np.minimum.at(low, lx, m)
        np.minimum.at(low, ly, m)
        while (low[low] != low).any():
            low = low[low]
    own = low != np.arange(nodes.size)
    return nodes[own], nodes[low[own]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of the task's edges; a task that gets more than TASK_EDGES contracts as it reads."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    fresh = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _stars(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        fresh += batch.num_rows
        if fresh > TASK_EDGES:
            held, fresh = [merged()], 0
    if held:
        a, b = merged()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def contract(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """One star a component, as edges (node, smallest node), that connect the same nodes as ``edges`` (a, b).

    Edges are dealt over as many tasks as TASK_EDGES asks for, and each task keeps the stars of its own
    edges, again while that halves them. If one task was enough, that is the result. Else
    each round links every node's larger neighbours, then its smaller ones, to the smallest it knows,
    until only stars are left, in about log(n) rounds. A round is a minimum by node, combined before
    the shuffle, and a join that Spark can split where a node has very many neighbours; edges are
    written between rounds, so nothing but a row count and a checksum comes to the driver.
    """
    e = scratch.save(edges.select("a", "b").where("a != b"), f"{name}-edges")
    count, turn = e.count(), 0
    while True:
        tasks = -(-count // TASK_EDGES) or 1
        e = scratch.save(e.repartition(tasks).mapInArrow(_local, "a long, b long"), f"{name}-local-{turn}")
        scratch.drop(f"{name}-edges" if turn == 0 else f"{name}-local-{turn - 1}")
        if tasks == 1:
            return e
        before, count, turn = count, e.count(), turn + 1
        if 2 * count > before:
            break
    e = scratch.save(e.distinct(), f"{name}-0")
    scratch.drop(f"{name}-local-{turn - 1}")
    before = None
    for k in range(1, MAX_ROUNDS + 1):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # repeats go in the second half's minimum and in the distinct at the end
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        # smaller neighbours and the node itself go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a != b")
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        e = scratch.save(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        state = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    return e


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable."""
    return members(contract(edges, scratch, name))


def members(e: DataFrame) -> DataFrame:
    """(node, component) for every node of the stars that :func:`contract` gives."""
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
