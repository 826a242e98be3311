"""Embedding near-duplicates by NN-descent within labels.

A neighbour graph starts from random-projection cells, then each round compares neighbours of
neighbours: pairs that meet at a common neighbour pass a 64-bit sign sketch, and those left get their
exact cosine. Lists hold K neighbours; a list whose K all pass the threshold is saturated and grows.
Lists only steer the descent: every pair found at the threshold or above, in a list or not, is contracted
into the components.
When a round links nothing more, recall is audited by an exact search for a hundredth of the vectors,
and more cells are tried if it is low; if it is still low after the last cells, all pairs of a label are
compared in blocks. Edges at the threshold or above give the components, and
within a component, where saturated lists end up, links are counted exactly in blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.llm.components import _stars, contract, members
from quillspark.llm.scratch import Scratch
from quillspark.llm.textarrays import tidy

K = 10
TREES = 6
#: Vectors that a cell holds on average, and at most before it is dealt into parts.
CELL, CELL_MOST = 384, 1024
#: Differing sketch bits of 64 up to which a pair is compared; at cosine 0.93 eight are expected.
SKETCH_MOST = 22
ROUNDS = 4
SEEDS = 3
BLOCK = 512
#: Vectors on each side of a comparison of all pairs of a label.
EXACT_BLOCK, STRIP = 2048, 128
#: One vector in so many is audited, but this many at least, and more until this many have links.
AUDIT_EVERY, AUDIT, AUDIT_LINKED = 100, 256, 32
#: Audited vectors that are compared in one pass over the table.
AUDIT_PASS = 4096
RECALL = 0.98


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and each row's start, with the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), off


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, without overflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors in double precision from vectors of one length, stored as ``kind``."""
    data, off = _bytes(column)
    return _unit(data[off[0] : off[-1]].view(kind).reshape(len(off) - 1, -1).astype(np.float64))


@functools.cache
def _planes(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def element_kind(vectors: DataFrame, embedding: str) -> str:
    """How components are stored: as floats where the column has those, else as doubles."""
    element = getattr(vectors.select(embedding).schema[0].dataType, "elementType", None)
    return "<f4" if element is not None and element.simpleString() == "float" else "<f8"


def valid_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(id, label, dim, vec as bytes, sketch) of the rows that can link."""
    kind = element_kind(vectors, embedding)
    names = ["id", "label", "dim", "vec", "sketch"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            off = lists.offsets.to_numpy().astype(np.int64)
            size = np.diff(off)
            none = np.asarray(lists.values.is_null()).astype(bool)
            values = lists.values.fill_null(0).to_numpy(zero_copy_only=False)
            lacks = np.concatenate([[0], np.cumsum(none)])
            known = ~np.any([np.asarray(batch.column(k).is_null()) for k in range(3)], axis=0)
            known &= (size > 0) & (lacks[off[1:]] == lacks[off[:-1]])
            for dim in np.unique(size[known]).tolist():
                pick = np.flatnonzero(known & (size == dim))
                x = values[off[pick][:, None] + np.arange(dim)]
                wide = x.astype(np.float64)
                good = np.isfinite(wide).all(axis=1) & (wide != 0).any(axis=1)
                pick, x = pick[good], x[good]
                if pick.size:
                    bits = np.packbits(_unit(wide[good]) @ _planes(dim, 64, 1) > 0, axis=1).view("<i8")[:, 0]
                    rows = pa.array(pick)
                    columns = [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(np.full(pick.size, dim, np.int32)),
                        pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()),
                        pa.array(bits),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    typed = vectors.select(
        F.col(vec_id).cast("long"),
        F.col(label).cast("string"),
        F.col(embedding).cast("array<float>" if kind == "<f4" else "array<double>"),
    )
    return typed.mapInArrow(run, "id long, label string, dim int, vec binary, sketch long")


def _near(table: pa.Table, threshold: float, kind: str) -> pa.Table:
    """The K nearest of each vector among those of its cell, and the cell's links.

    Links are the stars of all pairs at the threshold or above, as rows without a cosine.
    """
    n = table.num_rows
    ids, x = table.column("id").to_numpy(), _matrix(table.column("vec"), kind)
    sketch = table.column("sketch").to_numpy()
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    k = min(K, n - 1)
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k else np.zeros((n, 0), np.int64)
    a, b = _stars(*np.nonzero(np.triu(sim >= threshold, 1)))
    u = np.append(np.repeat(np.arange(n), k), a)
    v = np.append(near.reshape(-1), b)
    return pa.table({"u": ids[u], "su": sketch[u], "v": ids[v], "sv": sketch[v], "sim": pa.array(sim[u, v], mask=np.arange(u.size) >= n * k)})


EDGE = "u long, su long, v long, sv long, sim double"


class NnDescent:
    """The near-duplicate graph of one table of vectors.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without id or
    label, link with nothing; only vectors of one label and length are compared, those of doubles as
    such. Equal vectors are one node that counts as many. Rows that repeat a vec_id count as one vector, the first by content.
    """

    def __init__(
        self,
        vectors: DataFrame,
        scratch: Scratch,
        threshold: float,
        vec_id: str = "vec_id",
        embedding: str = "embedding",
        label: str = "label",
    ):
        self.vectors, self.scratch, self.threshold = vectors, scratch, threshold
        self.columns = (vec_id, embedding, label)
        self.kind = element_kind(vectors, embedding)

    def _cells(self, nodes: DataFrame, seed: int) -> DataFrame:
        kind = self.kind

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, size = batch.column(2).to_numpy(), batch.column(5).to_numpy()
                for d in np.unique(dims):
                    pick = np.flatnonzero(dims == d)
                    part = batch.take(pa.array(pick))
                    x = _matrix(part.column(3), kind)
                    bits = np.maximum(np.ceil(np.log2(np.maximum(size[pick] / CELL, 1))), 0).astype(np.int64)
                    for t in range(TREES):
                        sign = (x @ _planes(int(d), 60, 1000 * seed + 2 + t) > 0).astype(np.int64)
                        code = (sign << np.arange(60)).sum(axis=1) & ((1 << np.minimum(bits, 60)) - 1)
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column(0),
                                part.column(1),
                                part.column(2),
                                pa.array(np.full(pick.size, t, np.int32)),
                                pa.array(code),
                                part.column(3),
                                part.column(4),
                            ],
                            names=["id", "label", "dim", "tree", "cell", "vec", "sketch"],
                        )

        sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("size"))
        cells = (
            nodes.select("id", "label", "dim", "vec", "sketch")
            .join(sizes, ["label", "dim"])
            .select("id", "label", "dim", "vec", "sketch", "size")
        )
        return cells.mapInArrow(run, "id long, label string, dim int, tree int, cell long, vec binary, sketch long")

    def _start(self, nodes: DataFrame, seed: int) -> DataFrame:
        cells = self._cells(nodes, seed)
        own = ["label", "dim", "tree", "cell"]
        parts = cells.groupBy(*own).agg(F.ceil(F.count("*") / CELL_MOST).alias("parts"))
        cells = cells.join(parts, own).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")))
        least, kind = self.threshold, self.kind
        # by the part too: else all of a cell, dealt by the join before, would stay in one task
        return cells.repartition(*own, "part").groupBy(*own, "part").applyInArrow(lambda table: _near(table, least, kind), EDGE)

    def _lists(self, edges: DataFrame, growth: int) -> DataFrame:
        """The best K of each list, or K * growth while they pass the threshold."""
        place = F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "v"))
        both = edges.union(edges.where(F.col("sim") >= self.threshold).select("v", "sv", "u", "su", "sim")).dropDuplicates(["u", "v"])
        return (
            both.withColumn("place", place)
            .where((F.col("place") <= K) | ((F.col("sim") >= self.threshold) & (F.col("place") <= K * growth)))
            .drop("place")
        )

    def _round(self, lists: DataFrame, nodes: DataFrame) -> DataFrame:
        """Exact cosines of the pairs that meet at a neighbour and are not in a list."""
        left = lists.select(F.col("u").alias("m"), F.col("v").alias("a"), F.col("sv").alias("sa"))
        right = lists.select(F.col("u").alias("m"), F.col("v").alias("b"), F.col("sv").alias("sb"))
        close = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= SKETCH_MOST
        sisters = left.join(right, "m").where(F.col("a") < F.col("b")).where(close("sa", "sb")).select("a", "sa", "b", "sb")
        steps = (
            lists.select(F.col("u").alias("a"), F.col("su").alias("sa"), F.col("v").alias("m"))
            .join(right, "m")
            .where("a != b")
            .where(close("sa", "sb"))
        )
        steps = steps.select(
            F.least("a", "b").alias("x"),
            F.when(F.col("a") < F.col("b"), F.col("sa")).otherwise(F.col("sb")).alias("sx"),
            F.greatest("a", "b").alias("y"),
            F.when(F.col("a") < F.col("b"), F.col("sb")).otherwise(F.col("sa")).alias("sy"),
        )
        pairs = (
            sisters.union(steps)
            .distinct()
            .join(lists.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), ["a", "b"], "left_anti")
        )
        va = nodes.select(F.col("id").alias("a"), F.col("vec").alias("xa"))
        vb = nodes.select(F.col("id").alias("b"), F.col("vec").alias("xb"))

        kind = self.kind

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = np.diff(_bytes(batch.column(4))[1])
                for n in np.unique(size):  # a pair is of one length, a batch may not be
                    part = batch if (size == n).all() else batch.filter(pa.array(size == n))
                    sim = (_matrix(part.column(4), kind) * _matrix(part.column(5), kind)).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column(i) for i in range(4)] + [pa.array(sim)], names=["u", "su", "v", "sv", "sim"])

        return pairs.join(va, "a").join(vb, "b").select("a", "sa", "b", "sb", "xa", "xb").mapInArrow(run, EDGE)

    def _links(self, nodes: DataFrame, cc: DataFrame) -> DataFrame:
        """(id, links): exact counts within components, weighted by copies, in blocks of rows."""
        least, kind = self.threshold, self.kind
        member = nodes.join(cc.withColumnRenamed("node", "id"), "id").select("id", "component", "weight", "vec")
        parts = member.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        member = member.join(parts, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
        # a row goes to the pairs of blocks that have its own
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
        rows = member.select("component", "id", "weight", "vec", "own", other).select(
            "component",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            "own",
            "id",
            "weight",
            "vec",
        )

        def run(table: pa.Table) -> pa.Table:
            own, ids, weight = (table.column(c).to_numpy() for c in ("own", "id", "weight"))
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            x = _matrix(table.column("vec"), kind)
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            near = x[a] @ x[b].T >= least
            near &= ids[a][:, None] != ids[b][None, :]
            out, n = [ids[a]], [near @ weight[b]]
            if i != j:
                out.append(ids[b])
                n.append(near.T @ weight[a])
            return pa.table({"id": np.concatenate(out), "links": np.concatenate(n).astype(np.int64)})

        # by the blocks too: else all blocks of a component, dealt by the join before, would stay in one task
        return (
            rows.repartition("component", "i", "j")
            .groupBy("component", "i", "j")
            .applyInArrow(run, "id long, links long")
            .groupBy("id")
            .agg(F.sum("links").alias("links"))
        )

    def _recall(self, nodes: DataFrame, links: DataFrame) -> float:
        """Mean share of an audited node's exact links that ``links`` has, over those that have links.

        Nodes are chosen by a hash of their id, one in AUDIT_EVERY, and four times as many while fewer
        than AUDIT_LINKED of them have links; at the end all nodes are asked.
        """
        n = nodes.count()
        every = max(1, min(AUDIT_EVERY, n // AUDIT))
        while True:
            linked, share = 0, 0.0
            passes = -(-n // every // AUDIT_PASS) or 1
            chosen = F.xxhash64("id", F.lit("audit"))
            audited = nodes.where(F.pmod(chosen, F.lit(every)) == 0).withColumn("pass", F.pmod(F.xxhash64("id", F.lit("pass")), F.lit(passes)))
            for k in range(passes):
                row = (
                    self._audit(nodes, audited.where(F.col("pass") == k))
                    .join(links, "id", "left")
                    .agg(F.count("*").alias("linked"), F.sum(F.least("n", F.coalesce("links", F.lit(0))) / F.col("n")).alias("share"))
                    .first()
                )
                linked, share = linked + row["linked"], share + (row["share"] or 0.0)
            if linked >= AUDIT_LINKED or every == 1:
                return share / linked if linked else 1.0
            every = max(1, every // 4)

    def _audit(self, nodes: DataFrame, queries: DataFrame) -> DataFrame:
        """(id, n): exact links of each query that has any."""
        least, kind = self.threshold, self.kind
        rows = queries.select("id", "label", "dim", "vec").collect()
        shared = nodes.sparkSession.sparkContext.broadcast([(r["id"], r["label"], r["dim"], bytes(r["vec"])) for r in rows])

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {}
            for i, g, d, v in shared.value:
                own.setdefault((g, d), []).append((i, np.frombuffer(v, kind).astype(np.float64)))
            own = {g: (np.array([i for i, _ in mine]), _unit(np.stack([v for _, v in mine]))) for g, mine in own.items()}
            total: dict[int, int] = {}
            for batch in batches:
                ids, weight = batch.column(0).to_numpy(), batch.column(4).to_numpy()
                label, dim = np.array(batch.column(1).to_pylist(), dtype=object), batch.column(2).to_numpy()
                for (g, d), (asked, q) in own.items():
                    pick = np.flatnonzero((label == g) & (dim == d))
                    # a part of the batch at a time: a few MB of cosines
                    for part in np.array_split(pick, -(-pick.size // 256)) if pick.size else ():
                        near = q @ _matrix(batch.column(3).take(pa.array(part)), kind).T >= least
                        near &= asked[:, None] != ids[part][None, :]
                        for i, n in zip(asked, near @ weight[part], strict=True):
                            if n:
                                total[int(i)] = total.get(int(i), 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["id", "n"])

        return nodes.select("id", "label", "dim", "vec", "weight").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))

    def _all_pairs(self, nodes: DataFrame) -> DataFrame:
        """(a, b): stars of all pairs of one label and length at the threshold or above, in blocks."""
        least, kind, key = self.threshold, self.kind, ["label", "dim"]
        parts = nodes.groupBy(*key).agg(F.ceil(F.count("*") / EXACT_BLOCK).alias("parts"))
        rows = nodes.select("id", *key, "vec").join(parts, key).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
        rows = rows.select("id", *key, "vec", "own", other).select(
            *key,
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            "own",
            "id",
            "vec",
        )

        def run(table: pa.Table) -> pa.Table:
            own, ids = table.column("own").to_numpy(), table.column("id").to_numpy()
            x = _matrix(table.column("vec"), kind)
            p, q = (np.flatnonzero(own == table.column(c)[0].as_py()) for c in ("i", "j"))
            a = b = np.zeros(0, np.int64)
            # a strip at a time, contracted with those before: a few MB of pairs
            for k in range(0, p.size, STRIP):
                u, v = np.nonzero(x[p[k : k + STRIP]] @ x[q].T >= least)
                a, b = _stars(np.append(a, ids[p[k + u]]), np.append(b, ids[q[v]]))
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        return rows.repartition(*key, "i", "j").groupBy(*key, "i", "j").applyInArrow(run, "a long, b long")

    def run(self) -> DataFrame:
        """(vec_id, n_links, component_id, kept) for every row."""
        scratch = self.scratch
        rows = scratch.save(
            valid_vectors(self.vectors, *self.columns).groupBy("id").agg(
                F.min(F.struct("label", "dim", "vec", "sketch")).alias("r")
            ).select("id", "r.*"),
            "rows",
        )
        nodes = scratch.save(rows.groupBy("label", "dim", "vec", "sketch").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "nodes")
        edges, stars, step, self.recall = None, None, 0, 0.0
        for seed in range(SEEDS):
            before = None
            for r in range(ROUNDS + 1):
                fresh = scratch.save(self._round(edges, nodes) if r else self._start(nodes, seed), f"found-{step}")
                linked = fresh.where(F.col("sim").isNull() | (F.col("sim") >= self.threshold)).select(F.col("u").alias("a"), F.col("v").alias("b"))
                stars = contract(linked if stars is None else stars.union(linked), scratch, f"stars-{step}")
                pairs = fresh.where("sim is not null")
                edges = scratch.save(self._lists(pairs if edges is None else edges.union(pairs), 2 + max(r - 1, 0)), f"lists-{step}")
                scratch.drop(f"found-{step}")
                step += 1
                now = stars.count()  # grows with each node or component that is linked
                if now == before:
                    break
                before = now
            cc = scratch.save(members(stars), f"component-{seed}")
            links = scratch.save(self._links(nodes, cc), f"links-{seed}")
            self.recall = self._recall(nodes, links)
            if self.recall >= RECALL:
                break
        else:
            cc = scratch.save(members(contract(stars.union(self._all_pairs(nodes)), scratch, "stars-exact")), "component-exact")
            links = scratch.save(self._links(nodes, cc), "links-exact")
            self.recall = 1.0
        top = nodes.join(cc.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left")
        top = top.select(
            "label",
            "dim",
            "vec",
            F.coalesce("component", "id").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"),
        )
        full = rows.join(top, ["label", "dim", "vec"]).select(F.col("id").alias("_id"), "component", "n")
        vec_id = self.columns[0]
        out = self.vectors.select(F.col(vec_id).cast("long").alias("vec_id")).join(full, F.col("vec_id") == F.col("_id"), "left")
        component = F.coalesce("component", "vec_id")
        return out.select(
            "vec_id",
            F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            (F.col("vec_id").eqNullSafe(component)).alias("kept"),
        )
