"""N-gram Jaccard self-join with rare-first prefixes and length, positional and suffix filters.

1. Every document's distinct word shingles become 64-bit hashes; a fixed table of counters, filled from
   all documents, tells frequent from rare ones. Documents with equal sets are one class from here on.
2. A shingle's key is its count in the high 16 bits and its hash in the low 48, so sorting a set by key
   puts rare shingles first. A pair with Jaccard >= t shares one of the first n - ceil(t n) + 1 keys.
3. First each class is compared with two others for a few of its keys only, which is linear in a group
   of copies, and what these links connect needs no comparison any more. Then all remaining pairs of a
   key are joined, component with component. Length and positional filters are join conditions.
4. The suffix filter runs before any set is read: a histogram of each set's hashes, of a byte for four
   shingles or fewer, bounds from below in how many shingles two sets differ. Pairs that may still link
   are verified once, on the sorted 64-bit sets of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.llm.components import components, contract
from quillspark.llm.scratch import Scratch, bit_test, bitmap, filter_bits, unused, without
from quillspark.llm.textarrays import U, chunks, mix, rolling, span_hashes, tidy, words

#: log2 of the counters that order shingles by frequency: 2 MB on each worker.
SKETCH_BITS = 20
#: Counts are kept up to this; keys that reach it are taken through a join that Spark can split.
MOST = 65535
#: log2 of the suffix filter's bins: about a quarter of the shingles, between these.
BINS_LEAST, BINS_MOST = 4, 12
#: After the first star round, while more pairs than this for each posting are unconnected, another one follows.
PAIRS_PER_ROW = 3
STAR_ROUNDS, STAR_KEYS = 3, 5
_BLOCK = 4096


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document: n lower-cased words, or the whole sequence if it is shorter."""
    s, e, first = words(buf, off)
    h = span_hashes(buf, s, e, lower=True)
    grams = rolling(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            out.append(g[np.append(True, g[1:] != g[:-1])])
        elif b > a:
            out.append(mix(rolling(h[a:b], b - a) + U(b - a)))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def _digest(g: np.ndarray) -> tuple[int, int]:
    return int(g.sum(dtype=U).view(np.int64)), int(mix(g).sum(dtype=U).view(np.int64))


def histogram(g: np.ndarray) -> bytes:
    """How many hashes of the set fall in each bin, 255 at most; the number of bins follows the set's size."""
    bits = min(max(int(g.size // 4).bit_length(), BINS_LEAST), BINS_MOST)
    at = (mix(g) >> U(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def differ_least(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their histograms."""
    p, q = (np.frombuffer(b, np.uint8).astype(np.int64) for b in (x, y))
    bins = min(p.size, q.size)  # leading bits choose the bin, so neighbours fold
    return int(np.abs(p.reshape(bins, -1).sum(axis=1) - q.reshape(bins, -1).sum(axis=1)).sum())


_SCAN = "doc_id long, n int, d long, d2 long, bins binary, block int, counts binary"


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (id, n, d, d2: digests of the set, bins) and, from each task, blocks of counters."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, size = np.zeros(1 << SKETCH_BITS, dtype=np.int64), [], 0

        def add() -> None:
            nonlocal held, size
            if held:
                low = np.concatenate(held) & U((1 << SKETCH_BITS) - 1)
                sketch[:] += np.bincount(low.astype(np.int64), minlength=sketch.size)
            held, size = [], 0

        def rows(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            d = np.array([_digest(x) for x in sets], dtype=np.int64).reshape(-1, 2)
            columns = [
                ids,
                pa.array([x.size for x in sets], pa.int32()),
                pa.array(d[:, 0]),
                pa.array(d[:, 1]),
                pa.array([histogram(x) if x.size else None for x in sets], pa.binary()),
                pa.nulls(len(sets), pa.int32()),
                pa.nulls(len(sets), pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=_names(_SCAN))

        def counters(block: int) -> pa.RecordBatch:
            part = np.minimum(sketch[block * _BLOCK : (block + 1) * _BLOCK], 2**31 - 1).astype("<u4")
            kind = "<u1" if part.max() < 256 else "<u2" if part.max() < 65536 else "<u4"
            zero = pa.array([0], pa.int64())
            columns = [
                pa.nulls(1, pa.int64()),
                zero.cast(pa.int32()),
                zero,
                zero,
                pa.nulls(1, pa.binary()),
                pa.array([block], pa.int32()),
                pa.array([part.astype(kind).tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=_names(_SCAN))

        for batch in batches:
            for a, b, buf, off in chunks(batch.column(1)):
                sets = shingle_sets(buf, off, n)
                held += sets
                size += sum(x.size for x in sets)
                if size > 1 << 20:
                    add()
                yield rows(batch.column(0).slice(a, b - a), sets)
        add()
        if sketch.any():
            for k in range(sketch.size // _BLOCK):
                yield counters(k)

    return docs.mapInArrow(run, _SCAN)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _sketch(scan: DataFrame) -> np.ndarray:
    """Summed counters, capped at MOST: 2**SKETCH_BITS numbers whatever the input."""

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, {1: "<u1", 2: "<u2", 4: "<u4"}[len(raw) // _BLOCK]).astype(np.int64)
                total[k] = total.get(k, 0) + part
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([np.minimum(v, MOST).astype("<u2").tobytes() for v in total.values()], pa.binary())],
                names=["block", "counts"],
            )

    blocks = (
        scan.where("block is not null")
        .select("block", "counts")
        .repartition(F.col("block"))
        .mapInArrow(add, "block int, counts binary")
        .collect()
    )
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint16)
    for r in blocks:
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(bytes(r["counts"]), "<u2")
    return out


def _keys(g: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Keys in global order: capped count above, 48 bits of hash below."""
    h = g & U((1 << 48) - 1)
    return np.sort((sketch[g & U((1 << SKETCH_BITS) - 1)].astype(U) << U(48)) | h)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-size * percent // 100) + 1 if size else 0


def _postings(docs: DataFrame, n: int, percent: int, sketch) -> DataFrame:
    """(key, d, n, pos) of the prefix of each class, once for each task that holds the class."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = sketch.value, set()
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(1)):
                key, d, size, pos = [], [], [], []
                for g in shingle_sets(buf, off, n):
                    own = _digest(g)
                    if not g.size or own in seen:
                        continue
                    seen.add(own)
                    p = prefix_length(g.size, percent)
                    key.append(_keys(g, table)[:p])
                    d += [own[0]] * p
                    size += [g.size] * p
                    pos.append(np.arange(p, dtype=np.int32))
                if key:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(key).view(np.int64)),
                            pa.array(np.array(d, np.int64)),
                            pa.array(np.array(size, np.int32)),
                            pa.array(np.concatenate(pos)),
                        ],
                        names=["key", "d", "n", "pos"],
                    )

    return docs.mapInArrow(run, "key long, d long, n int, pos int")


def _sets(docs: DataFrame, n: int, wanted) -> DataFrame:
    """(doc_id, set: sorted hashes) of the documents that may be wanted."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = bit_test(wanted.value, batch.column(2).to_numpy().view(U))
            batch = batch.filter(pa.array(hit))
            for a, b, buf, off in chunks(batch.column(1)):
                sets = [g.astype("<u8").tobytes() for g in shingle_sets(buf, off, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=["doc_id", "set"])

    return docs.withColumn("_h", F.xxhash64("doc_id")).mapInArrow(run, "doc_id long, set binary")


def _suffix_filter(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, near) of pairs with (a, b, na, nb, xa, xb): may the pair link, as far as its histograms tell."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()).tolist()
            xs, ys = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            # sets of n elements in all that link differ in (100 - percent) / (100 + percent) * n at most
            near = [differ_least(x, y) * (100 + percent) <= n * (100 - percent) for x, y, n in zip(xs, ys, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    return pairs.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long, near boolean")


def _verify(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold, by the exact intersection."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), "<u8") for c in (2, 3))
                z = np.sort(np.concatenate([x, y]))
                both = int((z[1:] == z[:-1]).sum())
                keep[k] = 100 * both >= percent * (x.size + y.size - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def _length(n1: str, n2: str, percent: int) -> Column:
    """Length filter."""
    return F.least(n1, n2).cast("long") * 100 >= F.greatest(n1, n2).cast("long") * percent


def _positional(n1: str, p1: str, n2: str, p2: str, percent: int) -> Column:
    """Positional filter for a pair whose first common key stands at p1 and p2."""
    x, y = F.col(n1).cast("long"), F.col(n2).cast("long")
    return F.least(x - F.col(p1), y - F.col(p2)) * (100 + percent) >= (x + y) * percent


class NgramJoin:
    """The join of one document table with itself, at Jaccard >= percent / 100 on n-word shingles.

    Null and blank texts have the empty set and link with nothing; a text of fewer than n words is one
    shingle; rows with equal sets are linked; rows that repeat a doc_id are one document whose sets all
    count; a null doc_id takes part in no link and isn't returned; other columns are not read.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch, n: int, percent: int, doc_id: str = "doc_id", text: str = "text"):
        self.docs = docs.where(F.col(doc_id).isNotNull()).select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )
        self.scratch, self.n, self.percent = scratch, n, percent
        self.spark = docs.sparkSession

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) for every document row."""
        scratch = self.scratch
        scan = scratch.save(_scan(self.docs, self.n), "scan")
        table = _sketch(scan)
        self.sketch = self.spark.sparkContext.broadcast(table)
        ids = scan.where("block is null").select("doc_id", "n", "d", "d2")
        classes = scratch.save(ids.where("n > 0").groupBy("d", "d2", "n").agg(F.min("doc_id").alias("rep")), "classes")
        shared = scratch.save(self._shared_keys(bool((table >= MOST).any())), "shared")
        reps = classes.select("d", "rep")
        tried = links = None
        before = float("inf")
        label = reps.select("d", F.col("rep").alias("c"))
        for k in range(STAR_ROUNDS + 1):
            rest = scratch.save(shared.join(label, "d"), f"rest-{k}")
            size = (
                rest.groupBy("key", "c")
                .agg(F.count("*").alias("n"))
                .groupBy("key")
                .agg(F.sum("n").alias("n"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
            )
            split = scratch.save(size.where("pairs > 0").select("key", "n", "pairs"), f"split-{k}")
            rows, pairs = split.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0.0))).first()
            rest = rest.join(split.select("key"), "key", "left_semi")
            # where a star round left over a quarter, what is left is mostly pairs that do not link
            whole = k == STAR_ROUNDS or not pairs or k > 0 and (pairs <= PAIRS_PER_ROW * rows or 4 * pairs > before)
            before = pairs
            # the positional filter holds for a pair's first common key, which a star need not have
            new = self._candidates(self._all_pairs(rest) if whole else self._star_pairs(rest, k), reps)
            new = new if tried is None else new.join(tried, ["a", "b"], "left_anti")
            new = scratch.save(self._filtered(new, scan), f"pairs-{k}")
            found = scratch.save(self._links(new.where("near").select("a", "b")), f"links-{k}")
            links = found if links is None else links.union(found)  # contracted links still connect the same classes
            tried = new.select("a", "b") if tried is None else tried.union(new.select("a", "b"))
            scratch.drop(f"rest-{k}", f"split-{k}")
            if whole:
                break
            links = contract(links, scratch, f"star-{k}")
            own = links.select(F.col("a").alias("rep"), F.col("b").alias("c"))
            label = reps.join(own, "rep", "left").select("d", F.coalesce("c", "rep").alias("c"))
        scratch.drop("shared")
        # rows that repeat a doc_id join its sets' classes
        again = (
            ids.where("n > 0")
            .groupBy("doc_id")
            .agg(F.min("d").alias("d1"), F.max("d").alias("d2"))
            .where("d1 != d2")
            .select("doc_id")
            .join(ids, "doc_id")
            .where("n > 0")
            .join(classes, ["d", "d2", "n"])
            .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        )
        nodes = components(links.union(again), scratch, "cc")
        top = classes.join(nodes.withColumnRenamed("node", "rep"), "rep", "left").select(
            "d",
            "d2",
            "n",
            F.coalesce("component", "rep").alias("component"),
        )
        full = (
            ids.where("n > 0")
            .join(top, ["d", "d2", "n"])
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
        )
        return full.union(ids.where("n = 0").select("doc_id", F.lit(0).cast("long"), F.col("doc_id")))

    def _shared_keys(self, hot: bool) -> DataFrame:
        """Prefix postings of the keys that two classes have, each once.

        A key under MOST has fewer than MOST postings, as the counters never fall short; if a key may
        have more, minimum and maximum are combined before the shuffle and joined back instead.
        """
        p = _postings(self.docs, self.n, self.percent, self.sketch)
        if hot:
            p = self.scratch.save(p, "postings")
            ends = p.groupBy("key").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo != hi").select("key")
            return p.join(ends, "key").distinct()
        w = W.partitionBy("key")
        return p.withColumn("lo", F.min("d").over(w)).withColumn("hi", F.max("d").over(w)).where("lo != hi").drop("lo", "hi").distinct()

    def _star_pairs(self, rest: DataFrame, seed: int) -> DataFrame:
        """Each class with two of other components for a few of its keys: linear in the rows.

        One is chosen by a hash. The other has the fewest rarer keys before the common one: of a group
        of copies that is the least edited one, which most of the others are near to.
        """
        h = F.xxhash64("d", "key", F.lit(seed)).alias("h")
        own = F.struct(F.lit(0).alias("first"), h, "c", "d", "n", "pos")
        least = F.struct(F.col("pos").alias("first"), h, "c", "d", "n", "pos")
        ends = rest.groupBy("key").agg(F.min(least).alias("lo"), F.max(own).alias("hi"))
        rows = rest.join(ends, "key")
        rows = rows.select(
            "d",
            "c",
            "n",
            "pos",
            F.explode(F.array("lo", "hi")).alias("y"),
            F.xxhash64("key", F.lit(seed)).alias("h"),
        ).where("c != y.c")
        picks = [f(F.struct(F.xxhash64("h", F.lit(k)), "n", "pos", "y")).alias(f"p{k}{f.__name__}") for k in range(STAR_KEYS) for f in (F.min, F.max)]
        picked = (
            rows.groupBy("d")
            .agg(*picks)
            .select("d", F.explode(F.array(*[f"p{k}{f}" for k in range(STAR_KEYS) for f in ("min", "max")])).alias("p"))
        )
        return picked.select(
            F.col("d").alias("x"),
            F.col("p.y.d").alias("y"),
            F.col("p.n").alias("nx"),
            F.col("p.pos").alias("px"),
            F.col("p.y.n").alias("ny"),
            F.col("p.y.pos").alias("py"),
        )

    def _all_pairs(self, rest: DataFrame) -> DataFrame:
        """Every two classes of a key that the links so far do not connect and the filters let pass."""
        x = rest.select("key", F.col("d").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("c").alias("cx"))
        y = rest.select("key", F.col("d").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("c").alias("cy"))
        may = (F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & _length("nx", "ny", self.percent)
        return x.join(y, "key").where(may & _positional("nx", "px", "ny", "py", self.percent))

    def _candidates(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Distinct pairs of representatives (a < b) that pass the length filter."""
        pairs = pairs.where(_length("nx", "ny", self.percent)).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        pairs = pairs.join(
            reps.select(F.col("d").alias("x"), F.col("rep").alias("a")),
            "x",
        ).join(reps.select(F.col("d").alias("y"), F.col("rep").alias("b")), "y")
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()

    def _filtered(self, pairs: DataFrame, scan: DataFrame) -> DataFrame:
        """(a, b, near): pairs with what the suffix filter says of them."""
        bins = scan.where("n > 0").select("doc_id", "n", "bins")
        left = bins.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bins").alias("xa"))
        right = bins.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("xb"))
        # rows that repeat a doc_id: one of their sets may do
        return _suffix_filter(pairs.join(left, "a").join(right, "b"), self.percent).groupBy("a", "b").agg(F.max("near").alias("near"))

    def _links(self, pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct()
        bits = filter_bits(2 * pairs.count())  # it picks the documents whose sets are read; the joins are exact
        wanted = self.spark.sparkContext.broadcast(bitmap(ends, F.xxhash64("d"), bits))
        sets = _sets(self.docs, self.n, wanted)
        left = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("xa"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("xb"))
        return _verify(pairs.join(left, "a").join(right, "b"), self.percent).distinct()


def keep_one(docs: DataFrame, scratch: Scratch, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that a smaller doc_id's group of near-duplicates already has.

    Rows without a doc_id stay. Rows that repeat a doc_id are one document, so of those that repeat the
    kept one a single row stays, the first by text. Columns of any name pass through.
    """
    groups = NgramJoin(docs, scratch, n, percent).run()
    again, rank = unused(docs.columns, "again", "rank")
    kept = F.max(F.col("doc_id") == F.col("component_id")).alias("kept")
    gone = scratch.save(groups.groupBy("doc_id").agg(kept).where("not kept").select("doc_id"), "gone")
    named = without(docs.where("doc_id is not null"), gone, "doc_id")
    twice = named.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again))
    if not twice.isEmpty():
        rows = named.join(twice, F.col("doc_id") == F.col(again), "left_semi")
        place = F.row_number().over(W.partitionBy("doc_id").orderBy("text", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
        rows = rows.withColumn(rank, place).where(F.col(rank) == 1).drop(rank)
        named = named.join(twice, F.col("doc_id") == F.col(again), "left_anti").union(rows)
    return named.union(docs.where("doc_id is null"))
