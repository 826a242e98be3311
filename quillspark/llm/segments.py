"""Repeated windows of texts, found through content-defined anchors.

Every window of ``length`` items (words or bytes) has an anchor among its grams of ``gram`` items, see
:func:`textarrays.anchors`; consecutive windows with one anchor make a segment, keyed by the anchor's
hash. Equal windows lie in segments with equal keys, so only segments whose key occurs twice can hold
a repeat, and comparing within a key is enough.

Equal segments are combined twice, in the task that cuts them and in the one that compares them, both
times after a comparison of their bytes. What a task finds twice in its own documents is settled there
and leaves it as ranges of windows; of each different content one row goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.scratch import Scratch, bit_test, bitmap, filter_bits
from quillspark.llm.textarrays import BYTE_ITEMS, NONSPACE, U, anchors, chunks, mix, prefix_sums, range_hashes, span_hashes, tidy, words

#: A key with so many different contents, a content counted once for each task's share, is compared window by window.
HOT = 1000
#: Payload that a task gathers before it combines equal segments and sends them on.
FLUSH_BYTES = 12 << 20
#: Bytes that a task of the comparison should read.
TASK_BYTES = 128 << 20
#: Windows that are anchored at a time.
PIECE = 1 << 22


@dataclass(frozen=True)
class Items:
    """Item hashes of a chunk, each document's first item, and each item's bytes in ``data``."""

    hashes: np.ndarray
    first: np.ndarray
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray


@dataclass(frozen=True)
class Kind:
    """What is compared: windows of ``length`` words or bytes, anchored by grams of ``gram``."""

    unit: str
    length: int
    gram: int

    def items(self, buf: np.ndarray, off: np.ndarray) -> Items:
        """Words stand in ``data`` with one blank between those of a document, so that other white space makes no difference."""
        if self.unit == "byte":
            at = np.arange(buf.size + 1)
            return Items(BYTE_ITEMS[buf], off, buf, at[:-1], at[1:])
        s, e, first = words(buf, off)
        solid = NONSPACE[buf]
        kept = solid.copy()
        ahead = s[s > 0] - 1
        kept[ahead] = True
        data = np.where(solid, buf, np.uint8(32))[kept]
        at = np.cumsum(kept) - kept
        return Items(span_hashes(buf, s, e), first, data, at[s], at[e - 1] + 1)

    def segments(self, items: Items) -> Segments:
        """The segments of a chunk, in order."""
        h, first = items.hashes, items.first
        none = np.zeros(0, dtype=np.int64)
        sums = prefix_sums(h)
        count = h.size - self.length + 1
        if count <= 0:
            return Segments(none.astype(U), none.astype(U), none, none, none, sums)
        acc, inv = sums
        grams = mix((acc[self.gram :] - acc[: -self.gram]) * inv[: h.size - self.gram + 1])
        at = np.concatenate(
            [
                base + anchors(grams[base : min(base + PIECE, count) + self.length - self.gram], self.length - self.gram + 1)
                for base in range(0, count, PIECE)
            ]
        )
        doc = np.repeat(np.arange(first.size - 1), np.diff(first))
        inside = doc[:count] == doc[self.length - 1 :]
        begin = inside.copy()
        begin[1:] &= (at[1:] != at[:-1]) | ~inside[:-1] | (doc[1:count] != doc[: count - 1])
        lo = np.flatnonzero(begin)
        bounds = np.append(np.flatnonzero(~inside | begin), count)
        n = bounds[np.searchsorted(bounds, lo, side="right")] - lo
        content = mix(range_hashes(sums, lo, n + self.length - 1) + n.astype(U))
        return Segments(grams[at[lo]], content, doc[lo], lo, n, sums)


@dataclass(frozen=True)
class Segments:
    """Key, hash of the content, document, first window and number of windows of each segment."""

    key: np.ndarray
    content: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    sums: tuple[np.ndarray, np.ndarray]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(rk, text): rows are named by a hash of doc_id and text, so that a repeated doc_id is no trouble."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(F.col(doc_id), t).alias("rk"), t.alias("text"))


def keys(docs: DataFrame, kind: Kind) -> DataFrame:
    """(fp, n, m): how many segments of each key a task's documents have, and how many different ones."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            key, content = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((content, key))
            key, content = key[order], content[order]
            new = np.append(True, key[1:] != key[:-1])
            other = new | np.append(True, content[1:] != content[:-1])
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, key.size))
            m = np.add.reduceat(other.astype(np.int64), start)
            return pa.RecordBatch.from_arrays([pa.array(key[start].view(np.int64)), pa.array(n), pa.array(m)], names=["fp", "n", "m"])

        for batch in batches:
            for _, _, buf, off in chunks(batch.column(1)):
                s = kind.segments(kind.items(buf, off))
                held.append((s.key, s.content))
                size += s.key.size
                if size > 1 << 20:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return docs.select("rk", "text").mapInArrow(run, "fp long, n long, m long")


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of ``size`` places, for each pair."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _binary(data: bytes, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), bounds.size - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _unequal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] and data[b : b + size] differ, for each pair."""
    out = np.zeros(a.size, dtype=bool)
    some = np.flatnonzero((size > 0) & (a != b))
    total = np.cumsum(size[some])
    done = 0
    while done < some.size:  # about a megabyte at a time
        end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + (1 << 20))))
        part, n = some[done:end], size[some[done:end]]
        out[part] = np.logical_or.reduceat(data[_spread(a[part], n)] != data[_spread(b[part], n)], np.cumsum(n) - n)
        done = end
    return out


def _merged(rk: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows (first to last), those of a document that touch made one."""
    order = np.lexsort((e, s, rk))
    rk, s, e = rk[order], s[order], e[order]
    if not rk.size:
        return rk, s, e
    # the furthest end so far: documents lie apart on one axis
    doc = np.cumsum(np.append(False, rk[1:] != rk[:-1]))
    wide = int(e.max()) + 3
    reach = np.maximum.accumulate(doc * wide + e)
    new = np.append(True, (doc * wide + s)[1:] > reach[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], rk.size) - 1
    return rk[at], s[at], reach[last] - doc[last] * wide


_ROWS = "fp long, ck long, n int, rk long, lo int, payload binary"


class _Combiner:
    """Equal segments of a task become one row; the places of those it finds twice leave as ranges."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.payload: list[np.ndarray] = []
        self.bytes = 0

    def add(self, fp: np.ndarray, ck: np.ndarray, rk: np.ndarray, lo: np.ndarray, n: np.ndarray, size: np.ndarray, payload: np.ndarray) -> None:
        if fp.size:
            self.parts.append((fp, ck, rk, lo, n, size))
            self.payload.append(payload)
            self.bytes += payload.nbytes + 48 * fp.size

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Rows of :data:`_ROWS`: a segment without rk has places that are settled; n = 0: windows lo to ck of rk repeat."""
        if not self.parts:
            return
        fp, ck, rk, lo, n, size = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        data = np.concatenate(self.payload)
        self.clear()
        start = np.cumsum(size) - size
        order = np.lexsort((ck, fp))
        new = np.append(True, (fp[order][1:] != fp[order][:-1]) | (ck[order][1:] != ck[order][:-1]))
        group = np.empty(fp.size, dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        head = order[new]
        odd = (size != size[head[group]]) | (n != n[head[group]])
        odd |= _unequal(data, start, start[head[group]], np.where(odd, 0, size))
        many = np.bincount(group[~odd], minlength=head.size)
        alone = odd | (many[group] == 1)
        done = np.flatnonzero(~alone)
        r, s, e = _merged(rk[done], lo[done], lo[done] + n[done] - 1)
        own = np.append(np.flatnonzero(alone), head[many > 1])
        own = own[np.argsort(fp[own], kind="stable")]  # neighbours compress better
        place = alone[own]
        bounds = np.append(0, np.cumsum(size[own]))
        raw = data.tobytes()
        body = b"".join([raw[x:y] for x, y in zip(start[own].tolist(), (start + size)[own].tolist(), strict=True)])
        rows = [
            pa.array(fp[own].view(np.int64)),
            pa.array(ck[own].view(np.int64)),
            pa.array(n[own].astype(np.int32)),
            pa.array(rk[own], mask=~place),
            pa.array(lo[own].astype(np.int32)),
            _binary(body, bounds),
        ]
        ranges = [
            pa.array(mix(r.view(U)).view(np.int64)),
            pa.array(e.astype(np.int64)),
            pa.array(np.zeros(r.size, np.int32)),
            pa.array(r),
            pa.array(s.astype(np.int32)),
            pa.nulls(r.size, pa.binary()),
        ]
        for columns in (rows, ranges):
            batch = pa.RecordBatch.from_arrays(columns, names=["fp", "ck", "n", "rk", "lo", "payload"])
            for k in range(0, batch.num_rows, 4096):
                yield batch.slice(k, 4096)


def emit(docs: DataFrame, kind: Kind, wanted, hot) -> DataFrame:
    """:data:`_ROWS` of the segments whose key may repeat, equal ones of a task combined.

    The payload is the segment's bytes. A hot key's windows go one by one, without payload and by two
    independent 64-bit hashes of their own content, so that the contexts around a very common passage
    do not meet in one task. Hot is what a filter says of the key, hence the same in every task.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Combiner()
        for batch in batches:
            name = batch.column(0).to_numpy()
            for a, _, buf, off in chunks(batch.column(1)):
                items = kind.items(buf, off)
                s = kind.segments(items)
                keep = bit_test(wanted.value, s.key)
                busy = keep & bit_test(hot.value, s.key)
                keep &= ~busy
                if busy.any():
                    at, doc = _spread(s.lo[busy], s.n[busy]), np.repeat(s.doc[busy], s.n[busy])
                    again = prefix_sums(mix(items.hashes + U(1)))
                    one, none = np.ones(at.size, dtype=np.int64), np.zeros(at.size, dtype=np.int64)
                    out.add(
                        mix(range_hashes(s.sums, at, kind.length)),
                        range_hashes(again, at, kind.length),
                        name[a + doc],
                        at - items.first[doc],
                        one,
                        none,
                        np.zeros(0, np.uint8),
                    )
                lo, n, doc = s.lo[keep], s.n[keep], s.doc[keep]
                begin = items.begin[lo]
                size = items.end[lo + n + kind.length - 2] - begin
                out.add(s.key[keep], s.content[keep], name[a + doc], lo - items.first[doc], n, size, items.data[_spread(begin, size)])
                if out.bytes > FLUSH_BYTES:
                    yield from out.flush()
        yield from out.flush()

    return docs.select("rk", "text").mapInArrow(run, _ROWS)


Judge = Callable[[np.ndarray, np.ndarray, list[bytes]], np.ndarray]


def _settle(table: pa.Table, judge: Judge) -> pa.RecordBatch:
    """(rk, s, e): the ranges of repeated windows of a block of whole keys, sorted by key and content."""
    known = table.column(2).to_numpy() == 0
    passed = table.filter(pa.array(known))
    table = table.filter(pa.array(~known)).combine_chunks()
    fp, ck, n, lo = (table.column(i).to_numpy() for i in (0, 1, 2, 4))
    n, lo = n.astype(np.int64), lo.astype(np.int64)
    lone = ~np.asarray(table.column(3).is_null()).astype(bool)
    rk = table.column(3).fill_null(0).to_numpy()
    payload = table.column(5).combine_chunks() if table.num_rows else pa.array([], pa.binary())
    if isinstance(payload, pa.ChunkedArray):
        payload = payload.combine_chunks()
    off = np.frombuffer(
        payload.buffers()[1],
        np.int32,
    )[payload.offset : payload.offset + len(payload) + 1].astype(np.int64) if len(payload) else np.zeros(1, np.int64)
    data = np.frombuffer(payload.buffers()[2], np.uint8) if len(payload) and payload.buffers()[2] else np.zeros(0, np.uint8)
    size = np.diff(off)
    # rows of one content become one; a row whose bytes are others than its hash says stays by itself
    new = np.ones(fp.size, dtype=bool)
    new[1:] = (fp[1:] != fp[:-1]) | (ck[1:] != ck[:-1]) | (size[1:] != size[:-1]) | (n[1:] != n[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if fp.size else np.zeros(0, np.int64)
    new |= _unequal(data, off[:-1], off[head], size)
    head[new] = np.flatnonzero(new)
    first = np.flatnonzero(new)
    content = np.searchsorted(first, head)
    twice = np.bincount(content, weights=np.where(lone, 1, 2), minlength=first.size) > 1
    flags = np.repeat(twice, n[first])
    bounds = np.append(0, np.cumsum(n[first]))
    key = np.cumsum(np.append(True, fp[first][1:] != fp[first][:-1])) - 1 if first.size else first
    work = np.flatnonzero((np.bincount(key, minlength=1)[key] > 1) & (size[first] > 0)) if first.size else first
    if work.size:
        raw = data.tobytes()
        found = judge(key[work], n[first[work]], [raw[off[r] : off[r + 1]] for r in first[work]])
        flags[_spread(bounds[work], n[first[work]])] |= found
    # runs of flagged windows in each content, then at each of its places
    row = np.repeat(np.arange(first.size), n[first])
    edge = np.append(True, row[1:] != row[:-1]) if row.size else np.zeros(0, bool)
    s = np.flatnonzero(flags & (edge | ~np.append(False, flags[:-1])))
    stop = np.append(edge[1:], True) if row.size else edge
    e = np.flatnonzero(flags & (stop | ~np.append(flags[1:], False)))
    many = np.bincount(row[s], minlength=first.size)
    start = np.cumsum(many) - many
    places = np.flatnonzero(lone)
    c = content[places]
    take = _spread(start[c], many[c])
    base = np.repeat(lo[places], many[c])
    own = np.repeat(rk[places], many[c])
    in_row = bounds[np.repeat(c, many[c])]
    r = np.concatenate([own, passed.column(3).to_numpy()])
    s = np.concatenate([base + s[take] - in_row, passed.column(4).to_numpy().astype(np.int64)])
    e = np.concatenate([base + e[take] - in_row, passed.column(1).to_numpy()])
    r, s, e = _merged(r, s, e)
    return pa.RecordBatch.from_arrays(
        [pa.array(r.astype(np.int64)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))],
        names=["rk", "s", "e"],
    )


def compare(rows: DataFrame, block_bytes: int, judge: Judge) -> DataFrame:
    """Judges segments key by key, in blocks of whole keys, and returns the repeated windows (rk, s, e).

    ``judge(key, n, payloads)`` flags the windows, of different contents with equal keys, that occur twice.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < block_bytes:
                continue
            table = pa.Table.from_batches(held)
            fp = table.column(0).to_numpy()
            ends = np.append(np.flatnonzero(fp[1:] != fp[:-1]) + 1, fp.size)  # where another key begins
            weight = np.cumsum(
                np.concatenate(
                    [
                        np.diff(np.frombuffer(b.column(5).buffers()[1], np.int32)[b.column(5).offset : b.column(5).offset + len(b) + 1])
                        for b in held if len(b)
                    ]
                ).astype(np.int64) + 48
            )
            done = 0
            for end in ends[:-1].tolist():
                if weight[end - 1] - (weight[done - 1] if done else 0) >= block_bytes:
                    yield _settle(table.slice(done, end - done), judge)
                    done = end
            if ends.size > 1 and ends[-2] > done:
                yield _settle(table.slice(done, int(ends[-2]) - done), judge)
                done = int(ends[-2])
            held = table.slice(done).to_batches()
            size = sum(b.nbytes for b in held) if done else 0  # one key fills the block: wait for as much again
        if held:
            yield _settle(pa.Table.from_batches(held), judge)

    return rows.mapInArrow(run, "rk long, s int, e int")


def repeated(docs: DataFrame, kind: Kind, repeats: DataFrame, block_bytes: int, judge: Judge, scratch: Scratch) -> DataFrame:
    """(rk, spans) of the documents with repeated windows; ``repeats`` has the keys (fp, n, m) that occur twice."""
    spark = docs.sparkSession
    busy = repeats.where(F.col("m") >= HOT)
    row = repeats.agg(
        F.count("*").alias("k"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count(F.when(F.col("m") >= HOT, 1)).alias("hot"),
    ).first()
    wanted = spark.sparkContext.broadcast(bitmap(repeats, F.col("fp"), filter_bits(row["k"])))
    hot = spark.sparkContext.broadcast(bitmap(busy, F.col("fp"), filter_bits(row["hot"])))
    each = 3 * kind.length if kind.unit == "byte" else 12 * kind.length
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-row["n"] * each // TASK_BYTES))
    rows = emit(docs, kind, wanted, hot).repartition(n, "fp").sortWithinPartitions("fp", "ck")
    found = compare(rows, block_bytes, judge)
    return scratch.save(found.groupBy("rk").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")


def covered(size: int, spans: list, length: int) -> np.ndarray:
    """Which of ``size`` items windows starting in any of the (s, e) ranges cover."""
    edge = np.zeros(size + 1, dtype=np.int64)
    if spans:
        s = np.array([[x["s"], x["e"]] for x in spans], dtype=np.int64)
        np.add.at(edge, s[:, 0], 1)
        np.add.at(edge, np.minimum(s[:, 1] + length, size), -1)
    return np.cumsum(edge[:-1]) > 0
