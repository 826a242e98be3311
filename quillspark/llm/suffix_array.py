"""Byte-level deduplication with suffix arrays.

Segments of text that may hold a repeat (see :mod:`segments`) are dealt to shards by their anchor, and
equal ones become one after a comparison of their bytes. Where a key is left with several contents, a
shard builds a suffix array by Larsson-Sadakane refinement and the common prefixes of neighbours by
Kasai's rule, and a window of 200 bytes repeats if a neighbour shares that many. A key too large for a
shard is cut into several, which are merged by binary search over their sorted windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import segments
from quillspark.llm.scratch import Scratch
from quillspark.llm.textarrays import U, string_buffers, tidy

KIND = segments.Kind("byte", 200, 32)
BLOCK_BYTES = 1 << 20
#: Symbols of a shard at most: ranks of two positions and an index share 64 bits.
SHARD_SYMBOLS = (1 << 21) - 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a text of symbols under 511, by rank doubling on the unsorted alone.

    Only groups of equal rank are sorted again; a group's rank is the index of its end, as in Larsson
    and Sadakane's algorithm, so settled suffixes keep theirs. Keys and positions are packed into one
    word so that a plain sort orders them. A suffix that ends sorts ahead of one that goes on.
    """
    n = text.size
    if n > SHARD_SYMBOLS:
        raise ValueError("a shard is limited to two million symbols")
    low = U((1 << 21) - 1)
    ahead = np.zeros(n + 3, dtype=U)
    ahead[:n] = text.astype(U) + U(1)
    packed = (ahead[:n] << U(27)) | (ahead[1 : n + 1] << U(18)) | (ahead[2 : n + 2] << U(9)) | ahead[3:]
    packed = np.sort((packed << U(21)) | np.arange(n, dtype=U))
    sa = (packed & low).astype(np.int64)
    key = packed >> U(21)
    rank = np.zeros(n + 1, dtype=np.int64)

    def assign(at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Ranks the suffixes that stand at these places; returns those not alone."""
        last = np.append(key[1:] != key[:-1], True)
        ends = np.flatnonzero(last)
        group = np.cumsum(last) - last
        rank[sa[at]] = at[ends[group]] + 1
        alone = last & np.append(True, last[:-1])
        return at[~alone]

    at = assign(np.arange(n), key)
    h = 4
    while at.size:
        here = sa[at]
        follow = rank[np.minimum(here + h, n)]
        packed = np.sort((rank[here].astype(U) << U(42)) | (follow.astype(U) << U(21)) | here.astype(U))
        sa[at] = (packed & low).astype(np.int64)
        at = assign(at, packed >> U(21))
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, by Kasai's rule.

    In text order a value is the one before less 1, unless the symbols before differ; there alone the
    suffixes are compared, and the rest follow.
    """
    n = text.size
    if not n:
        return np.zeros(0, dtype=np.int64)
    before = np.empty(n, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    i = np.arange(n)
    fresh = (before <= 0) | (i == 0) | (text[i - 1] != text[before - 1])
    at = np.flatnonzero(fresh)
    value = np.zeros(at.size, dtype=np.int64)
    live = np.flatnonzero(before[at] >= 0)
    padded = np.append(text, np.int16(-1))
    while live.size:
        a, b = at[live] + value[live], before[at[live]] + value[live]
        same = padded[np.minimum(a, n)] == padded[np.minimum(b, n)]
        same &= (a < n) & (b < n)
        live = live[same]
        value[live] += 1
    head = np.maximum.accumulate(np.where(fresh, i, 0))
    full = np.zeros(n, dtype=np.int64)
    full[at] = value
    plcp = full[head] - (i - head)
    return np.maximum(plcp, 0)[sa]


def _repeats(pieces: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags by byte of the joined pieces: does the window that starts there occur twice; also sa and lcp."""
    size = np.array([p.size + 1 for p in pieces])
    text = np.empty(int(size.sum()), dtype=np.int16)
    ends = np.cumsum(size) - 1
    inner = np.ones(text.size, dtype=bool)
    inner[ends] = False
    text[inner] = np.concatenate(pieces)
    text[ends] = 256  # no window of a piece holds the symbol that ends it, so none matches across pieces
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa)
    near = lcp >= length
    flags = np.zeros(text.size, dtype=bool)
    flags[sa] = near | np.append(near[1:], False)
    return flags, inner, sa


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Across shards: sorted windows of each shard, with their ids, against those of the ones before by binary search."""
    hits: list[np.ndarray] = []
    for k, (mine, ids) in enumerate(parts):
        for other, other_ids in parts[:k]:
            if not mine.size or not other.size:
                continue
            a = np.searchsorted(other, mine)
            found = np.zeros(mine.size, dtype=bool)
            ok = a < other.size
            found[ok] = other[a[ok]] == mine[ok]
            hits.append(ids[found])
            b = np.searchsorted(mine, other)
            found = np.zeros(other.size, dtype=bool)
            ok = b < mine.size
            found[ok] = mine[b[ok]] == other[ok]
            hits.append(other_ids[found])
    return hits


def judge(
    fp: np.ndarray,
    ck: np.ndarray,
    n: np.ndarray,
    payload: list[bytes],
    places: np.ndarray,
    length: int = KIND.length,
    limit: int = BLOCK_BYTES,
) -> np.ndarray:
    """Flags the windows of a block of segments that occur twice."""
    bounds = np.concatenate([[0], np.cumsum(n)])
    flags = np.repeat(places > 1, n)
    size = np.array([len(p) for p in payload])
    _, group, members = np.unique(fp, return_inverse=True, return_counts=True)
    work = np.flatnonzero((size > 0) & (members[group] > 1))
    shards, first = [], 0
    total = np.cumsum(size[work] + 1)
    while first < work.size:
        base = total[first - 1] if first else 0
        end = min(work.size, max(first + 1, int(np.searchsorted(total, base + limit, side="right"))), first + 60_000)
        shards.append(work[first:end])
        first = end
    several = []
    for k, rows in enumerate(shards):
        pieces = [np.frombuffer(payload[r], np.uint8) for r in rows]
        own, inner, sa = _repeats(pieces, length)
        at = np.concatenate([[0], np.cumsum(size[rows] + 1)])
        take = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(n[rows])])[:-1], n[rows]) + np.arange(n[rows].sum())
        target = np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(n[rows])])[:-1], n[rows]) + np.arange(n[rows].sum())
        flags[target] |= own[take]
        # a key that goes on in another shard is merged with it
        cut = (k > 0 and fp[shards[k - 1][-1]] == fp[rows[0]]) or (k + 1 < len(shards) and fp[shards[k + 1][0]] == fp[rows[-1]])
        if cut:
            edge = np.isin(fp[rows], [fp[rows[0]], fp[rows[-1]]])
            text = np.concatenate([np.append(p, np.uint8(0)) for p in pieces])
            mine = np.repeat(edge, n[rows])
            where = take[mine]
            order = np.argsort(np.argsort(sa)[where])  # in the order of the suffix array
            where, ids = where[order], target[mine][order]
            view = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(length, np.uint8)), length)[where]
            several.append(
                (np.ascontiguousarray(np.concatenate([view, np.ones((where.size, 1), np.uint8)], axis=1)).view(f"S{length + 1}").ravel(), ids)
            )
    if len(several) > 1:
        for ids in _merge([(np.sort(a), i[np.argsort(a, kind="stable")]) for a, i in several]):
            flags[ids] = True
    return flags


def dedup(docs: DataFrame, scratch: Scratch, kind: segments.Kind = KIND, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) after removing every byte of a repeated window.

    Null texts are empty; texts shorter than a window are kept whole; rows with one doc_id or none are
    documents of their own; equal rows repeat each other. What is kept may cut a character in two, so
    it is binary. An empty table gives no row; other columns are not read.
    """
    rows = segments.keyed(docs, doc_id, text)
    counts = scratch.save(segments.keys(rows, kind).groupBy("fp").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > 1"), "counts")
    shards = lambda key, n, payload: judge(key, key, n, payload, np.ones(n.size, np.int64), kind.length)
    spans = segments.repeated(rows, kind, counts, BLOCK_BYTES, shards, scratch)

    @tidy
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = batch.column(2)
            total, gone, runs, sha, kept = [], [], [], [], []
            data, off = string_buffers(batch.column(1))
            for k in range(batch.num_rows):
                buf = data[off[k] : off[k + 1]]
                hit = segments.covered(buf.size, found[k].as_py(), kind.length)
                rest = buf[~hit].tobytes()
                total.append(buf.size)
                gone.append(int(hit.sum()))
                runs.append(int(hit[:1].sum() + (hit[1:] & ~hit[:-1]).sum()))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(total, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(runs, pa.int64()),
                    pa.array(sha, pa.string()),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    t = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(F.col(doc_id), t).alias("rk"))
    return (
        named.join(spans, "rk", "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )
