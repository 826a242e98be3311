"""Text as numpy arrays: words, rolling hashes and sliding minima over Arrow string buffers.

All functions work on a chunk of whole documents: ``buf`` holds their UTF-8 bytes and ``off`` the
start of each document in it, plus the end of the last.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that a chunk holds unless a single document is longer.
CHUNK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NONSPACE = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = U(0x9E6C63D0676A9A99)
_INV = U(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if _powers[0].size < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, so that every bit depends on every other."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Items of single bytes.
BYTE_ITEMS = mix(np.arange(1, 257, dtype=U))


def _trim() -> None:
    """Gives memory that the process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


#: What frees things that a worker keeps from task to task; tasks of another kind call it as they begin.
HELD: list[Callable[[], None]] = []


def _begin() -> None:
    """Called by name, so that it frees what this very process holds."""
    for free in HELD:
        free()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task function, whose worker keeps no memory of it, nor of what was held for tasks of another kind.

    Spark holds on to idle workers, and several of them share an executor's memory with what comes next.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        _begin()
        yield from run(batches)
        _trim()

    return wrapped


def holding(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """As :func:`tidy` for tasks that use what is held."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        _trim()

    return wrapped


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), off


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows (first, end, buf, off) of about ``limit`` bytes each."""
    data, off = string_buffers(column)
    first, n = 0, len(column)
    while first < n:
        end = min(n, max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1))
        yield first, end, data[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each document its first word's index."""
    solid = NONSPACE[buf]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = off[:-1] < off[1:]
    first, last = off[:-1][full], off[1:][full] - 1
    start[first], end[last] = solid[first], solid[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


#: Spans beyond this are hashed one by one.
LONG_SPAN = 1 << 12
_SPAN = U(0xA24BAED4963EE407)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans; ``lower`` maps A-Z to a-z first.

    Eight bytes at a time enter a bijective mix, so spans of one length up to eight bytes never collide,
    and longer ones do not by structure, as sums of powers can. Very long spans take a blake2b digest.
    """
    size = ends - starts
    padded = np.zeros(buf.size + 8, dtype=np.uint8)
    padded[: buf.size] = _LOWER[buf] if lower else buf
    octets = np.lib.stride_tricks.as_strided(padded.view(), (buf.size + 1, 8), (1, 1))
    h = size.astype(U) * _SPAN
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    done = 0
    while live.size:
        here = starts[live] + done
        block = octets[here].view("<u8").ravel()
        left = size[live] - done
        short = left < 8
        block[short] &= (U(1) << (left[short].astype(U) << U(3))) - U(1)
        h[live] = mix(h[live] + block)
        live = live[left > 8]
        done += 8
    for k in np.flatnonzero(size > LONG_SPAN):
        digest = hashlib.blake2b(padded[starts[k] : ends[k]].data, digest_size=8).digest()
        h[k] = mix(np.frombuffer(digest, "<u8").astype(U) + h[k])[0]
    return h


def prefix_sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`range_hashes` takes: sums of items times powers, and inverse powers."""
    p, inv = powers(h.size + 1)
    acc = np.zeros(h.size + 1, dtype=U)
    np.cumsum(h * p[:-1], out=acc[1:])
    return acc, inv


def range_hashes(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, n) -> np.ndarray:
    """Hashes of the ``n`` items from each start on. Of one length, they tell well-mixed items apart."""
    acc, inv = sums
    return mix((acc[start + n] - acc[start]) * inv[start])


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive items (those that cross documents too)."""
    if h.size < n:
        return np.zeros(0, dtype=U)
    acc, inv = prefix_sums(h)
    return mix((acc[n:] - acc[:-n]) * inv[: h.size - n + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    out, size = x, 1
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < w:
        n = x.size - w + 1
        out = np.minimum(out[:n], out[w - size : w - size + n])
    return out


def anchors(grams: np.ndarray, w: int) -> np.ndarray:
    """For every w consecutive grams the index of the anchor: the leftmost with the smallest leading bits.

    It depends on the grams alone, so equal windows have equal anchors at equal distances.
    """
    if grams.size < w:
        return np.zeros(0, dtype=np.int64)
    low = U((1 << 28) - 1)
    if grams.size > int(low):
        raise ValueError("over 268 million grams are anchored piece by piece")
    packed = (grams & ~low) | np.arange(grams.size, dtype=U)
    return (sliding_min(packed, w) & low).astype(np.int64)
