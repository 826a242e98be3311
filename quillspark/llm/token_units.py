"""Whole-document BPE encoding through a cache of independent text units.

The byte-level pre-tokenizer never merges across certain places (before the last blank of a run that
a word follows, after a line break, between an ASCII letter and ASCII punctuation). Texts are cut
there in numpy, each distinct unit is encoded once by the tokenizers library, and the ids are
gathered; documents with other white space or with a special token's text are encoded as they are.
A unit is looked up by a 64-bit hash, and its length and bytes are compared with the cached one's. The
cuts hold for a byte-level pre-tokenizer with its own pattern and no normalizer; with any other
tokenizer file every document is encoded as it is.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from itertools import chain

import numpy as np

from quillspark.llm.textarrays import HELD, span_hashes

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ODD = np.zeros(256, dtype=bool)
_ODD[[*range(0, 10), *range(11, 32), 127, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: UTF-8 of white space beyond ASCII.
_WIDE_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Units, and bytes of long units, that a worker's cache holds before it starts anew.
CACHE_UNITS, CACHE_BYTES = 1 << 19, 1 << 25
#: Places of the cache's hash table, twice as many as units.
TABLE = 1 << 20
#: Up to this length the hash tells units of one length apart.
SHORT = 8


@dataclass
class Encoded:
    """Token ids of a chunk of documents; ``first`` has each document's first token and the end."""

    ids: np.ndarray
    first: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


class UnitEncoder:
    """Encodes chunks of documents with a tokenizer file; with ``offsets`` also gives character spans in the document."""

    def __init__(self, path: str, offsets: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.offsets = Tokenizer.from_file(path), offsets
        self.cuts = self._byte_level()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _byte_level(self) -> bool:
        """Is the tokenizer one whose pre-tokenizer never merges across this module's cuts?"""
        parts = json.loads(self.tokenizer.to_str())
        pre = parts.get("pre_tokenizer") or {}
        return not parts.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)

    def _clear(self) -> None:
        self.keys, self.slot = np.zeros(TABLE, dtype=np.uint64), np.full(TABLE, -1, dtype=np.int32)  # open addressing
        self.size, self.text_at = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.text = np.zeros(0, dtype=np.uint8)
        self.at, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)
        self.spans = np.zeros((0, 2), dtype=np.int32)

    def _odd(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Indices of documents that can't be cut into units."""
        raw = None
        odd = np.zeros(off.size - 1, dtype=bool)
        hit = np.flatnonzero(_ODD[buf])
        if hit.size:
            for d in np.unique(np.searchsorted(off, hit, side="right") - 1):
                raw = buf[off[d] : off[d + 1]].tobytes()
                odd[d] = any(x in raw for x in _WIDE_SPACE) or bool((np.isin(buf[off[d] : off[d + 1]], [*range(0, 10), *range(11, 32), 127])).any())
        whole = buf.tobytes()
        for mark in self.special:
            at = whole.find(mark)
            while at >= 0:
                odd[np.searchsorted(off, at, side="right") - 1] = True
                at = whole.find(mark, at + 1)
        return np.flatnonzero(odd)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        encode = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        got = encode(texts, add_special_tokens=False)
        lists = [e.ids for e in got]  # each access makes a list anew
        count = np.fromiter(map(len, lists), dtype=np.int64, count=len(got))
        ids = np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(count.sum()))
        if not self.offsets:
            return ids, count, np.zeros((0, 2), np.int32)
        flat = chain.from_iterable(chain.from_iterable(e.offsets for e in got))
        spans = np.fromiter(flat, dtype=np.int32, count=2 * ids.size).reshape(-1, 2)
        return ids, count, spans

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key's unit, -1 if it isn't cached."""
        out = np.full(keys.size, -1, dtype=np.int64)
        place, live = (keys % np.uint64(TABLE)).astype(np.int64), np.arange(keys.size)
        while live.size:
            slot = self.slot[place]
            same = (slot >= 0) & (self.keys[place] == keys[live])
            out[live[same]] = slot[same]
            more = (slot >= 0) & ~same
            live, place = live[more], (place[more] + 1) % TABLE
        return out

    def _put(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """Enters new keys, each once."""
        place, live = (keys % np.uint64(TABLE)).astype(np.int64), np.arange(keys.size)
        while live.size:
            free = self.slot[place] < 0
            self.slot[place[free]] = slots[live[free]]
            won = free & (self.slot[place] == slots[live])  # of several for one place the last one stays
            self.keys[place[won]] = keys[live[won]]
            live, place = live[~won], (place[~won] + 1) % TABLE

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        ids, count, spans = self._encode([x.decode() for x in raw])
        long = [x if len(x) > SHORT else b"" for x in raw]
        kept = np.array([len(x) for x in long], dtype=np.int64)
        self.size = np.concatenate([self.size, np.array([len(x) for x in raw], dtype=np.int64)])
        self.text_at = np.concatenate([self.text_at, self.text.size + np.cumsum(kept) - kept])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(long), np.uint8)])
        at = self.ids.size + np.cumsum(count) - count
        self._put(keys, (self.at.size + np.arange(keys.size)).astype(np.int32))
        self.at, self.count = np.concatenate([self.at, at]), np.concatenate([self.count, count])
        self.ids, self.spans = np.concatenate([self.ids, ids]), np.concatenate([self.spans, spans])

    def _differ(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which units are not the ones cached at their slots, although their hashes are equal."""
        size = end - start
        bad = size != self.size[slot]
        long = np.flatnonzero((size > SHORT) & ~bad)
        if long.size:
            n = size[long]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            other = buf[np.repeat(start[long], n) + inner] != self.text[np.repeat(self.text_at[slot[long]], n) + inner]
            bad[long] = np.logical_or.reduceat(other, np.cumsum(n) - n)
        return bad

    def _cut(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        blank, line = buf == 32, buf == 10
        white = blank | line
        before, after = np.ones(buf.size, bool), np.ones(buf.size, bool)  # white space, or the document's edge
        before[1:], after[:-1] = white[:-1], white[1:]
        full = off[:-1] < off[1:]
        after[off[1:][full] - 1] = True
        cut = white & ~before  # a run begins
        cut |= white & ~after  # the last of a run that a word follows
        cut[1:] |= ~white[1:] & line[:-1]
        cut[1:] |= _PUNCT[buf[1:]] & _LETTER[buf[:-1]]
        cut[off[:-1][full]] = True
        return np.flatnonzero(cut)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> Encoded:
        odd = self._odd(buf, off) if self.cuts else np.flatnonzero(off[:-1] < off[1:])
        if odd.size:
            return self._mixed(buf, off, set(odd.tolist()))
        if not buf.size:
            none = np.zeros(0, dtype=np.int64)
            return Encoded(np.zeros(0, np.uint32), np.zeros(off.size, np.int64), none, none)
        start = self._cut(buf, off)
        end = np.append(start[1:], buf.size)
        key = span_hashes(buf, start, end)
        slot = self._find(key)
        missing = np.flatnonzero(slot < 0)
        if missing.size:
            new, first = np.unique(key[missing], return_index=True)
            if self.at.size + new.size > CACHE_UNITS or self.text.size > CACHE_BYTES:
                self._clear()
                missing = np.arange(key.size)
                new, first = np.unique(key, return_index=True)
            if new.size > CACHE_UNITS:  # more different units than the cache holds: one by one they would gain nothing
                return self._mixed(buf, off, set(range(off.size - 1)))
            raw, pick = buf.tobytes(), missing[first]
            self._learn(new, [raw[a:b] for a, b in zip(start[pick].tolist(), end[pick].tolist(), strict=True)])
            slot[missing] = self._find(key[missing])
        bad = self._differ(buf, start, end, slot)
        if bad.any():
            return self._mixed(buf, off, set((np.searchsorted(off, start[bad], side="right") - 1).tolist()))
        count = self.count[slot]
        total = np.concatenate([[0], np.cumsum(count)])
        take = np.repeat(self.at[slot] - total[:-1], count) + np.arange(total[-1])
        first = total[np.searchsorted(start, off)]
        if not self.offsets:
            return Encoded(self.ids[take], first)
        chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # characters before each byte
        owner = np.searchsorted(off, start, side="right") - 1
        base = np.repeat(chars[start] - chars[off[owner]], count)
        return Encoded(self.ids[take], first, base + self.spans[take, 0], base + self.spans[take, 1])

    def _mixed(self, buf: np.ndarray, off: np.ndarray, odd: set[int]) -> Encoded:
        parts = []
        for d in range(off.size - 1):
            piece = buf[off[d] : off[d + 1]]
            if d in odd:
                ids, _, spans = self._encode([piece.tobytes().decode()])
                parts.append(Encoded(ids, np.array([0, ids.size]), spans[:, 0].astype(np.int64), spans[:, 1].astype(np.int64)))
            else:
                parts.append(self.encode(piece, np.array([0, piece.size])))
        first = np.concatenate([[0], np.cumsum([p.ids.size for p in parts])])
        out = Encoded(np.concatenate([p.ids for p in parts]), first)
        if self.offsets:
            out.starts, out.ends = np.concatenate([p.starts for p in parts]), np.concatenate([p.ends for p in parts])
        return out


_encoders: dict[tuple[str, bool], UnitEncoder] = {}
HELD.append(_encoders.clear)


def encoder(path: str, offsets: bool = False) -> UnitEncoder:
    """This process's encoder for a tokenizer file; its cache lasts until the worker gets another kind of task."""
    if (path, offsets) not in _encoders:
        _encoders[path, offsets] = UnitEncoder(path, offsets)
    return _encoders[path, offsets]
