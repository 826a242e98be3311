"""Snippets and highlighting of result rows."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.analysis import analyze_text, normalize_text, text_words

SNIPPET_WORDS = 30
SEGMENTS = "array<struct<text:string,hl:boolean>>"
_ARROW = pa.list_(pa.struct([("text", pa.string()), ("hl", pa.bool_())]))
#: No word and no separator within a word is white space, so words can be looked for between it.
_BETWEEN_SPACE = re.compile(r"\S+")
#: Stretches between white space whose hits are kept, and the longest of them in characters.
KEPT, KEPT_CHARS = 1 << 16, 64


def _merge(pieces: list[tuple[str, bool]]) -> list[dict]:
    out: list[dict] = []
    for text, hl in pieces:
        if text and out and out[-1]["hl"] == hl:
            out[-1]["text"] += text
        elif text:
            out.append({"text": text, "hl": hl})
    return out


def _segments(text: str, spans: list[tuple[int, int]], begin: int, stop: int) -> list[dict]:
    pieces, at = [], begin
    for start, end in spans:
        pieces += [(text[at:start], False), (text[start:end], True)]
        at = end
    return _merge([*pieces, (text[at:stop], False)])


def _is_hit(word: str, terms: frozenset[str], stemmed: bool) -> bool:
    return any(t in terms for t in analyze_text(word, stemmed))


class Marker:
    """Finds the words of texts that are among terms; what it has found in short stretches between white space is kept."""

    def __init__(self, terms: frozenset[str], stemmed: bool):
        self.terms, self.stemmed = terms, stemmed
        self.known: dict[str, tuple[tuple[int, int], ...]] = {}

    def _found(self, stretch: str) -> tuple[tuple[int, int], ...]:
        # a term must stand in the stretch as it is; only a final sigma depends on what is around it
        if not self.stemmed and "Σ" not in stretch and not any(map(normalize_text(stretch).__contains__, self.terms)):
            got = ()
        else:
            got = self._hits(stretch)
        if len(stretch) <= KEPT_CHARS:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[stretch] = got
        return got

    def _hits(self, stretch: str) -> tuple[tuple[int, int], ...]:
        return tuple((at, at + len(w)) for at, w in text_words(stretch) if _is_hit(w, self.terms, self.stemmed))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of every hit."""
        out, known = [], self.known
        for m in _BETWEEN_SPACE.finditer(text):
            stretch = m.group()
            got = known.get(stretch)
            if got is None:
                got = self._found(stretch)
            if got:
                at = m.start()
                out += [(at + a, at + b) for a, b in got]
        return out


@lru_cache(maxsize=1)
def _marker(terms: frozenset[str], stemmed: bool) -> Marker:
    """A worker's, for all batches of a query."""
    return Marker(terms, stemmed)


def snippet(body: str, terms: set[str], stemmed: bool = True) -> list[dict]:
    """Thirty words around the first hit, or the first thirty."""
    found = text_words(body)
    if not found:
        return []
    wanted = frozenset(terms)
    hits = [_is_hit(w, wanted, stemmed) for _, w in found]
    first = hits.index(True) if True in hits else 0
    end = min(max(first - SNIPPET_WORDS // 2, 0) + SNIPPET_WORDS, len(found))
    start = max(end - SNIPPET_WORDS, 0)
    window = [(at, at + len(w)) for at, w in found[start:end]]
    marked = [x for x, hit in zip(window, hits[start:end], strict=True) if hit]
    return _segments(body, marked, window[0][0], window[-1][1])


def highlight(text: str, terms: set[str], stemmed: bool = True) -> list[dict]:
    return _segments(text, Marker(frozenset(terms), stemmed).spans(text), 0, len(text))


def _highlighted(texts: pa.Array, terms: frozenset[str], stemmed: bool) -> pa.Array:
    """:func:`highlight` of a batch."""
    marker = _marker(terms, stemmed)
    parts, flags, ends = [], [], [0]
    for scalar in texts:
        text = scalar.as_py() or ""
        for s in _segments(text, marker.spans(text), 0, len(text)):
            parts.append(s["text"])
            flags.append(s["hl"])
        ends.append(len(parts))
    items = pa.StructArray.from_arrays([pa.array(parts, pa.string()), pa.array(flags, pa.bool_())], fields=list(_ARROW.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, type=_ARROW)


def snippet_udf(terms: list[str], stemmed: bool = True):
    wanted = set(terms)
    return F.pandas_udf(lambda s: pd.Series([snippet(x or "", wanted, stemmed) for x in s]), SEGMENTS)


def with_highlight(docs: DataFrame, hl: str, column: str = "body", stemmed: bool = True) -> DataFrame:
    """Adds ``highlight`` and ``matches`` for terms separated by white space; none if there are none."""
    terms = frozenset(hl.split())
    if not terms:
        return docs

    def run(texts: pa.Array) -> pa.Array:
        return _highlighted(texts, terms, stemmed)

    mark = F.arrow_udf(run, SEGMENTS)
    out = docs.withColumn("highlight", mark(F.col(column)))
    return out.withColumn("matches", F.size(F.filter("highlight", lambda s: s["hl"])))


def plain(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")
