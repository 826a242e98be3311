"""Token counts by section, by offset-mapped attribution.

A whole document is encoded once. Its sections are its lines (a line break belongs to the line it
ends), and each token's character span is joined to the sections' intervals. A token that crosses a
boundary goes to the section that holds most of its characters, the earlier one on a tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.textarrays import chunks, holding
from quillspark.llm.token_units import encoder


def line_sections(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character starts of the lines within their documents, and each document's first line.

    An empty document has one empty section; a final line break starts no further one.
    """
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    after = np.flatnonzero(buf == 10) + 1
    after = after[~np.isin(after, off)]
    at = np.sort(np.concatenate([off[:-1], after]))
    first = np.searchsorted(at, off)
    empty = np.flatnonzero(off[:-1] == off[1:])
    first[:-1] = np.searchsorted(at, off[:-1], side="left")
    if empty.size:  # repeated starts of empty documents keep their order
        owner = np.sort(np.concatenate([np.arange(off.size - 1), np.searchsorted(off, after, side="right") - 1]))
        first = np.searchsorted(owner, np.arange(off.size))
        return chars[at] - chars[off[owner]], first
    owner = np.searchsorted(off, at, side="right") - 1
    return chars[at] - chars[off[owner]], first


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The section of each token: ``bounds`` are the sections' ascending starts in the same coordinates.

    Interval join by binary search; a token over several sections goes to the one with most of its
    characters, ties to the earliest. A token without characters goes where it stands.
    """
    low = np.maximum(np.searchsorted(bounds, starts, side="right") - 1, 0)
    high = np.maximum(np.searchsorted(bounds, np.maximum(ends - 1, starts), side="right") - 1, 0)
    for t in np.flatnonzero(low != high):
        cut = np.concatenate([[starts[t]], bounds[low[t] + 1 : high[t] + 1], [ends[t]]])
        low[t] += int(np.argmax(np.diff(cut)))
    return low


def token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sections: Callable = line_sections) -> DataFrame:
    """Per document and section: doc_id, section (from 0), first_char, n_chars, n_tokens.

    Null texts count as empty; a document without tokens has its one section with 0. Rows that repeat
    a doc_id each give their own sections. Other columns are not read. No row leaves its partition.
    """

    @holding
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, True)
        for batch in batches:
            for a, b, buf, off in chunks(batch.column(1), 1 << 21):
                got = enc.encode(buf, off)
                starts, first = sections(buf, off)
                length = np.array([((buf[x:y] & 0xC0) != 0x80).sum() for x, y in zip(off[:-1], off[1:], strict=True)], dtype=np.int64)
                base = np.cumsum(length + 1) - (length + 1)  # one axis for the chunk, with a gap after each document
                owner = np.repeat(np.arange(b - a), np.diff(first))
                own = np.repeat(np.arange(b - a), np.diff(got.first))
                n = np.bincount(attribute(got.starts + base[own], got.ends + base[own], starts + base[owner]), minlength=starts.size)
                stop = np.append(starts[1:], 0)
                stop[first[1:] - 1] = length
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(a, b - a).take(pa.array(owner)),
                        "section": pa.array((np.arange(starts.size) - first[owner]).astype(np.int32)),
                        "first_char": pa.array(starts.astype(np.int64)),
                        "n_chars": pa.array((stop - starts).astype(np.int64)),
                        "n_tokens": pa.array(n.astype(np.int64)),
                    }
                )

    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).mapInArrow(run, "doc_id long, section int, first_char long, n_chars long, n_tokens long")
