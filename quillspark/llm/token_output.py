"""Token-ID output in patched frame-of-reference segments.

A segment is one binary image: a header, a document index, a block index and the blocks. A block of
256 ids holds its minimum, the differences from it packed at the width of their 90th percentile, and
an exception list (position, high bits) for the few that need more. Blocks start at offsets listed in
the block index, so any block is read by itself. A ``.pfor`` file is a few segments, each with a line
feed behind it: executors write the files through Spark's committer, on whatever file system the shared
folder is, so retried tasks leave no half files, and they are read back as binary files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.scratch import Scratch
from quillspark.llm.textarrays import chunks, holding, tidy
from quillspark.llm.token_units import encoder

MAGIC = b"QPFOR2\0\0"
BLOCK = 256
PERCENTILE = 90
#: Documents' ids held for one segment before it is closed (a longer document has one of its own).
SEGMENT_IDS = 1 << 21
_HEAD = struct.Struct("<8sIIQQQQQ")  # magic, part, segment of the part, ids before it in the part, documents, ids, blocks, bytes
#: Segments of a file, about 8 MB.
FILE_SEGMENTS = 2
#: Blocks that are packed or unpacked at a time, so that a worker never holds several arrays of a whole segment.
PACK_BLOCKS = 512
#: Bytes of text that are encoded at a time.
CHUNK = 1 << 20


def _widths(x: np.ndarray) -> np.ndarray:
    """Bit lengths of uint32 values."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def pack_rows(rows: np.ndarray, width: int) -> np.ndarray:
    """Each row of BLOCK values under 2**width as BLOCK*width bits in uint64 words."""
    out = np.zeros((rows.shape[0], BLOCK * width // 64), dtype=np.uint64, order="F")
    cols = np.asfortranarray(rows.astype(np.uint64))
    for j in range(BLOCK):
        word, shift = divmod(j * width, 64)
        out[:, word] |= cols[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= cols[:, j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out)


def unpack_rows(packed: np.ndarray, width: int) -> np.ndarray:
    cols, out = np.asfortranarray(packed), np.zeros((packed.shape[0], BLOCK), dtype=np.uint64, order="F")
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        v = cols[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v |= cols[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = v & mask
    return out


def _pack_blocks(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each block of a grid of ids, and the blocks one after the other."""
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    k = BLOCK * PERCENTILE // 100
    width = _widths(np.partition(rest, k, axis=1)[:, k])
    over = rest >> width[:, None].astype(np.uint32)
    where, place = np.nonzero(over)
    exceptions = np.bincount(where, minlength=low.size).astype(np.uint16)
    high = over[where, place].astype(np.uint32)
    rest = rest & ((np.uint64(1) << width[:, None].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    # a block: minimum u32, width u8, pad u8, exceptions u16, packed words, positions u8, high bits u32
    sizes = 8 + BLOCK // 8 * width.astype(np.int64) + 5 * exceptions.astype(np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    body = np.zeros(int(start[-1]), dtype=np.uint8)
    fixed = np.zeros((low.size, 8), dtype=np.uint8)
    fixed[:, :4], fixed[:, 4], fixed[:, 6:] = low.astype("<u4").view(
        np.uint8
    ).reshape(-1, 4), width, exceptions.astype("<u2").view(np.uint8).reshape(-1, 2)
    body[start[:-1, None] + np.arange(8)] = fixed
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            body[start[own][:, None] + 8 + np.arange(BLOCK // 8 * int(w))] = (
                pack_rows(rest[own], int(w))
                .astype("<u8")
                .view(np.uint8)
                .reshape(own.size, -1)
            )
    nth = np.arange(where.size) - (np.cumsum(exceptions, dtype=np.int64) - exceptions)[where]
    at = start[where] + 8 + BLOCK // 8 * width[where].astype(np.int64)
    body[at + nth] = place
    body[(at + exceptions[where] + 4 * nth)[:, None] + np.arange(4)] = high.astype("<u4").view(np.uint8).reshape(-1, 4)
    return sizes, body


def write_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, before: int = 0, part: int = 0, seq: int = 0) -> bytes:
    """The binary image of some documents' ids (uint32), in order; ``before``: ids of the part ahead of it."""
    blocks = -(-ids.size // BLOCK)
    sizes, bodies = [np.zeros(1, np.int64)], []
    for k in range(0, blocks, PACK_BLOCKS):
        own = ids[k * BLOCK : (k + PACK_BLOCKS) * BLOCK]
        grid = np.full(-(-own.size // BLOCK) * BLOCK, ids[-1], dtype=np.uint32)
        grid[: own.size] = own
        size, body = _pack_blocks(grid.reshape(-1, BLOCK))
        sizes.append(size)
        bodies.append(body)
    start = np.cumsum(np.concatenate(sizes))
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([d or 0 for d in doc_ids], dtype="<i8")
    fixed = [names.tobytes(), known.tobytes(), counts.astype("<u8").tobytes(), start.astype("<u8").tobytes()]
    total = _HEAD.size + sum(map(len, fixed)) + int(start[-1])
    return b"".join([_HEAD.pack(MAGIC, part, seq, before, len(doc_ids), ids.size, blocks, total), *fixed, *bodies])


def split_file(data: bytes) -> Iterator[memoryview]:
    """The segments of a file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        size = _head(view[at:])[-1]
        if size < _HEAD.size or data[at + size : at + size + 1] != b"\n":
            raise ValueError("a token file is cut off")
        yield view[at : at + size]
        at += size + 1


def _head(image: bytes) -> tuple[int, ...]:
    magic, *rest = _HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    return tuple(rest)


def read_segment(image: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(ids before, doc ids, ids per document, all ids) of a segment."""
    _, _, before, docs, total, blocks, _ = _head(image)
    at = _HEAD.size
    names = np.frombuffer(image, "<i8", docs, at)
    known = np.frombuffer(image, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(image, "<u8", docs, at + 9 * docs).astype(np.int64)
    start = np.frombuffer(image, "<u8", blocks + 1, at + 17 * docs).astype(np.int64)
    ids = np.empty(blocks * BLOCK, dtype=np.uint32)
    for k in range(0, blocks, PACK_BLOCKS):
        ids[k * BLOCK : (k + PACK_BLOCKS) * BLOCK] = _blocks(image, at + 17 * docs + 8 * (blocks + 1), start[k : k + PACK_BLOCKS + 1])
    return before, [
        int(d) if k else None
        for d, k in zip(names, known, strict=True)
    ], counts, ids[:total]


def read_block(image: bytes, block: int) -> np.ndarray:
    """The 256 ids of one block (the last is padded), found through the block index."""
    _, _, _, docs, _, blocks, _ = _head(image)
    at = _HEAD.size + 17 * docs
    start = np.frombuffer(image, "<u8", blocks + 1, at).astype(np.int64)
    return _blocks(image, at + 8 * (blocks + 1), start[block : block + 2])


def _blocks(image: bytes, base: int, start: np.ndarray) -> np.ndarray:
    n = start.size - 1
    body = np.frombuffer(image, np.uint8)[base:]
    if not n:
        return np.zeros(0, np.uint32)
    fixed = body[start[:-1, None] + np.arange(8)]
    low, width = fixed[:, :4].copy().view("<u4")[:, 0], fixed[:, 4].astype(np.int64)
    exceptions = fixed[:, 6:].copy().view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((n, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            words = body[start[own][:, None] + 8 + np.arange(BLOCK // 8 * int(w))].view("<u8").astype(np.uint64)
            out[own] = unpack_rows(words, int(w))
    where = np.repeat(np.arange(n), exceptions)
    nth = np.arange(where.size) - (np.cumsum(exceptions) - exceptions)[where]
    at = start[where] + 8 + BLOCK // 8 * width[where]
    high = body[(at + exceptions[where] + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0] if where.size else np.zeros(0, np.uint32)
    out[where, body[at + nth]] |= high << width[where].astype(np.uint32)
    return (out + low[:, None]).reshape(-1)


def write_tokens(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`write_files`, and the segments read back from them."""
    return read_tokens(docs.sparkSession, write_files(docs, scratch, tokenizer, end_id, doc_id, text))


def write_files(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> str | None:
    """Encodes whole texts into ``.pfor`` files in ascending ``doc_id`` order; returns their folder, none without documents.

    A null text is empty and still gets ``end_id``; a null doc_id comes first; rows that repeat a
    doc_id each stay, in order of their text; other columns are not read. An empty table gives none.
    """

    @holding
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        names, counts, pieces, held, before, seq = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal names, counts, pieces, held, before, seq
            ids, pieces = np.concatenate(pieces), []
            image = write_segment(names, np.concatenate(counts), ids, before, part, seq)
            before, seq = before + ids.size, seq + 1
            names, counts, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([image], pa.binary())], names=["image"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, buf, off in chunks(batch.column(1), CHUNK):
                got = enc.encode(buf, off)
                ends = got.first[1:]
                pieces.append(np.insert(got.ids, ends, np.uint32(end_id)))
                counts.append(np.diff(got.first) + 1)
                names += keys[a:b]
                held += pieces[-1].size
                if held >= SEGMENT_IDS:
                    yield close()
        if names:
            yield close()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
        .repartitionByRange(n, "d")
        .sortWithinPartitions("d", "t")
    )
    images = ordered.mapInArrow(encode, "image binary")
    # a cast from binary keeps the bytes, and the text writer puts them down as they are, a line feed after each
    (
        images.select(F.col("image").cast("string"))
        .write.option("maxRecordsPerFile", FILE_SEGMENTS)
        .option("compression", "none")
        .text(scratch.path("written"))
    )
    for k, name in enumerate(x for x in scratch.names("written") if x.startswith("part-")):
        scratch.move(f"written/{name}", f"tokens/{k:06d}.pfor")
    return scratch.path("tokens") if scratch.names("tokens") else None


#: ``part`` (ascending doc_id ranges), ``seq`` in the part, documents, ids and the segment itself.
SEGMENT = "part int, seq int, n_docs long, n_tokens long, image binary"


def read_tokens(spark: SparkSession, folder: str | None) -> DataFrame:
    """The segments of all ``.pfor`` files of a folder."""
    if folder is None:
        return spark.createDataFrame([], SEGMENT)

    @tidy
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for image in split_file(content.as_py()):
                    part, seq, _, docs, ids, _, _ = _head(image)
                    columns = [
                        pa.array([part], pa.int32()),
                        pa.array([seq], pa.int32()),
                        pa.array([docs], pa.int64()),
                        pa.array([ids], pa.int64()),
                        pa.array([bytes(image)], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "n_docs", "n_tokens", "image"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("content").mapInArrow(parse, SEGMENT)


DIGEST = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _digest(image: bytes) -> pa.RecordBatch:
    part = _head(image)[0]
    before, names, counts, ids = read_segment(image)
    first = np.concatenate([[0], np.cumsum(counts)])
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    columns = [
        pa.array(np.full(counts.size, part, np.int32)),
        pa.array(names, pa.int64()),
        pa.array(before + first[:-1]),
        pa.array(counts),
        pa.array(crc, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(segments: DataFrame) -> DataFrame:
    """Per document doc_id, start, n_tokens and the crc32 of its ids as little-endian uint32, from segments."""

    @tidy
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in batch.column(0):
                yield _digest(image.as_py())

    return _placed(segments.select("image").mapInArrow(decode, DIGEST))


def file_digests(spark: SparkSession, folder: str | None) -> DataFrame:
    """:func:`token_digests` of all ``.pfor`` files of a folder, which are read once."""
    if folder is None:
        return token_digests(read_tokens(spark, None))

    @tidy
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for image in split_file(content.as_py()):
                    yield _digest(image)

    return _placed(spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("content").mapInArrow(decode, DIGEST))


def _placed(digests: DataFrame) -> DataFrame:
    """Starts counted over all parts. Digests, some 30 bytes a document, are written, and only the id
    total of each part comes to the driver: as many rows as the writer had partitions.
    """
    spark = digests.sparkSession
    rows = Scratch(spark, "digests").save(digests, "rows")
    base, at = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        base.append((part, at))
        at += n
    base = spark.createDataFrame(base, "part int, base long")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
