"""Toxicity score by a counterfactual-regularised logistic classifier over the words of a text.

The classifier is fitted on a bounded sample of labelled documents. Where one names a group of
people, a copy of its text with each group's name swapped for another's is made and its features are
extracted again, words' beginnings included. The fit penalises the squared difference of the two
logits, so that naming a group does not by itself raise the score.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.llm.quality import sample_rows
from quillspark.llm.scratch import unused
from quillspark.llm.textarrays import chunks, mix, span_hashes, tidy

LOG2_DIM = 18
#: Labelled rows that are fitted at most, the first by a hash of doc_id.
SAMPLE = 8000
#: Steps of the fit that selects words, and of the one that weighs the selected.
SELECT_STEPS, STEPS = 150, 300
#: The selection's L1 penalty, times the root of 1 / (documents of the rarer label).
SPARSITY = 0.15
RIDGE = 1e-4
COUNTERFACTUAL = 5.0
#: Bytes of the word beginnings that count besides whole words.
PREFIXES = (4, 5, 6, 7, 8)
#: Features in fewer sampled documents than this carry no weight.
LEAST_DOCS = 4

# Names of groups of people that are exchanged for one another, by language.
IDENTITY_GROUPS = [
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["woman", "man"],
    ["women", "men"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["immigrant", "native", "refugee", "foreigner"],
    ["deaf", "blind", "disabled"],
    ["chrétien", "musulman", "juif", "athée"],
    ["femme", "homme"],
    ["christ", "moslem", "jude", "atheist"],
    ["frau", "mann"],
    ["cristiano", "musulmán", "judío", "ateo"],
    ["mujer", "hombre"],
]

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _feature(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([raw.size]), lower=True)[0] >> np.uint64(64 - LOG2_DIM))


def swaps() -> dict[int, int]:
    """Each identity term's feature and that of the next term of its group."""
    return {_feature(a): _feature(b) for g in IDENTITY_GROUPS for a, b in zip(g, g[1:] + g[:1], strict=True)}


def exchanges() -> dict[int, list[tuple[int, int]]]:
    """For each identity term's feature, what a swap changes: (feature, +1 or -1), words' beginnings too."""

    def features(word: str) -> set[int]:
        raw = np.frombuffer(word.encode(), np.uint8)
        return set(word_features(raw, np.array([0, raw.size]))[1].tolist())

    out = {}
    for g in IDENTITY_GROUPS:
        for a, b in zip(g, g[1:] + g[:1], strict=True):
            old, new = features(a), features(b)
            out[_feature(a)] = [(f, 1) for f in sorted(new - old)] + [(f, -1) for f in sorted(old - new)]
    return out


@functools.cache
def _terms() -> tuple[re.Pattern, dict[bytes, bytes], np.ndarray]:
    """A pattern of identity terms as whole words, each term's substitute, and the terms' features."""
    other = {a.encode(): b.encode() for g in IDENTITY_GROUPS for a, b in zip(g, g[1:] + g[:1], strict=True)}
    solid = rb"[0-9A-Za-z\x80-\xff]"
    found = b"|".join(re.escape(t) for t in sorted(other, key=len, reverse=True))
    return re.compile(rb"(?<!" + solid + rb")(?:" + found + rb")(?!" + solid + rb")", re.IGNORECASE), other, np.array(sorted(swaps()), dtype=np.int64)


def swapped_text(raw: bytes) -> bytes:
    """The text with each identity term replaced by the next one of its group."""
    pattern, other, _ = _terms()
    return pattern.sub(lambda m: other[m[0].lower()], raw)


def swap_features(raw: bytes, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features that the swapped text gains and those that it loses against ``own``, the text's."""
    none = np.zeros(0, dtype=np.int64)
    if not np.isin(own, _terms()[2]).any():
        return none, none
    text = np.frombuffer(swapped_text(raw), np.uint8)
    new = word_features(text, np.array([0, text.size]))[1]
    return np.setdiff1d(new, own), np.setdiff1d(own, new)


def word_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features (words and longer words' beginnings) of each document: (document, feature), sorted by document."""
    solid = _WORD[buf]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = off[:-1] < off[1:]
    start[off[:-1][full]], end[off[1:][full] - 1] = solid[off[:-1][full]], solid[off[1:][full] - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = (np.searchsorted(off, s, side="right") - 1).astype(np.uint64) << np.uint64(LOG2_DIM)
    top = np.uint64(64 - LOG2_DIM)
    parts = [doc | (span_hashes(buf, s, e, lower=True) >> top)]
    for n in PREFIXES:
        long = np.flatnonzero(e - s > n)
        parts.append(doc[long] | (mix(span_hashes(buf, s[long], s[long] + n, lower=True)) >> top))
    packed = np.sort(np.concatenate(parts))
    if packed.size:
        packed = packed[np.append(True, packed[1:] != packed[:-1])]
    return (packed >> np.uint64(LOG2_DIM)).astype(np.int64), (packed & np.uint64((1 << LOG2_DIM) - 1)).astype(np.int64)


def _exchanged(rows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The features gained and lost by each row, of which only the features are known."""
    other = exchanges()
    terms = np.array(sorted(other), dtype=np.int64)
    out = []
    for r in rows:
        moves = [m for t in r[np.isin(r, terms)] for m in other[int(t)]]
        out.append(tuple(np.array([f for f, sign in moves if sign == s], dtype=np.int64) for s in (1, -1)))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The features of each row, as views of one buffer."""
    if not len(column):
        return []
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 4
    data = np.frombuffer(data, "<u4") if data and data.size >= 4 else np.zeros(0, np.uint32)
    return [data[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]


class _Counts:
    """The 0/1 matrix of rows and the kept features, by row and by feature, in 8 bytes an entry."""

    def __init__(self, rows: list[np.ndarray], kept: np.ndarray):
        self.n, self.dim = len(rows), kept.size
        rows = [r[kept[r]].astype(np.int32) for r in rows]
        size = np.array([r.size for r in rows], dtype=np.int64)
        self.feature = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.filled = np.flatnonzero(size)
        self.begin = (np.cumsum(size) - size)[self.filled]
        order = np.argsort(self.feature, kind="stable")
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), size)[order]
        used = np.bincount(self.feature, minlength=self.dim) if self.feature.size else np.zeros(self.dim, np.int64)
        self.used = np.flatnonzero(used)
        self.first = (np.cumsum(used) - used)[self.used]

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if self.filled.size:
            out[self.filled] = np.add.reduceat(w[self.feature], self.begin)
        return out

    def back(self, e: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dim)
        if self.used.size:
            out[self.used] = np.add.reduceat(e[self.row], self.first)
        return out


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int = SAMPLE) -> ToxicityModel:
        packed = lambda f: f.astype("<u4").tobytes()

        @tidy
        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, buf, off in chunks(batch.column(1)):
                    doc, f = word_features(buf, off)
                    at = np.searchsorted(doc, np.arange(b - a + 1))
                    own = [f[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                    swapped = [swap_features(buf[x:y].tobytes(), f) for x, y, f in zip(off[:-1], off[1:], own, strict=True)]
                    columns = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a)]
                    columns += [pa.array([packed(f) for f in g], pa.binary()) for g in (own, [g for g, _ in swapped], [x for _, x in swapped])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "y", "f", "gained", "lost"])

        sample = sample_rows(docs, labels, label, allowed, limit).select("doc_id", "text", "y")
        got = sample.mapInArrow(features, "doc_id long, y int, f binary, gained binary, lost binary").toArrow().sort_by("doc_id").combine_chunks()
        own, gained, lost = (_lists(got.column(c)) for c in ("f", "gained", "lost"))
        return cls.train(own, got.column("y").to_numpy().astype(np.float64), swapped=list(zip(gained, lost, strict=True)))

    @classmethod
    def train(
        cls,
        rows: list[np.ndarray],
        y: np.ndarray,
        counterfactual: float = COUNTERFACTUAL,
        least: int = LEAST_DOCS,
        swapped: list[tuple[np.ndarray, np.ndarray]] | None = None,
    ) -> ToxicityModel:
        """Accelerated proximal descent: an L1 fit selects words, a ridge fit weighs them.

        Both hold the counterfactual penalty: ``swapped`` has the features that each row's swapped text
        gains and loses; where only features are known, those of the terms in the row are exchanged.
        Without rows of both labels the mean label is all there is to score by.
        """
        if swapped is None:
            swapped = _exchanged(rows)
        dim = 1 << LOG2_DIM
        mean = float(y.mean()) if y.size else 0.0
        if not 0 < mean < 1:
            return cls(np.zeros(dim, np.float32), float(np.log((mean + 1e-3) / (1 - mean + 1e-3))))
        kept = np.zeros(dim, dtype=np.int64)
        for r in rows:
            kept[r] += 1
        kept = kept >= least
        balance = np.where(y > 0, 0.5 / mean, 0.5 / (1 - mean)) / y.size
        penalty = SPARSITY / np.sqrt(min(y.sum(), (1 - y).sum()))
        w, _ = cls._descend(rows, swapped, y, balance, kept, penalty, 0.0, counterfactual, SELECT_STEPS)
        w, b = cls._descend(rows, swapped, y, balance, w != 0, 0.0, RIDGE, counterfactual, STEPS)
        return cls(w.astype(np.float32), b)

    @staticmethod
    def _descend(
        rows: list[np.ndarray],
        swapped: list[tuple[np.ndarray, np.ndarray]],
        y: np.ndarray,
        balance: np.ndarray,
        kept: np.ndarray,
        lasso: float,
        ridge: float,
        counterfactual: float,
        steps: int,
    ) -> tuple[np.ndarray, float]:
        dim = kept.size
        # the change that swapping makes to the logit: +w of the features gained, -w of those lost
        named = [(i, f, sign) for i, both in enumerate(swapped) for part, sign in zip(both, (1, -1), strict=True) for f in part if kept[f]]
        doc, moved, sign = (np.array([x[k] for x in named], dtype=np.int64) for k in range(3))
        x = _Counts(rows, kept)

        def pull(w: np.ndarray) -> np.ndarray:
            change = np.bincount(doc, weights=sign * w[moved], minlength=y.size)
            return np.bincount(moved, weights=sign * change[doc], minlength=dim)

        def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
            err = (_sigmoid(x.times(w) + b) - y) * balance
            g = x.back(err) + ridge * w
            if named:
                g += counterfactual / y.size * pull(w)
            return g, float(err.sum())

        v, top = np.full(dim, 1.0) * kept, 1.0  # largest curvature by power iteration
        for _ in range(12):
            v = v / max(np.linalg.norm(v), 1e-12)
            v = x.back((x.times(v) + 0.1) * balance)
            top = max(float(np.linalg.norm(v)), 1e-6)
        steep = 0.0  # the same of the penalty
        if named:
            v = np.random.default_rng(0).standard_normal(dim) * kept
            for _ in range(12):
                v = pull(v / max(np.linalg.norm(v), 1e-12))
                steep = float(np.linalg.norm(v))
        step = 1.0 / (0.3 * top + ridge + 2 * counterfactual * steep / y.size + 0.25)
        w, b, zw, zb, t = np.zeros(dim), 0.0, np.zeros(dim), 0.0, 1.0
        for _ in range(steps):
            g, gb = gradient(zw, zb)
            nw, nb = zw - step * g, zb - step * gb
            nw = np.sign(nw) * np.maximum(np.abs(nw) - step * lasso, 0)
            nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
            zw, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
            w, b, t = nw, nb, nt
        return w * kept, b

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        doc, f = word_features(buf, off)
        return _sigmoid(np.bincount(doc, weights=self.weights[f], minlength=off.size - 1) + self.bias)


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    columns: list[str] | None = None,
    text: str = "text",
    keep_text: str | None = None,
    score: str = "score",
) -> DataFrame:
    """The given columns (none: doc_id) and ``score`` of every row, in its own partition.

    Null and empty texts have no words and get the score of the bias. Rows that repeat a doc_id each
    get a score; a text of any length is one row. ``score`` may take a name that no column has. The
    model is 1 MB.
    """
    columns = columns or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in columns])
    read = kept if keep_text in columns else docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text).alias(unused(columns, "text")[0]))
    at = columns.index(keep_text) if keep_text in columns else len(columns)
    schema = StructType([*kept.schema.fields, StructField(score, DoubleType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(buf, off) for _, _, buf, off in chunks(batch.column(at))]
            out = [batch.column(i) for i in range(len(columns))] + [pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, score])

    return read.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows that score under the threshold, with the columns of ``docs``, whatever their names."""
    (score,) = unused(docs.columns, "score")
    scored = score_toxicity(docs, model, docs.columns, keep_text="text", score=score)
    return scored.where(F.col(score) < threshold).drop(score)
