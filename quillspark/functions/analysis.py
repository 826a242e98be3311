"""Text analysis: word segmentation, normalisation, stop words and stems, as columns and for query strings."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.stem import stem

# The stop words of both languages.
STOP_RU = "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по ее от о из это для при или".split()
STOP_EN = "a an the and or but if of at by for with about to from in on is are was were be been it its this that these those as not no".split()
STOP_WORDS = frozenset(STOP_RU + STOP_EN)

_HAN = r"[\p{IsHan}\p{IsHiragana}]"
_MID_LETTER = "['‘’.․﹒＇．:··‧״]"
_MID_NUMBER = "['‘’.․﹒＇．,;;٬⁄，；]"
_WORD = r"[\p{L}\p{M}\p{Nd}_&&[^\p{IsHan}\p{IsHiragana}]]"
_CORE = r"[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}]]"
#: Unicode words: runs of letters, marks and digits, with single separators inside words or numbers; each ideograph alone.
WORD_PATTERN = rf"{_HAN}|{_WORD}*{_CORE}{_WORD}*(?:(?:(?<=[\p{{L}}\p{{M}}]){_MID_LETTER}(?=\p{{L}})|(?<=\p{{Nd}}){_MID_NUMBER}(?=\p{{Nd}})){_WORD}+)*"
_PY_WORD = regex.compile(WORD_PATTERN.replace("IsHan", "Han").replace("IsHiragana", "Hiragana"), regex.V1)


def unicode_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def normalize(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


def words(text: Column) -> Column:
    """Normalised words in order, without stop words. A text is normalised as a whole, which leaves its word bounds where they are."""
    return F.filter(unicode_words(normalize(text)), lambda w: ~w.isin(*sorted(STOP_WORDS)))


@lru_cache(maxsize=1 << 16)
def _stem_kept(word: str) -> str:
    return stem(word)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_all(lists: pa.Array) -> pa.Array:
    """Stems of arrays of words: a batch's words are coded as they lie in Arrow, and each distinct one is stemmed once."""
    coded = lists.flatten().dictionary_encode()
    stems = pa.array(map(_stem_kept, coded.dictionary.to_pylist()), pa.string())
    ends = lists.offsets
    offsets = pc.subtract(ends, ends[0])
    return pa.ListArray.from_arrays(offsets, stems.take(coded.indices))


def analyze(text: Column, stemmed: bool = True) -> Column:
    return stem_all(words(text)) if stemmed else words(text)


def word_count(text: Column) -> Column:
    """Words of a text, stop words included."""
    return F.size(unicode_words(text))


# the same for query strings, on the driver


def text_words(text: str) -> list[tuple[int, str]]:
    """(offset, word) of a Python string."""
    return [(m.start(), m.group()) for m in _PY_WORD.finditer(text)]


def normalize_text(word: str) -> str:
    return word.lower().replace("ё", "е")


def analyze_text(text: str, stemmed: bool = True) -> list[str]:
    found = [normalize_text(w) for _, w in text_words(text)]
    return [stem(w) if stemmed else w for w in found if w not in STOP_WORDS]
