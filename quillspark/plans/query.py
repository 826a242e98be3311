"""Query strings to a plan of terms, phrases and variants, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache

from quillspark.functions.analysis import STOP_WORDS, analyze_text, normalize_text, text_words
from quillspark.functions.stem import stem

# Quotes that switch phrases on and off.
_QUOTES = re.compile("[\"“”„«»]")
MAX_WINDOW = 1000
VARIANT_WEIGHT = 0.5

# Groups of synonyms.
SYNONYM_GROUPS = [
    ["хлеб", "батон", "буханка", "булка"],
    ["bread", "loaf"],
    ["закваска", "опара"],
    ["sourdough", "leaven"],
    ["пекарня", "булочная"],
    ["машина", "автомобиль"],
    ["car", "automobile"],
    ["компьютер", "ПК"],
    ["computer", "PC"],
    ["программа", "приложение"],
    ["program", "application", "app"],
    ["ошибка", "баг"],
    ["error", "bug", "fault"],
    ["быстрый", "скорый"],
    ["fast", "rapid", "speedy"],
    ["большой", "крупный"],
    ["big", "large", "huge"],
    ["документ", "файл"],
    ["document", "file"],
    ["космос", "вселенная"],
    ["space", "cosmos"],
    ["ракета", "корабль"],
    ["rocket", "spacecraft"],
]


@dataclass
class Query:
    terms: list[str]
    phrases: list[list[str]] = field(default_factory=list)
    variants: dict[str, list[str]] = field(default_factory=dict)

    def covers(self, term: str) -> list[str]:
        """The term and its variants."""
        return [term, *self.variants.get(term, [])]

    @property
    def weighted(self) -> list[tuple[str, float]]:
        """Every scored term once: the query's in order, then variants sorted."""
        extra = sorted({v for t in self.terms for v in self.variants.get(t, [])} - set(self.terms))
        return [(t, 1.0) for t in self.terms] + [(v, VARIANT_WEIGHT) for v in extra]

    def add_variants(self, term: str, more: list[str]) -> None:
        got = sorted(set(self.variants.get(term, [])) | (set(more) - set(self.terms)))
        if got:
            self.variants[term] = got


def parse_query(q: str, stemmed: bool = True) -> Query:
    parts = [analyze_text(p, stemmed) for p in _QUOTES.split(q)]
    return Query(sorted({t for p in parts for t in p}, key=str.encode), [p for p in parts[1::2] if p])


def last_prefix(q: str, stemmed: bool = True) -> tuple[str, str] | None:
    """(word, term) of the word being typed: the query must end within it."""
    if not q or not q[-1].isalnum() or not (found := text_words(q)):
        return None
    word = normalize_text(found[-1][1])
    if len(word) < 2 or word in STOP_WORDS:
        return None
    return word, stem(word) if stemmed else word


@cache
def _synonyms() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for group in SYNONYM_GROUPS:
        terms = [t[0] for t in map(analyze_text, group) if len(t) == 1]
        for t in terms:
            out.setdefault(t, set()).update(x for x in terms if x != t)
    return {k: frozenset(v) for k, v in out.items()}


def synonyms(term: str) -> list[str]:
    return sorted(_synonyms().get(term, ()))


def check_window(operator: str, offset: int, size: int) -> None:
    if operator not in ("or", "and"):
        raise ValueError("operator must be 'or' or 'and'")
    if offset < 0 or size < 0 or offset + size > MAX_WINDOW:
        raise ValueError(f"from + size must be at most {MAX_WINDOW}")
