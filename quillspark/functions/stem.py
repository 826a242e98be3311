"""Snowball stemmers for English (Porter2) and Russian, written from the published algorithm descriptions."""

from __future__ import annotations

import re

_VOWELS = "aeiouy"
# Whole-word exceptions of the English stemmer.
_WHOLE = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "abli": "able",
    "entli": "ent",
    "izer": "ize",
    "ization": "ize",
    "ational": "ate",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "aliti": "al",
    "alli": "al",
    "fulness": "ful",
    "ousli": "ous",
    "ousness": "ous",
    "iveness": "ive",
    "iviti": "ive",
    "biliti": "ble",
    "bli": "ble",
    "ogi": "og",
    "fulli": "ful",
    "lessli": "less",
    "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _after_syllable(word: str, start: int, vowels: str) -> int:
    """The place after the first non-vowel that follows a vowel, from start."""
    for k in range(start + 1, len(word)):
        if word[k] not in vowels and word[k - 1] in vowels:
            return k + 1
    return len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = re.sub(r"(?<=[aeiouy])y", "Y", re.sub(r"^y", "Y", word))
    head = re.match(r"gener|commun|arsen", w)
    r1 = head.end() if head else _after_syllable(w, 0, _VOWELS)
    r2 = _after_syllable(w, r1, _VOWELS)

    def has_vowel(s: str) -> bool:
        return any(c in _VOWELS for c in s)

    # plurals
    end = _longest(w, ["sses", "ied", "ies", "us", "ss", "s"])
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and has_vowel(w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # past and participles
    end = _longest(w, ["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and has_vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    end = _longest(w, _STEP2)
    if end and len(w) - len(end) >= r1:
        stem = w[: -len(end)]
        if end == "ogi":
            w = stem + "og" if stem.endswith("l") else w
        elif end == "li":
            w = stem if stem[-1:] in tuple("cdeghkmnrt") else w
        else:
            w = stem + _STEP2[end]
    end = _longest(w, _STEP3)
    if end and len(w) - len(end) >= r1 and (end != "ative" or len(w) - len(end) >= r2):
        w = w[: -len(end)] + _STEP3[end]
    end = _longest(w, _STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_RU_VOWELS = "аеиоуыэюя"
# Suffix groups of the Russian stemmer; those of a *_1 group follow а or я.
_GERUND_1, _GERUND_2 = "в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split()
_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_PARTICIPLE_1, _PARTICIPLE_2 = "ем нн вш ющ щ".split(), "ивш ывш ующ".split()
_VERB_1 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
_VERB_2 = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _cut(rv: str, after_a: list[str], plain: list[str]) -> str | None:
    """The part without the longest suffix of the group, or None if none applies."""
    end = _longest(rv, [*after_a, *plain])
    if end is None or (end in after_a and end not in plain and rv[-len(end) - 1 : -len(end)] not in ("а", "я")):
        return None
    return rv[: -len(end)]


def russian(word: str) -> str:
    at = next((k + 1 for k, c in enumerate(word) if c in _RU_VOWELS), len(word))
    r2 = _after_syllable(word, _after_syllable(word, 0, _RU_VOWELS), _RU_VOWELS)
    head, rv = word[:at], word[at:]
    got = _cut(rv, _GERUND_1, _GERUND_2)
    if got is None:
        rv = rv[:-2] if rv.endswith(("ся", "сь")) else rv
        got = _cut(rv, [], _ADJECTIVE)
        if got is not None:
            part = _cut(got, _PARTICIPLE_1, _PARTICIPLE_2)
            got = got if part is None else part
        else:
            got = _cut(rv, _VERB_1, _VERB_2)
            if got is None:
                got = _cut(rv, [], _NOUN)
    rv = rv if got is None else got
    rv = rv[:-1] if rv.endswith("и") else rv
    end = _longest(rv, ["ост", "ость"])
    if end and len(head) + len(rv) - len(end) >= r2:
        rv = rv[: -len(end)]
    if rv.endswith("нн"):
        rv = rv[:-1]
    elif rv.endswith(("ейше", "ейш")):
        rv = rv[: -len(_longest(rv, ["ейше", "ейш"]))]
        rv = rv[:-1] if rv.endswith("нн") else rv
    elif rv.endswith("ь"):
        rv = rv[:-1]
    return head + rv


_CYRILLIC, _LATIN = re.compile("[а-яё]+"), re.compile("[a-z]+")


def stem(word: str) -> str:
    """By script: all Cyrillic or all ASCII letters are stemmed, anything else stays."""
    if _LATIN.fullmatch(word):
        return english(word)
    return russian(word) if _CYRILLIC.fullmatch(word) else word
