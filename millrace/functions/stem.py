"""English stems by Porter's algorithm (1980), with the changes that evaluation toolkits have made to it."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Suffixes and what replaces them, in the order of Porter's paper, with three later additions.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble fulli:ful"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
IRREGULAR = "sky:sky skies:sky dying:die lying:lie tying:tie news:news innings:inning inning:inning outings:outing outing:outing cannings:canning canning:canning howe:howe proceed:proceed exceed:exceed succeed:succeed"

_PAIRS = lambda text: [tuple(x.split(":")) for x in text.split()]
_SECOND, _THIRD, _FOURTH, _ODD = _PAIRS(STEP_2), _PAIRS(STEP_3), STEP_4.split(), dict(_PAIRS(IRREGULAR))


def _shape(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(word)))


def _closed(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    shape = _shape(word)
    return shape.endswith("cvc") and word[-1] not in "wxy" or shape == "vc"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, pairs: list[tuple[str, str]], allowed) -> str:
    """The first suffix in order that the word has decides, whether it may go or not."""
    for suffix, other in pairs:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + other if allowed(stem) else word
    return word


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    for suffix in ("ed", "ing"):
        stem = w[: len(w) - len(suffix)]
        if w.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _closed(stem) else stem
    return w


def _second(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]):
        return _second(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) else w
    return _longest(w, _SECOND, _measure)


def _fourth(w: str) -> str:
    for suffix in _FOURTH:
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            return stem if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")) else w
    return w


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of at most two letters stay."""
    if word in _ODD:
        return _ODD[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _shape(w)[-2] == "c":
        w = w[:-1] + "i"
    w = _fourth(_longest(_second(w), _THIRD, _measure))
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _closed(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Each word of more than three letters as its stem."""
    return words.map(lambda ws: [stem(w) if len(w) > 3 else w for w in ws], na_action="ignore")


def scored_words(text: Column) -> Column:
    """The words that lexical metrics compare: runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
