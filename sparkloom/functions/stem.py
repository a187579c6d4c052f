"""Word splitting and the classic English suffix-stripping stemmer for text search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VOWELS = frozenset("aeiou")
_TWO = [(a, b) for a, b in (x.split("-") for x in "ational-ate tional-tion enci-ence anci-ance izer-ize bli-ble alli-al entli-ent eli-e ousli-ous ization-ize ation-ate ator-ate alism-al iveness-ive fulness-ful ousness-ous aliti-al iviti-ive biliti-ble logi-log".split())]
_THREE = [(a, b) for a, b in (x.split("-") for x in "icate-ic ative- alize-al iciti-ic ical-ic ful- ness-".split())]
_FOUR = sorted("al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split(), key=len, reverse=True)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; underscores and punctuation separate."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shape(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        vowel = c in _VOWELS or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _has_vowel(w: str) -> bool:
    return "v" in _shape(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _short_end(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_TWO, _THREE):
        hit = max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    for end in _FOUR:
        if w.endswith(end):
            base = w[: -len(end)] if end not in ("sion", "tion") else w[:-3]
            if _measure(base) > 1:
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(stem, na_action="ignore")
