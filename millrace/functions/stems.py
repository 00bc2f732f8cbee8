"""Suffix stripping after Porter (1980), as an Arrow-batched function for those who want it; the default stem of a word is the word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes and what they become, as published; the longest that fits counts.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(s: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(s):
        out += "v" if ch in "aeiou" or (ch == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(s: str) -> int:
    return len(re.findall("v+c+", _shape(s)))


def _short_end(s: str) -> bool:
    return _shape(s).endswith("cvc") and s[-1] not in "wxy"


def _double(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and _shape(s)[-1] == "c"


def _swap(w: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            return base + table[suffix] if _measure(base) > least else w
    return w


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters, and such with other characters, stay."""
    w = word
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            base = w[: -len(end)]
            if w.endswith(end) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")):
                    w = base + "e"
                elif _double(base) and base[-1] not in "lsz":
                    w = base[:-1]
                else:
                    w = base + "e" if _measure(base) == 1 and _short_end(base) else base
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP_2, 0), STEP_3, 0)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1] in "st"):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Distinct stems of an array of words, in order."""
    for batch in words:
        yield batch.map(lambda ws: None if ws is None else list(dict.fromkeys(stem(w) for w in ws)))
