"""The stemming algorithm of Porter (1980) with two later departures, for distinct words.

A word's shape is a string of c and v, so every condition is a pattern on the shape of what a
suffix leaves. Words of one or two letters stay as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Suffixes and what they become where the measure of the rest is above 0. "bli" and "logi" are the departures.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
#: The same for the third step.
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Suffixes dropped where the measure of the rest is above 1; "ion" only after s or t.
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_SUFFIXES = {2: sorted(STEP_2, key=len, reverse=True), 3: sorted(STEP_3, key=len, reverse=True), 4: sorted(STEP_4, key=len, reverse=True)}
_GROUPS = re.compile("v+c+")


def shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(word: str) -> int:
    return len(_GROUPS.findall(shape(word)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def _suffix(word: str, step: int) -> str | None:
    return next((s for s in _SUFFIXES[step] if word.endswith(s)), None)


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    rest = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e)), None)
    if rest is None or "v" not in shape(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _doubled(rest):
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if measure(rest) == 1 and _short_end(rest) else rest


def _mapped(word: str, step: int, table: dict[str, str]) -> str:
    suffix = _suffix(word, step)
    if suffix and measure(word[: -len(suffix)]) > 0:
        return word[: -len(suffix)] + table[suffix]
    return word


def _dropped(word: str) -> str:
    suffix = _suffix(word, 4)
    if suffix is None or (suffix == "ion" and word[-4:-3] not in ("s", "t")):
        return word
    rest = word[: -len(suffix)]
    return rest if measure(rest) > 1 else word


def _tidied(word: str) -> str:
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; null-safe callers keep null themselves."""
    if len(word) < 3:
        return word
    word = _past(_plural(word))
    if len(word) > 1:
        if word.endswith("y") and "v" in shape(word[:-1]):
            word = word[:-1] + "i"
        word = _mapped(word, 2, STEP_2)
        word = _mapped(word, 3, STEP_3)
        word = _tidied(_dropped(word))
    return word


@F.pandas_udf(StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(lambda w: stem(w) if isinstance(w, str) else None)


def stems_of(terms: DataFrame, column: str = "term") -> DataFrame:
    """(column, stem) of the distinct non-null terms: each is stemmed once, however often it occurs."""
    return terms.select(column).where(F.col(column).isNotNull()).distinct().withColumn("stem", stem_column(column))
