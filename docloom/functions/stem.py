"""Porter's stemmer of 1980, applied to the distinct words of a corpus only."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A word's shape: c for consonants, v for vowels; y is a vowel after a consonant.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c+", shape(word)))


def _short(word: str) -> bool:
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _longest(word: str, ends) -> str | None:
    return max((e for e in ends if word.endswith(e)), key=len, default=None)


#: Words that have a stem of their own.
STEMMED = "^[a-z]{3,}$"


def stem(word: str) -> str:
    """The stem of a word of three or more ASCII letters; other words as they are."""
    if not re.fullmatch("[a-z]{3,}", word):
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    elif (end := _longest(w, ("ed", "ing"))) and "v" in shape(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")) or (measure(w) == 1 and _short(w)):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (end := _longest(w, table)) and measure(w[: -len(end)]):
            w = w[: -len(end)] + table[end]
    if (end := _longest(w, _STEP4)) and measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4] in "st"):
        w = w[: -len(end)]
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def vocabulary(tokens: DataFrame) -> DataFrame:
    """token, term: the stem of each distinct token, so Python sees every word once."""
    return tokens.select("token").distinct().withColumn("term", _stems("token"))
