"""Porter stems (M. F. Porter, "An algorithm for suffix stripping", 1980) with the common extensions of public toolkits.

A word is a string; a vowel is a, e, i, o, u, or y after a consonant. Suffix tables are data, the measure is one regular
expression, and Spark hands in Arrow batches of distinct words, so the per-word Python stays small.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscore.session import bound_arrow

# Words that do not follow the rules.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Suffix tables of steps 2, 3 and 4, as published.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
          "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_VOWEL_RUN = re.compile(r"v+c")


class _Letters(dict):
    def __missing__(self, key: int) -> str:
        return "c"


_LETTERS = _Letters({ord(ch): "v" for ch in "aeiou"} | {ord("y"): "y"})


def _shape(word: str) -> str:
    """The word as a string of v and c."""
    shape = word.translate(_LETTERS)
    while "y" in shape:
        i = shape.index("y")
        shape = shape[:i] + ("v" if i and shape[i - 1] == "c" else "c") + shape[i + 1 :]
    return shape


def _measure(word: str) -> int:
    return len(_VOWEL_RUN.findall(_shape(word)))


def _closed_short(word: str) -> bool:
    """Ends consonant-vowel-consonant (not w, x, y), or is just vowel-consonant."""
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _swap(word: str, rules: list[tuple[str, str]]) -> str:
    """Replace the first listed suffix the word has, if a positive measure remains."""
    for suffix, new in rules:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            # "logi" keeps its l when measured.
            return base + new if _measure(base + "l" if suffix == "logi" else base) > 0 else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
            base = word[: -len(suffix)]
            break
    else:
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c":
        return base if base[-1] in "lsz" else base[:-1]
    return base + "e" if _measure(base) == 1 and _closed_short(base) else base


def _second(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _second(word[:-2])
    return _swap(word, STEP_2)


def _fourth(word: str) -> str:
    for suffix in STEP_4:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            good = _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t")))
            return base if good else word
    return word


def _final(word: str) -> str:
    if word.endswith("e"):
        measure = _measure(word[:-1])
        if measure > 1 or (measure == 1 and not _closed_short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stem_word(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    return _final(_fourth(_swap(_second(word), STEP_3)))


# Executors get the helper with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(T.StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.map(stem_word, na_action="ignore")


@F.pandas_udf(T.StringType())
def _stem_joined(rows: pd.Series) -> pd.Series:
    stems = {word: stem_word(word) for word in {w for row in rows for w in row}}
    return rows.map(lambda row: " ".join(stems[w] for w in row))


def stem(word: Column) -> Column:
    """Stem of one word; meant for tables of distinct words.

    A join on the stem would make the optimizer test it for null below the step that makes words distinct, and so compute
    it once per token. It leaves a function that is marked as non-deterministic where it stands.
    """
    return _stem.asNondeterministic()(word)


def stem_joined(words: Column) -> Column:
    """Stems of an array of words, joined by spaces. Row-local, so it needs no shuffle of the words.

    Arrow batches are bounded by bytes, so rows of whole documents do not add up in a worker.
    """
    bound_arrow(SparkSession.active())
    return _stem_joined(F.coalesce(words, F.array().cast("array<string>")))
