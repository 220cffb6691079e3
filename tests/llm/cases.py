"""Tables with awkward rows, and plain versions of rules for comparison."""

from __future__ import annotations

import random
import re

WORDS = "the of and to in that shore lantern quiet river stone paper garden window seven copper maple winter signal harbour".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


LONG = prose(99, 30_000)
#: Null id, null text, empty text, white space, repeated rows, a repeated id with another text, a very long text.
AWKWARD = [
    (1, "Alpha beta gamma delta epsilon zeta"),
    (1, "Alpha beta gamma delta epsilon zeta"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (None, "a row without an id, which is longer than most others here"),
    (5, "first text of the id"),
    (5, "second text of the id"),
    (6, LONG),
    (7, "ünïcödé Straße 漢字 🙂 ▁ end"),
]
#: Names that operators might use for themselves.
CLASHING = {"score": "double", "node": "string", "hash": "string", "_id": "long", "_row": "string", "ids": "string", "rank": "int"}


def awkward(spark, rows=AWKWARD):
    """``doc_id, text`` and columns with names that clash."""
    schema = "doc_id long, text string, " + ", ".join(f"{c} {t}" for c, t in CLASHING.items())
    return spark.createDataFrame([(i, t, *[None] * len(CLASHING)) for i, t in rows], schema)


def words_of(text: str | None) -> list[str]:
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def grams_of(text: str | None, size: int = 5) -> frozenset:
    words = words_of(text)
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()
