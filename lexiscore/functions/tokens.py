r"""Word tokens in one regular-expression pass.

Follows the public Treebank conventions on lower-cased text: punctuation marks are tokens of their own, clitics split off
(``do`` + ``n't``, ``it`` + ``'s``), hyphenated words, numbers such as ``1,000`` and paths such as ``good/bad`` stay
whole. Sentence ends are taken from the period itself: one that closes the text or comes before white space, with only
closing quotes or brackets between, is a token; any other stays in its word, and so does that of a known abbreviation.

Every piece is a possessive or fixed-width match, so long tokens need no deep recursion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
_MARKS = r";@#$%&?!*()\[\]{}<>«»“”„‘’\x22`"
_SENTENCE_END = rf"[\])}}>\x22'»”’]*(?:[{_SPACE}]|$)"
# What may follow a clitic: anything that ends a token.
_BREAK = rf"(?=[{_SPACE}{_MARKS}]|$|--|\.\.|''|[:,](?![0-9])|\.(?={_SENTENCE_END}))"
_CLITIC = r"(?:s|m|d|ll|re|ve)"
# A quote before a lone letter (except those that could be a clitic) is a token.
_LONE_LETTER = r"[\p{L}\p{N}_&&[^mtsdn]](?![\p{L}\p{N}_])"
_WORD = (
    "(?:"
    rf"[^n.:,'\-{_SPACE}{_MARKS}]++"
    rf"|n(?:(?<='n)|(?!'t{_BREAK}))"
    r"|-(?!-)"
    rf"|\.(?!\.|{_SENTENCE_END})"
    r"|[:,](?=[0-9])"
    # Of two such marks in a row, the second stays with what follows.
    r"|(?<=(?<![:,])[:,])[:,](?![:,0-9])"
    rf"|'(?!'|{_CLITIC}?{_BREAK}|{_LONE_LETTER})"
    ")++"
)
# Fused forms that count as two words.
FUSED_FORMS = [
    ("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"),
    ("wan", "na"), ("d", "'ye"), ("more", "'n"), ("'t", "is"), ("'t", "was"),
]
_FUSED_END = rf"(?:(?![A-Za-z0-9_])|n't{_BREAK})"
# The look-ahead at the first letter spares other words the test.
_FUSED = "(?=[cgldwm'])(?<![A-Za-z0-9_])(?:" + "|".join(f"{a}(?={b}{_FUSED_END})" for a, b in FUSED_FORMS) + ")"
# Most words are plain ones before a space, which needs no further tests.
_PLAIN = "[a-z0-9]++(?= )"
TOKEN_PATTERN = rf"{_FUSED}|{_PLAIN}|{_WORD}|n't{_BREAK}|'{_CLITIC}{_BREAK}|\.\.+|--|''|`+|[^{_SPACE}]"

_OPENING_QUOTE = rf"(^|[{_SPACE}(\[{{<])(\x22|'')"
WORD_TOKEN = r"[\p{L}\p{N}]"

#: Stands for a period right after a word at a sentence end while abbreviations are looked for. A code point that Unicode keeps
#: for use within programs, so texts have none.
PERIOD = "\ufdd0"
_WORD_PERIOD = rf"(?<=[^.{_SPACE}])\.(?={_SENTENCE_END})"
# The mark is a token of its own and ends the word before it, as the period does.
_MARKED_PATTERN = TOKEN_PATTERN.replace(_MARKS, _MARKS + PERIOD)


def _quoted(text: Column) -> Column:
    # Double quotes become `` when opening and '' when closing; most texts have none and skip that pass.
    return F.when(
        F.contains(text, F.lit('"')) | F.contains(text, F.lit("''")),
        F.replace(F.regexp_replace(F.lower(text), _OPENING_QUOTE, "$1 `` "), F.lit('"'), F.lit(" '' ")),
    ).otherwise(F.lower(text))


def period_tokens(text: Column) -> Column:
    """``tokens`` with ``PERIOD`` instead of a period that follows a word without a space and ends a sentence."""
    marked = F.regexp_replace(_quoted(text), _WORD_PERIOD, PERIOD)
    return F.regexp_extract_all(marked, F.lit(_MARKED_PATTERN), F.lit(0))


def tokens(text: Column, abbreviations: Sequence[str] = ()) -> Column:
    """Array of lower-case tokens of a text, in order; null for null. ``abbreviations``, given without their last period, keep it."""
    if not abbreviations:
        return F.regexp_extract_all(_quoted(text), F.lit(TOKEN_PATTERN), F.lit(0))
    # The lambda's argument binds the tokens, so that they are made once for a text.
    return F.get(F.transform(F.array(period_tokens(text)), lambda bag: _join_periods(bag, abbreviations)), 0)


def _join_periods(bag: Column, abbreviations: Sequence[str]) -> Column:
    known = lambda i: F.get(bag, i).isin(*abbreviations)
    joined = F.transform(
        bag,
        lambda token, i: F.when(token == PERIOD, F.when(known(i - 1), F.lit("")).otherwise(F.lit(".")))
        .when(known(i) & (F.get(bag, i + 1) == PERIOD), F.concat(token, F.lit(".")))
        .otherwise(token),
    )
    return F.filter(joined, lambda token: token != "")
