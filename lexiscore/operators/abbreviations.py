"""Abbreviations learnt from a corpus without labels, by how firmly a word and a final period belong together.

After Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006): a log-likelihood ratio of "the period
belongs to the word" to "periods follow words at random", scaled for length, inner periods and occurrences without a period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscore.functions.tokens import PERIOD, period_tokens

# Fixed values of the paper: how often an abbreviation has its period, and the least score of one.
WITH_PERIOD = 0.99
MIN_SCORE = 0.3
#: A tokeniser takes at most this many abbreviations; they travel with its expression.
MAX_ABBREVIATIONS = 5_000
_WORD = r"^\p{L}[\p{L}\p{N}.-]*$"


def period_counts(posts: DataFrame) -> DataFrame:
    """``term, n, n_period``: how often each token occurs, and how often with a period that ends a sentence.

    One aggregation, combined before its shuffle. Counts of disjoint posts add up (``merge_counts``).
    """
    bag = F.col("_bag")
    occurrences = F.transform(
        bag, lambda token, i: F.struct(token.alias("term"), F.coalesce(F.get(bag, i + 1) == PERIOD, F.lit(False)).alias("period"))
    )
    words = F.filter(occurrences, lambda o: o["term"] != PERIOD)
    rows = posts.select(period_tokens(F.col("text")).alias("_bag")).select(F.inline(words))
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.count_if("period").alias("n_period"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Counts over all the posts behind ``counts``."""
    both = counts[0]
    for more in counts[1:]:
        both = both.unionByName(more)
    return both.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_period").alias("n_period"))


def score_abbreviations(counts: DataFrame) -> DataFrame:
    """``counts`` with ``score`` for each word that occurs with a period.

    ``counts`` is read twice, so write it down first. The share of tokens with a period is one number for the whole corpus;
    where it reaches that of abbreviations, periods tell nothing and no word scores above 0.
    """
    total = counts.agg(F.least(F.sum("n_period") / F.sum("n"), F.lit(WITH_PERIOD)).alias("_share"))
    words = counts.where((F.col("n_period") > 0) & F.col("term").rlike(_WORD))
    k, rest, share = F.col("n_period"), F.col("n") - F.col("n_period"), F.col("_share")
    own = k * F.log(F.lit(WITH_PERIOD)) + rest * F.log(F.lit(1 - WITH_PERIOD))
    chance = k * F.log(share) + rest * F.log(1 - share)
    letters = F.length(F.replace("term", F.lit("."), F.lit("")))
    periods = F.length("term") - letters + 1
    score = 2 * (own - chance) * F.exp(-letters) * periods * F.pow(letters.cast("double"), -rest)
    # One row, so this product adds a column and no rows.
    return words.join(F.broadcast(total)).select("term", "n", "n_period", score.alias("score"))


def learned_abbreviations(counts: DataFrame, min_score: float = MIN_SCORE) -> list[str]:
    """The words, without their last period, whose score is at least ``min_score``, for ``tokens`` and ``count_terms``.

    Raises where there are more than ``MAX_ABBREVIATIONS``; none is left out silently. A higher ``min_score`` gives fewer.
    """
    found = score_abbreviations(counts).where(F.col("score") >= min_score).select("term").limit(MAX_ABBREVIATIONS + 1).collect()
    if len(found) > MAX_ABBREVIATIONS:
        raise ValueError(f"more than {MAX_ABBREVIATIONS} abbreviations; raise min_score")
    return sorted(row.term for row in found)
