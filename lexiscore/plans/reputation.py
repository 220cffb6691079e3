"""The whole measure: posts to term rows, to scored posts, to a time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscore.functions.language import LanguageModel, detect_language
from lexiscore.functions.stemming import stem
from lexiscore.operators.abbreviations import MIN_SCORE, learned_abbreviations, period_counts
from lexiscore.operators.lexicons import check_lexicon, merge_lexicons, score_columns
from lexiscore.operators.scoring import reattach as reattach_sums
from lexiscore.operators.scoring import reattach_first, score_texts, with_scores
from lexiscore.operators.series import series
from lexiscore.operators.standardise import dedupe_keep_first, drop_reposts, ensure_text_and_id
from lexiscore.operators.terms import count_terms, explode_terms
from lexiscore.session import written
from lexiscore.sources.readers import with_order


def candidates(posts: DataFrame, lang: str | None = "en", model: LanguageModel | None = None) -> DataFrame:
    """Posts that may be scored: no reposts, one language. Copies are still there."""
    kept = ensure_text_and_id(drop_reposts(posts))
    if lang is None:
        return kept
    return kept.where(detect_language(F.col("text"), model) == lang)


def clean_posts(posts: DataFrame, lang: str | None = "en", model: LanguageModel | None = None) -> DataFrame:
    """Posts that are scored: no reposts, no copies, one language.

    Copies share their text and so their language, hence the filter, which needs no shuffle, goes first.
    """
    return dedupe_keep_first(candidates(posts, lang, model))


def clean_texts(posts: DataFrame, lang: str | None = "en") -> DataFrame:
    """``ord, tweet_id, created_at, text``: each post that is scored, once, with its lower-case text."""
    if "created_at" not in posts.columns:
        posts = posts.withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    if "ord" not in posts.columns:
        posts = with_order(posts)
    text = F.lower(F.coalesce("text", F.lit(""))).alias("text")
    return clean_posts(posts, lang).select("ord", "tweet_id", "created_at", text)


def learn_abbreviations(posts: DataFrame, min_score: float = MIN_SCORE) -> list[str]:
    """Abbreviations of the posts' own texts, without their last period; all the posts are read once."""
    return learned_abbreviations(written(period_counts(posts), "period-counts"), min_score)


def term_rows(
    posts: DataFrame,
    lang: str | None = "en",
    punctuation: bool = True,
    with_text: bool = False,
    abbreviations: Sequence[str] = (),
) -> DataFrame:
    """Bag of words: one row per post and term, keyed by the post's ``ord``, ``tweet_id`` and time.

    ``with_text`` repeats the post's lower-case text in each of its rows, which makes the table grow with the square of the
    text length; ``clean_texts`` has each text once, by the same keys. ``abbreviations`` (``learn_abbreviations``) keep their
    final period.
    """
    keys = ["ord", "tweet_id", "created_at"]
    keep = [*keys, "text"] if with_text else keys
    return count_terms(clean_texts(posts, lang), keep, punctuation, abbreviations).select(*keep, "term", "frequency")


def stem_vocabulary(posts: DataFrame) -> DataFrame:
    """Each distinct term of the posts, once, with its stem."""
    return explode_terms(posts, []).distinct().withColumn("stem", stem(F.col("term")))


def surface_lexicon(posts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The lexicon by surface forms: each term of the posts whose stem is a lexicon term.

    Stems are made once per distinct term. The result is written down, as it is read more than once.
    """
    forms = stem_vocabulary(posts).join(lexicon.withColumnRenamed("term", "stem"), "stem")
    return written(forms.select("term", *score_columns(lexicon)), "surface-lexicon")


def score_posts(
    posts: DataFrame,
    lexicon: DataFrame,
    *,
    lang: str | None = "en",
    model: LanguageModel | None = None,
    extra_lexicon: DataFrame | None = None,
    extra_driver: str | None = None,
    match_on: str = "surface",
    reattach: str = "raw",
    fmt: str | None = None,
    small: bool | None = None,
) -> DataFrame:
    """One row per post with its sums, nets, drivers and ``Brand_Reputation``.

    ``match_on`` compares lexicon terms with the words as written (``"surface"``) or with their stems (``"stem"``).
    ``reattach`` gives the sums of an id to all posts with that id (``"raw"``), reposts and copies among them, or to the
    scored posts only (``"clean"``). Posts without any lexicon term have no row. ``small`` tells whether the lexicon is
    broadcast; None has its size checked. A lexicon that is the result of much work should be written down first.
    """
    if match_on not in ("surface", "stem") or reattach not in ("raw", "clean"):
        raise ValueError(f"unknown option: match_on={match_on!r}, reattach={reattach!r}")
    lexicon = check_lexicon(lexicon)
    if extra_lexicon is not None:
        # Its size is checked, its terms and its weights are read: three times the merge, were it not written down.
        lexicon = written(merge_lexicons(lexicon, check_lexicon(extra_lexicon)), "merged-lexicon")
    rows = candidates(posts, lang, model)
    if match_on == "stem":
        lexicon = surface_lexicon(rows, lexicon)
    sums = score_texts(rows, lexicon, small)
    if reattach == "raw":
        attached = reattach_sums(posts if "ord" in posts.columns else with_order(posts), sums, fmt)
    else:
        # Both sides of the join read the order, so one that is made here is written down first.
        attached = reattach_first(rows if "ord" in rows.columns else written(with_order(rows), "ordered-posts"), sums, fmt)
    return with_scores(attached, "Brand_Reputation", extra_driver)


def shared(df: DataFrame) -> DataFrame:
    """Keep a table that several results read, such as scored posts for all granularities. Unpersist it when done."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def reputation_series(
    posts: DataFrame,
    lexicon: DataFrame,
    granularity: str | list[str] = "Weekly",
    *,
    extra_driver: str | None = None,
    **options,
) -> DataFrame:
    """Posts and a lexicon in, time series out. Only ids and times of the posts are joined back, not their texts."""
    return series(score_posts(posts, lexicon, extra_driver=extra_driver, **options), granularity, extra_driver)
