"""Weights to post scores."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscore.config import driver_groups
from lexiscore.functions.timestamps import calendar_parts
from lexiscore.operators.lexicons import drop_unknown, is_small, join_weights, score_columns
from lexiscore.operators.standardise import parse_created_at, text_digest
from lexiscore.operators.terms import count_terms


def term_scores(term_rows: DataFrame, lexicon: DataFrame, small: bool | None = None) -> DataFrame:
    """Term rows with every weight multiplied by the frequency."""
    joined = join_weights(term_rows, lexicon, is_small(lexicon) if small is None else small)
    scores = [(F.col("frequency") * F.col(c)).alias(c) for c in score_columns(lexicon)]
    return joined.select(*term_rows.columns, *scores)


def sum_scores(scored_terms: DataFrame, columns: list[str]) -> DataFrame:
    """Scores per post id; rows without an id go."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]
    return scored_terms.where(F.col("tweet_id").isNotNull()).groupBy("tweet_id").agg(*sums)


def score_texts(posts: DataFrame, lexicon: DataFrame, small: bool | None = None) -> DataFrame:
    """Score sums per post id, copies of one text under one id counted once.

    Terms are counted where the texts are read, and texts are never shuffled: what moves is one short row per post and
    lexicon term in it, with a digest for the text. Copies have equal counts, so grouping by id, digest and term leaves one
    of each. Both groupings combine before their shuffle, so neither an id nor a text with very many rows fills a task, and
    rows are told apart by content only, so a task that runs again gives the same rows. ``small`` tells whether the lexicon
    is broadcast; None has its size checked. Of a larger one a Bloom filter is broadcast, so that words it does not have are
    mostly not shuffled.
    """
    keys = ["tweet_id", "digest"]
    rows = posts.where(F.col("tweet_id").isNotNull()).select("tweet_id", "text")
    counts = count_terms(rows.withColumn("digest", text_digest(F.col("text"))), keys)
    small = is_small(lexicon) if small is None else small
    if small:
        counts = counts.join(F.broadcast(lexicon.select("term").distinct()), "term", "left_semi")
    else:
        counts = drop_unknown(counts, lexicon)
    once = counts.groupBy(*keys, "term").agg(F.max("frequency").alias("frequency"))
    return sum_scores(term_scores(once, lexicon, small), score_columns(lexicon))


def reattach(posts: DataFrame, sums: DataFrame, fmt: str | None = None) -> DataFrame:
    """All columns of the posts, calendar columns and the sums of their id; posts without sums go.

    An id may have very many posts, while its sums are one row, so the posts of such an id can be split among tasks.
    Adaptive execution does that, but only where both sides are shuffled for the join itself. The sums already lie by id
    from their aggregation; joining by the id and its hash has them shuffled again, one small row per id.
    """
    clash = (set(sums.columns) - {"tweet_id"}) & set(posts.columns)
    if clash:
        raise ValueError(f"posts already have the columns {sorted(clash)}")
    by_hash = F.xxhash64("tweet_id")
    left, right = parse_created_at(posts, fmt).withColumn("_hash", by_hash), sums.withColumn("_hash", by_hash)
    joined = left.join(right, ["tweet_id", "_hash"])
    # Calendar columns come after the shuffle, which then moves one time per post.
    calendar = calendar_parts(F.col("created_at")) if "created_at" in posts.columns else {}
    scores = [c for c in sums.columns if c != "tweet_id"]
    return joined.withColumns(calendar).select(*[c for c in posts.columns if c not in calendar], *calendar, *scores)


def reattach_first(posts: DataFrame, sums: DataFrame, fmt: str | None = None) -> DataFrame:
    """``reattach`` to the first post, by ``ord``, of each id and text; ``ord`` tells the rows of a table apart.

    The first posts are found among ids, digests and orders alone and meet the sums first, so each text is shuffled once,
    and those of posts without sums never reach the result's shuffle partner.
    """
    clash = (set(sums.columns) - {"tweet_id"}) & set(posts.columns)
    if clash:
        raise ValueError(f"posts already have the columns {sorted(clash)}")
    keys = posts.select("tweet_id", text_digest(F.col("text")).alias("_digest"), "ord")
    firsts = keys.groupBy("tweet_id", "_digest").agg(F.min("ord").alias("_first"))
    scored = firsts.join(sums, "tweet_id").withColumnRenamed("tweet_id", "_id").drop("_digest")
    joined = parse_created_at(posts, fmt).join(scored, (F.col("tweet_id") == F.col("_id")) & (F.col("ord") == F.col("_first")))
    calendar = calendar_parts(F.col("created_at")) if "created_at" in posts.columns else {}
    scores = [c for c in sums.columns if c != "tweet_id"]
    return joined.withColumns(calendar).select(*[c for c in posts.columns if c not in calendar], *calendar, *scores)


def net_columns(columns: list[str], extra_driver: str | None = None) -> dict:
    """``<sub>_net`` expressions; 0 where the table lacks a side."""
    nets = {}
    for sub in (s for subs in driver_groups(extra_driver).values() for s in subs):
        pos, neg = f"{sub}_pos", f"{sub}_neg"
        both = pos in columns and neg in columns
        nets[f"{sub}_net"] = F.col(pos) - F.col(neg) if both else F.lit(0).cast("bigint")
    return nets


def driver_columns(extra_driver: str | None = None) -> dict:
    """``<bucket>_Driver`` expressions: the mean of the nets in the bucket."""
    return {
        f"{bucket}_Driver": reduce(add, [F.col(f"{s}_net") for s in subs]) / F.lit(float(len(subs)))
        for bucket, subs in driver_groups(extra_driver).items()
    }


def reputation(extra_driver: str | None = None):
    """Sum of all drivers."""
    return reduce(add, [F.col(f"{bucket}_Driver") for bucket in driver_groups(extra_driver)])


def with_scores(df: DataFrame, total: str, extra_driver: str | None = None) -> DataFrame:
    """Nets, then drivers, then their sum as column ``total``."""
    nets = df.withColumns(net_columns(df.columns, extra_driver))
    return nets.withColumns(driver_columns(extra_driver)).withColumn(total, reputation(extra_driver))
