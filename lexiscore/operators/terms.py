"""Posts to term rows. All of it is row-local: no step here shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscore.functions.tokens import WORD_TOKEN, tokens


def explode_terms(posts: DataFrame, keep: list[str]) -> DataFrame:
    """One row per token occurrence."""
    return posts.select(*keep, F.explode(tokens(F.col("text"))).alias("term"))


def count_terms(posts: DataFrame, keep: list[str], punctuation: bool = True, abbreviations: Sequence[str] = ()) -> DataFrame:
    """One row per distinct term of each post, with its ``frequency``.

    A post's tokens are sorted and the runs of equal terms measured within the row, so posts are counted where they are
    instead of being exploded, shuffled and grouped.
    """
    bag = tokens(F.col("text"), abbreviations)
    if not punctuation:
        bag = F.filter(bag, lambda t: t.rlike(WORD_TOKEN))
    rows = posts.select(*keep, F.sort_array(bag).alias("_bag"))
    starts = F.filter(
        F.transform("_bag", lambda term, i: i),
        lambda i: (i == 0) | (F.get("_bag", i) != F.get("_bag", i - 1)),
    )
    rows = rows.withColumn("_starts", starts)
    runs = F.transform(
        "_starts",
        lambda start, i: F.struct(
            F.get("_bag", start).alias("term"),
            (F.coalesce(F.get("_starts", i + 1), F.size("_bag")) - start).cast("bigint").alias("frequency"),
        ),
    )
    return rows.select(*keep, F.inline(runs))
