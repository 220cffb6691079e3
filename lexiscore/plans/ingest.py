"""From a raw table to posts that are ready for scoring."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from lexiscore.config import LOCAL_ZONE
from lexiscore.operators.standardise import (
    SAMPLE_ROWS,
    coerce_repost_flag,
    first_n,
    map_columns,
    missing_columns,
    normalise_created_at,
    parse_ratio,
)
from lexiscore.sources.readers import with_order


class Prepared(NamedTuple):
    """Posts, the format by which their times were read, and one row ``ok_ratio``: the share of all rows it could read."""

    posts: DataFrame
    fmt: str | None
    ratio: DataFrame


def prepare_with_report(
    raw: DataFrame,
    mapping: dict[str, str] | None = None,
    *,
    rows: int | None = None,
    fmt: str | None = "detect",
    zone: str = LOCAL_ZONE,
    sample_rows: int | None = SAMPLE_ROWS,
    epoch_unit: str | None = None,
) -> Prepared:
    """Standard posts: named columns, local times, a boolean repost flag, and the first ``rows`` rows if a number is given.

    ``mapping`` names the columns for ``tweet_id``, ``created_at`` and ``text``. Times are converted once; the format is
    found on the first ``sample_rows`` values (None: on all), and the ratio tells how far it holds. Times as numbers need
    ``epoch_unit``. A table that lacks a required column raises before any job starts.
    """
    posts = map_columns(raw, **mapping) if mapping else raw
    missing = missing_columns(posts)
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    if "ord" not in posts.columns:
        posts = with_order(posts)
    posts, used = normalise_created_at(
        coerce_repost_flag(posts), fmt, zone, sample_rows=sample_rows, epoch_unit=epoch_unit
    )
    return Prepared(posts if rows is None else first_n(posts, rows), used, parse_ratio(posts))


def prepare_posts(raw: DataFrame, mapping: dict[str, str] | None = None, **options) -> DataFrame:
    """The posts of ``prepare_with_report``, with its options."""
    return prepare_with_report(raw, mapping, **options).posts
