"""Scored posts to z-scored time series.

Posts are summed per week first; every coarser level is built from those few rows. A series has one row per calendar
period, so its size is set by the calendar (under 5,500 weeks-in-a-month per century) and not by the number of posts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscore.config import CALENDAR_COLUMNS, GRANULARITIES, driver_groups, granularity_columns, sub_drivers
from lexiscore.operators.scoring import with_scores

TOTAL = "Brand Reputation"
# A spread below this part of the largest value is rounding noise of equal values.
NO_SPREAD = 1e-12


def output_columns(extra_driver: str | None = None) -> list[str]:
    """Score columns in report order: the nets of a bucket, then its driver, the total last."""
    cols = []
    for bucket, subs in driver_groups(extra_driver).items():
        cols += [f"{s}_net" for s in subs] + [f"{bucket}_Driver"]
    return [*cols, TOTAL]


def score_sides(df: DataFrame, extra_driver: str | None) -> list[str]:
    cols = [f"{s}_{side}" for s in sub_drivers(extra_driver) for side in ("pos", "neg")]
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise ValueError(f"scored posts lack the columns {absent}")
    return cols


def period_sums(scored: DataFrame, granularity: str | list[str], extra_driver: str | None = None) -> DataFrame:
    """Posts, summed scores and the first time per period; posts without a time go."""
    gran = granularity_columns(granularity)
    sides = score_sides(scored, extra_driver)
    return (
        scored.dropna(subset=["created_at", *gran])
        .groupBy(*gran)
        .agg(
            F.min_by("created_at", "ord").alias("created_at"),
            F.min("ord").alias("ord"),
            F.count("tweet_id").alias("total_tweets"),
            *[F.sum(c).alias(c) for c in sides],
        )
    )


def _regroup(periods: DataFrame, keys: list[str], sides: list[str]) -> DataFrame:
    return periods.groupBy(*keys).agg(
        F.min_by("created_at", "ord").alias("created_at"),
        F.sum("total_tweets").alias("total_tweets"),
        *[F.sum(c).alias(c) for c in sides],
    )


def z_scores(df: DataFrame, columns: list[str], level: list[str] | None = None) -> DataFrame:
    """Each column as z-score (sample deviation) over the periods of its level; 0 without spread."""
    window = Window.partitionBy(*(level or [F.lit(0)]))
    out = {}
    for c in columns:
        value = F.col(f"`{c}`").cast("double")
        mean, spread = F.avg(value).over(window), F.stddev_samp(value).over(window)
        noise = F.max(F.abs(value)).over(window) * NO_SPREAD
        out[c] = F.when(spread.isNull() | (spread <= noise), F.lit(0.0)).otherwise((value - mean) / spread)
    return df.withColumns(out)


def series(scored: DataFrame, granularity: str | list[str] = "Weekly", extra_driver: str | None = None) -> DataFrame:
    """Time series of z-scored nets, drivers and reputation, in time order."""
    gran = granularity_columns(granularity)
    cols = output_columns(extra_driver)
    scores = with_scores(period_sums(scored, gran, extra_driver), TOTAL, extra_driver)
    final = z_scores(scores, cols).select(*gran, "created_at", "total_tweets", *[F.col(f"`{c}`") for c in cols])
    return final.orderBy("created_at", *gran)


def series_all_levels(scored: DataFrame, extra_driver: str | None = None) -> DataFrame:
    """All granularities from one pass over the posts, told apart by ``granularity``."""
    cols = output_columns(extra_driver)
    sides = score_sides(scored, extra_driver)
    weeks = period_sums(scored, "Weekly", extra_driver)
    # A level is the list of calendar columns it keeps; the others become null.
    levels = F.explode(F.array(*[F.lit(name) for name in GRANULARITIES]))
    tagged = weeks.withColumn("granularity", levels)
    kept = {
        c: F.when(F.col("granularity").isin(*[g for g, keep in GRANULARITIES.items() if c in keep]), F.col(c))
        for c in CALENDAR_COLUMNS
    }
    keys = ["granularity", *CALENDAR_COLUMNS]
    periods = _regroup(tagged.withColumns(kept), keys, sides)
    scores = z_scores(with_scores(periods, TOTAL, extra_driver), cols, ["granularity"])
    return scores.select(*keys, "created_at", "total_tweets", *[F.col(f"`{c}`") for c in cols])


def plot_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Chosen columns in time order; by the calendar columns that there are where the table has no ``created_at``."""
    by = ["created_at"] if "created_at" in df.columns else [c for c in CALENDAR_COLUMNS if c in df.columns]
    return (df.orderBy(*by) if by else df).select(*[F.col(f"`{c}`") for c in (columns or [TOTAL])])


def long_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per period and chosen column."""
    chosen = columns or [TOTAL]
    keys = [c for c in df.columns if c in (*CALENDAR_COLUMNS, "created_at")]
    values = [F.col(f"`{c}`") for c in chosen]
    return df.select(*keys, *values).unpivot(keys, values, "driver", "score")
