"""Period sums and moments as small tables that new posts are merged into, without reading old ones again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscore.config import CALENDAR_COLUMNS, granularity_columns
from lexiscore.operators.scoring import with_scores
from lexiscore.operators.series import NO_SPREAD, TOTAL, output_columns, period_sums, score_sides, z_scores


def period_state(scored: DataFrame, extra_driver: str | None = None) -> DataFrame:
    """One row per week of a month: number of posts, score sums, and the first time with the ``ord`` that makes it first.

    All that a series of any granularity needs of the posts; it has as many rows as the calendar has periods.
    """
    return period_sums(scored, "Weekly", extra_driver)


def merge_states(*states: DataFrame, extra_driver: str | None = None) -> DataFrame:
    """The state of all posts together, from states of disjoint sets of posts, in any order."""
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy(*CALENDAR_COLUMNS).agg(
        F.min_by("created_at", "ord").alias("created_at"),
        F.min("ord").alias("ord"),
        F.sum("total_tweets").alias("total_tweets"),
        *[F.sum(c).alias(c) for c in score_sides(rows, extra_driver)],
    )


def period_scores(state: DataFrame, granularity: str | list[str] = "Weekly", extra_driver: str | None = None) -> DataFrame:
    """Nets, drivers and reputation of each period, before they are compared with one another."""
    gran = granularity_columns(granularity)
    periods = state.groupBy(*gran).agg(
        F.min_by("created_at", "ord").alias("created_at"),
        F.sum("total_tweets").alias("total_tweets"),
        *[F.sum(c).alias(c) for c in score_sides(state, extra_driver)],
    )
    scores = [F.col(f"`{c}`") for c in output_columns(extra_driver)]
    return with_scores(periods, TOTAL, extra_driver).select(*gran, "created_at", "total_tweets", *scores)


def series_of_state(state: DataFrame, granularity: str | list[str] = "Weekly", extra_driver: str | None = None) -> DataFrame:
    """The time series that ``series`` makes of the posts, from their state."""
    gran = granularity_columns(granularity)
    return z_scores(period_scores(state, gran, extra_driver), output_columns(extra_driver)).orderBy("created_at", *gran)


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, n, mean, m2, most``: count, mean, sum of squared distances from it, and largest absolute value of each column."""
    values = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    value = F.col("cell.value")
    rows = df.select(F.explode(F.array(*values)).alias("cell")).where(value.isNotNull())
    return rows.groupBy(F.col("cell.column_name").alias("column_name")).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("m2"),
        F.max(F.abs(value)).alias("most"),
    )


def merge_moments(*parts: DataFrame) -> DataFrame:
    """Moments of all rows together, from those of disjoint sets of rows.

    The squared distance of each part's mean from the common mean, times its count, is what the parts' own sums lack.
    """
    rows = reduce(DataFrame.unionByName, parts)
    common = rows.groupBy("column_name").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    # One row per score column on either side.
    apart = rows.withColumnRenamed("mean", "own").join(common, "column_name")
    distance = F.col("own") - F.col("mean")
    return apart.groupBy("column_name").agg(
        F.sum("n").alias("n"),
        F.first("mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * distance * distance).alias("m2"),
        F.max("most").alias("most"),
    )


def z_scores_by_moments(df: DataFrame, columns: list[str], known: DataFrame) -> DataFrame:
    """Each column as z-score against ``moments`` that may be those of more rows than ``df`` has; 0 without spread."""
    found = {r["column_name"]: r for r in known.collect()}
    out = {}
    for c in columns:
        m = found.get(c)
        spread = (m["m2"] / (m["n"] - 1)) ** 0.5 if m and m["n"] > 1 else 0.0
        value = F.col(f"`{c}`").cast("double")
        flat = not m or spread <= m["most"] * NO_SPREAD
        out[c] = F.lit(0.0) if flat else (value - F.lit(m["mean"])) / F.lit(spread)
    return df.withColumns(out)
