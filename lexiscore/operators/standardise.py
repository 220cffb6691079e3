"""From a user's table to standard posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscore.config import LOCAL_ZONE, PREVIEW_COLUMNS, REQUIRED_COLUMNS
from lexiscore.functions.flags import coerce_flag, looks_like_repost
from lexiscore.functions.timestamps import (
    DAY_FIRST,
    INFERRED,
    MONTH_FIRST,
    as_naive,
    calendar_parts,
    digit_shape,
    order_evidence,
    parse_epoch,
    parse_inferred,
    parse_pattern,
    parse_timestamp,
    patterns_of,
    to_local,
)
from lexiscore.operators.selection import nth_key, ordered_key
from lexiscore.session import written

# Values that decide the format of a column of times; callers may ask for the whole column.
SAMPLE_ROWS = 20
# Up to this many rows, "first n" is a top-n in one task; beyond, it is a filter. Both give the same rows.
TOP_N_ROWS = 1000


def map_columns(df: DataFrame, tweet_id: str, created_at: str, text: str) -> DataFrame:
    """Rename three distinct columns to the standard names. Another column that has such a name is dropped."""
    chosen = {tweet_id: "tweet_id", created_at: "created_at", text: "text"}
    if len(chosen) != 3:
        raise ValueError("id, time and text need three different columns")
    absent = [c for c in chosen if c not in df.columns]
    if absent:
        raise ValueError(f"no such columns: {absent}")
    taken = [c for c in chosen.values() if c in df.columns and c not in chosen]
    return df.select(*[F.col(f"`{c}`").alias(chosen.get(c, c)) for c in df.columns if c not in taken])


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in df.columns]


def preview(df: DataFrame, n: int = 5, order_col: str = "ord") -> DataFrame:
    """First rows of the standard columns that exist."""
    return first_n(df, n, order_col).select(*[c for c in PREVIEW_COLUMNS if c in df.columns])


def first_n(df: DataFrame, n: int = 1000, order_col: str = "ord", ties: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the first ``n`` rows by a column of any type that has an order (all, if there are fewer).

    Rows without an order value come last. Rows of equal order go by the columns ``ties``, then by a hash of their content, so
    the choice does not depend on the layout of the table. The rule is the same for any ``n``: up to ``TOP_N_ROWS`` it is a
    top-n, whose rows one task may hold; beyond, the last key that belongs to the result is looked up in a table of keys
    alone, and a filter keeps the rows up to it where they are.
    """
    key = ordered_key(df, [order_col, *ties])
    if n <= TOP_N_ROWS:
        return df.withColumn("_key", key).orderBy("_key").limit(n).drop("_key")
    keys = written(df.select(key.alias("key")), "first-n")
    if keys.count() <= n:
        return df
    edge, wanted = nth_key(keys, n)
    edge = edge.scalar()
    if keys.where(F.col("key") == edge).count() == wanted:
        return df.where(key <= edge)
    # Rows that tie to the end are copies of one another; the wanted number of them is made from their count.
    columns = [F.col(f"`{c}`") for c in df.columns]
    copies = df.where(key == edge).groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    so_far = F.sum("_copies").over(Window.orderBy(*columns))
    take = F.least(F.col("_copies"), wanted - (so_far - F.col("_copies")))
    made = copies.withColumn("_take", take).where("_take > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_take"))))
    return df.where(key < edge).unionAll(made.select(*columns))


def coerce_repost_flag(df: DataFrame) -> DataFrame:
    """``retweet`` as a boolean without nulls; false where there is no such column."""
    if "retweet" not in df.columns:
        return df.withColumn("retweet", F.lit(False))
    return df.withColumn("retweet", coerce_flag(F.col("retweet"), df.schema["retweet"].dataType))


def infer_repost_flag(df: DataFrame) -> DataFrame:
    """``retweet`` from its own column, else from texts that start with RT, else false."""
    if "retweet" not in df.columns and "text" in df.columns:
        return df.withColumn("retweet", looks_like_repost(F.col("text")))
    return coerce_repost_flag(df)


def drop_reposts(df: DataFrame) -> DataFrame:
    return infer_repost_flag(df).where(~F.col("retweet"))


def ensure_text_and_id(df: DataFrame) -> DataFrame:
    """Add ``text`` and ``tweet_id`` as empty strings where absent."""
    return df.withColumns({c: F.lit("") for c in ("text", "tweet_id") if c not in df.columns})


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def dedupe_keep_first(df: DataFrame, order_col: str = "ord") -> DataFrame:
    """One row per (text, tweet_id), the first by ``order_col``; nulls equal each other.

    Texts are told apart by a digest, which is what gets sorted. Spark keeps the first row per group within each task before
    it shuffles, so a group of copies of any size reaches the final task as at most one row per task.
    """
    copies = Window.partitionBy("tweet_id", "_digest").orderBy(order_col)
    ranked = df.withColumn("_digest", text_digest(F.col("text"))).withColumn("_rank", F.row_number().over(copies))
    return ranked.where(F.col("_rank") == 1).drop("_rank", "_digest")


def date_shapes(df: DataFrame, column: str = "created_at") -> DataFrame:
    """``shape, n_rows, n_day_first, n_month_first``: the shapes of texts that two orders of day and month could read.

    Rows that prove an order have a number above 12 where the other order has its month.
    """
    text = F.col(column).cast("string")
    proof = order_evidence(text)
    shaped = df.select(digit_shape(text).alias("shape"), proof.alias("proof")).where(F.col("shape").isNotNull())
    return shaped.groupBy("shape").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("proof") == DAY_FIRST).alias("n_day_first"),
        F.count_if(F.col("proof") == MONTH_FIRST).alias("n_month_first"),
    )


def date_order(df: DataFrame, column: str = "created_at", default: str = DAY_FIRST) -> str:
    """Whether the day or the month comes first, one answer for the whole column.

    Any row that proves an order settles it; where rows prove both, the order that more of them prove; without a proof the
    ``default``. One row reaches the driver.
    """
    day, month = date_shapes(df, column).agg(F.sum("n_day_first"), F.sum("n_month_first")).first()
    if (day or 0) == (month or 0):
        return default
    return DAY_FIRST if (day or 0) > (month or 0) else MONTH_FIRST


def detect_format(
    df: DataFrame,
    column: str = "created_at",
    order_col: str = "ord",
    sample_rows: int | None = SAMPLE_ROWS,
    order: str | None = None,
) -> str | None:
    """Format that reads all of the first ``sample_rows`` non-null values, of the whole column if None.

    Inferred forms go first, then the known patterns in turn, those of ``order`` alone if it is given. The only job returns
    one row.
    """
    sample = df.where(F.col(column).isNotNull())
    if sample_rows is not None:
        sample = sample.orderBy(order_col).limit(sample_rows)
    text = F.col(column).cast("string")
    readings = {INFERRED: parse_inferred(text, order)} | {p: parse_pattern(text, p) for p in patterns_of(order)}
    rows, *fits = sample.agg(F.count(column), *[F.count(parsed) for parsed in readings.values()]).first()
    return next((name for name, fit in zip(readings, fits) if fit == rows), None)


def parse_created_at(
    df: DataFrame,
    fmt: str | None = None,
    column: str = "created_at",
    epoch_unit: str | None = None,
    order: str | None = None,
) -> DataFrame:
    """``created_at`` as zone-free UTC time. Text is read by ``fmt``; None means best effort, by ``order`` if it is given.

    Numbers need ``epoch_unit``, as nothing in them tells seconds from milliseconds.
    """
    if column not in df.columns:
        return df
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.withColumn(column, as_naive(F.col(column), dtype))
    if isinstance(dtype, T.NumericType):
        if epoch_unit is None:
            raise ValueError(f"{column} holds numbers; name their unit since 1970 with epoch_unit")
        return df.withColumn(column, parse_epoch(F.col(column), epoch_unit))
    return df.withColumn(column, parse_timestamp(F.col(column).cast("string"), fmt, order))


def normalise_created_at(
    df: DataFrame,
    fmt: str | None = "detect",
    zone: str = LOCAL_ZONE,
    order_col: str = "ord",
    sample_rows: int | None = SAMPLE_ROWS,
    epoch_unit: str | None = None,
) -> tuple[DataFrame, str | None]:
    """``created_at`` read as UTC and shown as local wall-clock time, with the format that was used.

    A format that is to be found is found for the order of day and month that the whole column shows, so no column is read in
    two orders.
    """
    if "created_at" not in df.columns:
        return df, None
    textual = isinstance(df.schema["created_at"].dataType, T.StringType)
    order = None
    if fmt == "detect":
        order = date_order(df) if textual else None
        fmt = detect_format(df, order_col=order_col, sample_rows=sample_rows, order=order) if textual else INFERRED
    parsed = parse_created_at(df, fmt, epoch_unit=epoch_unit, order=order)
    return parsed.withColumn("created_at", to_local(F.col("created_at"), zone)), fmt


def parse_ratio(df: DataFrame, column: str = "created_at") -> DataFrame:
    """Share of rows whose time could be read."""
    return df.agg(F.avg(F.col(column).isNotNull().cast("double")).alias("ok_ratio"))


def add_calendar(df: DataFrame, fmt: str | None = None) -> DataFrame:
    """``created_at`` as zone-free time plus year, quarter, month and ISO week."""
    parsed = parse_created_at(df, fmt)
    return parsed.withColumns(calendar_parts(F.col("created_at")))
