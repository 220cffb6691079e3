"""Streaming scores: posts in, raw sums per day out; series are made in batch from the days, as z-scores need all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lexiscore.functions.language import LanguageModel
from lexiscore.functions.timestamps import calendar_parts
from lexiscore.operators.lexicons import check_lexicon, score_columns
from lexiscore.operators.standardise import text_digest
from lexiscore.operators.terms import count_terms
from lexiscore.plans.reputation import candidates


_EPOCH = "1970-01-01 00:00:00"


def _instant(posts: DataFrame) -> Column:
    """``created_at`` as an instant, whatever the zone of the session; naive times are taken as UTC."""
    at = F.col("created_at")
    if isinstance(posts.schema["created_at"].dataType, T.TimestampType):
        return at
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), at.cast("timestamp_ntz")))


def daily_sums(
    posts: DataFrame, lexicon: DataFrame, late: str = "2 days", lang: str | None = "en", model: LanguageModel | None = None
) -> DataFrame:
    """``day, created_at, ord, total_tweets`` and the score sums of each day, from a stream of standard posts.

    ``created_at`` is a time with a zone or in UTC; posts that come more than ``late`` after a newer one do not count, and a
    day is final, and leaves the state, once the newest time is that far beyond its end. A text counts once per id: a copy is
    recognised while its first is within that time, which bounds the state. Posts without an id, a time or a lexicon term do
    not count. The lexicon is a static table within the broadcast limits. Texts are scored where they are read; what the
    state holds is digests, and per post of an open day one row of sums.
    """
    columns = score_columns(check_lexicon(lexicon))
    # The optimizer puts the filters that follow below the watermark: posts that are set aside do not tell the time.
    timed = posts.withColumn("moment", _instant(posts)).withColumn("at", F.col("moment")).withWatermark("at", late)
    rows = candidates(timed, lang, model).where(F.col("tweet_id").isNotNull() & F.col("at").isNotNull())
    once = rows.withColumn("digest", text_digest(F.col("text"))).dropDuplicatesWithinWatermark(["tweet_id", "digest"])
    terms = count_terms(once, ["at", "moment", "ord", "tweet_id", "digest"])
    hits = terms.join(F.broadcast(lexicon), "term")
    # A grouping may have one column that carries the watermark; the plain time goes along as another.
    per_post = hits.groupBy(F.window("at", "1 day").alias("day"), "moment", "ord", "tweet_id", "digest").agg(
        *[F.sum(F.col("frequency") * F.col(c)).alias(c) for c in columns]
    )
    days = per_post.groupBy(F.window(F.window_time("day"), "1 day").alias("day")).agg(
        F.min_by("moment", "ord").alias("created_at"),
        F.min("ord").alias("ord"),
        F.count(F.lit(1)).alias("total_tweets"),
        *[F.sum(c).alias(c) for c in columns],
    )
    return days.withColumn("day", F.date_from_unix_date(F.floor(F.unix_seconds("day.start") / 86_400).cast("int")))


def start_daily_sums(days: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append finished days to a Parquet table; ``trigger`` as in ``DataStreamWriter.trigger``."""
    writer = days.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def state_of_days(spark: SparkSession, path: str) -> DataFrame:
    """The finished days as the state that ``series_of_state`` and ``merge_states`` take."""
    days = spark.read.parquet(path)
    naive = F.timestamp_add("MICROSECOND", F.unix_micros("created_at"), F.lit(_EPOCH).cast("timestamp_ntz"))
    timed = days.withColumn("created_at", naive)
    parts = calendar_parts(F.col("day"))
    sums = [c for c in days.columns if c.endswith(("_pos", "_neg"))]
    return timed.withColumns(parts).groupBy(*parts).agg(
        F.min_by("created_at", "ord").alias("created_at"),
        F.min("ord").alias("ord"),
        F.sum("total_tweets").alias("total_tweets"),
        *[F.sum(c).alias(c) for c in sums],
    )
