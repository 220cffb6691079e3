"""One named query per operator; each reads whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscore.catalog import fixtures as fx
from lexiscore.config import GRANULARITIES
from lexiscore.functions import language as lang
from lexiscore.functions import timestamps as ts
from lexiscore.functions.stemming import stem_joined
from lexiscore.functions.tokens import tokens
from lexiscore.operators import abbreviations, lexicons, scoring, series, standardise, state, terms
from lexiscore.plans import index as ix
from lexiscore.plans import reputation as plan
from lexiscore.plans.ingest import prepare_posts as prepare
from lexiscore.plans.store import stored
from lexiscore.session import scratch_path, written
from lexiscore.sources import readers, writers
from lexiscore.streaming import scores as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, for comparison with another engine; adding 0.0 turns -0.0 into 0.0."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), 6) + F.lit(0.0) for c in doubles})


# Ingest


@query
def ingest_csv_roundtrip(spark, d):
    path = scratch_path(spark, "posts-csv")
    writers.write_csv(fx.posts(spark, d), path)
    types = {"tweet_id": "bigint", "created_at": "timestamp_ntz", "ord": "bigint"}
    return readers.read_posts_csv(spark, path, types, order_col="ord")


@query
def ingest_csv_inferred(spark, d):
    """Types of all columns found from their cells."""
    path = scratch_path(spark, "posts-csv")
    posts = fx.posts(spark, d).withColumn("share", F.when(F.col("ord") % 3 != 0, F.col("ord") / 8)).withColumn("none", F.lit(None).cast("string"))
    writers.write_csv(posts, path)
    return readers.read_posts_csv(spark, path, order_col="ord")


@query
def map_columns(spark, d):
    conversations = fx.table(spark, d, "conversations").withColumn("tweet_id", F.lit("dropped"))
    return standardise.map_columns(conversations, tweet_id="conv_id", created_at="turn", text="text")


@query
def missing_columns(spark, d):
    docs = fx.table(spark, d, "documents")
    absent = F.explode(F.array(*[F.lit(c) for c in standardise.missing_columns(docs)]))
    return docs.select(absent.alias("missing_column")).groupBy("missing_column").agg(F.count("*").alias("n_posts"))


@query
def preview(spark, d):
    return standardise.preview(fx.messy_posts(spark, d))


@query
def first_n_large(spark, d):
    """A third of a table, by an order that repeats and has nulls."""
    items = fx.table(spark, d, "lineitem")
    quantity = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity").cast("bigint")).alias("quantity")
    keyed = items.select(quantity, "l_orderkey", "l_linenumber", "l_returnflag")
    return standardise.first_n(keyed, items.count() // 3, "quantity", ties=("l_orderkey", "l_linenumber"))


@query
def first_n_by_price(spark, d):
    """Half of a table, by fractions some of which are missing."""
    items = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    priced = items.withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice")))
    return standardise.first_n(priced, items.count() // 2, "l_extendedprice", ties=("l_orderkey", "l_linenumber"))


@query
def first_n_by_time(spark, d):
    """A quarter of a table, by times that repeat, then by texts."""
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return standardise.first_n(orders, orders.count() // 4, "o_orderdate", ties=("o_orderpriority", "o_orderkey"))


@query
def first_n(spark, d):
    return standardise.first_n(fx.messy_posts(spark, d), 300)


# Time


def _time_texts(spark, d) -> DataFrame:
    """Order times of day spread over the whole table."""
    orders = fx.table(spark, d, "orders")
    seconds = F.pmod(F.col("o_orderkey") * 97, F.lit(86400)).cast("int")
    at = F.timestamp_add("SECOND", seconds, F.col("o_orderdate").cast("timestamp_ntz"))
    return orders.select(F.col("o_orderkey").alias("tweet_id"), F.col("o_orderkey").alias("ord"), at.alias("at"))


_SPARK_FIELDS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS"}


def _render(col, pattern: str):
    for field, letters in _SPARK_FIELDS.items():
        pattern = pattern.replace(field, letters)
    return F.date_format(col, pattern)


@query
def parse_time_by_pattern(spark, d):
    junk = F.col("tweet_id") % 10 == 3
    parsed = []
    for i, pattern in enumerate(ts.COMMON_PATTERNS):
        text = F.when(junk, "n/a").otherwise(_render(F.col("at"), pattern))
        parsed.append(ts.parse_pattern(text, pattern).alias(f"p{i:02d}"))
    return _time_texts(spark, d).select("tweet_id", *parsed)


def _mixed_texts(spark, d) -> DataFrame:
    n = len(ts.COMMON_PATTERNS)
    forms = [F.when(F.col("tweet_id") % (n + 1) == i, _render(F.col("at"), p)) for i, p in enumerate(ts.COMMON_PATTERNS)]
    return _time_texts(spark, d).select("tweet_id", "ord", F.coalesce(*forms, F.lit("n/a")).alias("created_at"))


@query
def parse_time_best_effort(spark, d):
    return standardise.parse_created_at(_mixed_texts(spark, d)).drop("ord")


_INFERRED_FORMS = [
    "EEE MMM dd HH:mm:ss '+0000' yyyy", "MMM d, yyyy", "d MMMM yyyy HH:mm", "yyyyMMdd", "MM/dd/yyyy hh:mm a", "dd-MM-yyyy",
    "dd.MM.yyyy HH:mm", "'n/a'",
]


@query
def parse_time_inferred(spark, d):
    forms = [
        F.when(F.col("tweet_id") % len(_INFERRED_FORMS) == i, F.date_format("at", form)) for i, form in enumerate(_INFERRED_FORMS)
    ]
    texts = _time_texts(spark, d).select("tweet_id", F.coalesce(*forms).alias("created_at"))
    return standardise.parse_created_at(texts, ts.INFERRED)


@query
def date_shapes(spark, d):
    return standardise.date_shapes(_mixed_texts(spark, d))


@query
def parse_time_one_order(spark, d):
    """Month first throughout; the earliest rows could be read either way, and later ones settle it for all."""
    late = F.dayofmonth("at") > 12
    texts = _time_texts(spark, d).select(
        "tweet_id", (F.col("tweet_id") + F.when(late, 10_000_000).otherwise(0)).alias("ord"),
        F.when(F.col("tweet_id") % 31 == 30, "n/a").when(F.col("tweet_id") % 2 == 0, _render(F.col("at"), "%m/%d/%Y %H:%M"))
        .otherwise(_render(F.col("at"), "%m/%d/%Y")).alias("created_at"),
    )
    local, fmt = standardise.normalise_created_at(texts, zone="UTC")
    return local.select("tweet_id", "created_at", F.lit(fmt).cast("string").alias("fmt"))


@query
def parse_ratio(spark, d):
    return rounded(standardise.parse_ratio(standardise.parse_created_at(_mixed_texts(spark, d))))


@query
def normalise_created_at(spark, d):
    text = F.when(F.col("tweet_id") % 29 == 28, "n/a").otherwise(_render(F.col("at"), "%d/%m/%Y %H:%M:%S"))
    posts = _time_texts(spark, d).select("tweet_id", "ord", text.alias("created_at"))
    local, fmt = standardise.normalise_created_at(posts)
    return local.select("tweet_id", "created_at", F.lit(fmt).alias("fmt"))


@query
def to_paris_time(spark, d):
    return _time_texts(spark, d).select("tweet_id", ts.to_local(F.col("at")).alias("created_at"))


@query
def calendar_columns(spark, d):
    return standardise.add_calendar(_time_texts(spark, d).select("tweet_id", F.col("at").alias("created_at")))


@query
def format_timestamp(spark, d):
    events = fx.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("created_at"))
    return writers.format_created_at(events)


@query
def prepare_posts(spark, d):
    # Times as text with a known pattern, the flag as text, and names of the user's own.
    posts = fx.messy_posts(spark, d).withColumn("created_at", _render(F.col("created_at"), "%d/%m/%Y %H:%M"))
    raw = posts.withColumnsRenamed({"tweet_id": "id", "created_at": "posted", "text": "body"})
    return prepare(raw, {"tweet_id": "id", "created_at": "posted", "text": "body"})


# Flags


@query
def coerce_flag_csv(spark, d):
    """Flags as a table with blanks spells them, from file to posts without reposts."""
    flag = F.get(F.array(*[F.lit(v) for v in ("1.0", "0.0", None, "2")]), F.pmod("ord", F.lit(4)).cast("int"))
    path = scratch_path(spark, "flags-csv")
    writers.write_csv(fx.posts(spark, d).withColumn("retweet", flag), path)
    raw = readers.read_posts_csv(spark, path, {"tweet_id": "bigint", "ord": "bigint"}, order_col="ord")
    return standardise.drop_reposts(prepare(raw, sample_rows=None))


@query
def posts_without_text(spark, d):
    bare = fx.table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("ts").alias("created_at"))
    return standardise.ensure_text_and_id(bare)


@query
def coerce_flag_string(spark, d):
    return standardise.coerce_repost_flag(fx.messy_posts(spark, d)).select("ord", "retweet")


@query
def coerce_flag_numeric(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderkey", fx.flag_numbers(F.col("o_orderkey")).alias("retweet"))
    return standardise.coerce_repost_flag(orders)


@query
def coerce_flag_missing(spark, d):
    return standardise.coerce_repost_flag(fx.table(spark, d, "orders").select("o_orderkey"))


@query
def infer_repost(spark, d):
    return standardise.infer_repost_flag(fx.reposted_texts(spark, d)).select("ord", "retweet")


@query
def drop_reposts(spark, d):
    return standardise.drop_reposts(fx.messy_posts(spark, d))


# Text


@query
def dedupe_keep_first(spark, d):
    return standardise.dedupe_keep_first(fx.messy_posts(spark, d))


@query
def term_frequency(spark, d):
    return terms.count_terms(fx.table(spark, d, "documents").select("doc_id", "text"), ["doc_id"])


@query
def term_rows(spark, d):
    return plan.term_rows(fx.messy_posts(spark, d))


@query
def clean_texts(spark, d):
    return plan.clean_texts(fx.messy_posts(spark, d))


# Language


@query
def detect_language(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", lang.detect_language(F.col("text")).alias("language"))


@query
def train_language_model(spark, d):
    return lang.train_language_model(fx.table(spark, d, "documents"))


@query
def language_margins(spark, d):
    """Each turn of talk, judged by a model that is learnt from another table."""
    model = lang.load_language_model(train_language_model(spark, d))
    judged = lang.score_languages(F.col("text"), model).alias("judged")
    turns = fx.table(spark, d, "conversations").select("conv_id", "turn", "role", judged)
    return turns.select("conv_id", "turn", "role", "judged.language", "judged.margin")


@query
def filter_language(spark, d):
    return plan.candidates(fx.messy_posts(spark, d), lang="fr")


# Stems


@query
def stem_vocabulary(spark, d):
    return plan.stem_vocabulary(fx.table(spark, d, "documents").select("text"))


@query
def stem_sentence(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", stem_joined(tokens(F.col("text"))).alias("text_stemmed"))


@query
def score_posts_stemmed(spark, d):
    return rounded(plan.score_posts(fx.messy_posts(spark, d), fx.lexicon(spark), match_on="stem"))


# Lexicons that are as large as a vocabulary


@query
def merge_lexicon(spark, d):
    return lexicons.merge_lexicons(fx.vocabulary_lexicon(spark, d), fx.conversation_lexicon(spark, d))


@query
def validate_lexicon(spark, d):
    merged = lexicons.merge_lexicons(
        fx.vocabulary_lexicon(spark, d).drop("cool_neg"), fx.conversation_lexicon(spark, d), how="full"
    )
    cols = lexicons.score_columns(merged)
    unpaired = lexicons.unpaired_columns(merged)
    sums = merged.agg(*[F.sum(c).alias(c) for c in cols])
    long = sums.unpivot([], cols, "column_name", "weight_sum")
    paired = long.withColumn("paired", ~F.col("column_name").isin(*unpaired))
    return paired.withColumn("free_of_net", F.lit(lexicons.free_of_substring(merged, "_net")))


@query
def read_lexicon_file(spark, d):
    path = scratch_path(spark, "lexicon-csv")
    fx.lexicon(spark).write.option("header", True).csv(path)
    posts = fx.posts(spark, d)
    return scoring.sum_scores(
        scoring.term_scores(terms.count_terms(posts, ["ord", "tweet_id"]), readers.read_lexicon(spark, path)), fx.SCORE_COLUMNS
    )


@query
def post_sums_vocabulary_lexicon(spark, d):
    big = written(fx.vocabulary_lexicon(spark, d), "vocabulary-lexicon")
    # The side that a lexicon beyond the broadcast limits takes, at every size of the tables.
    return scoring.score_texts(plan.candidates(fx.messy_posts(spark, d)), big, small=False)


@query
def post_sums_conversation_lexicon(spark, d):
    """A shuffled lexicon that lacks most words of the posts, behind its Bloom filter."""
    other = written(fx.conversation_lexicon(spark, d), "conversation-lexicon")
    return scoring.score_texts(plan.candidates(fx.messy_posts(spark, d)), other, small=False)


@query
def abbreviation_scores(spark, d):
    """Words of all documents that may be abbreviations, with their scores."""
    counts = written(abbreviations.period_counts(fx.abbreviated_documents(spark, d)), "period-counts")
    return rounded(abbreviations.score_abbreviations(counts).where(F.col("score") >= abbreviations.MIN_SCORE))


@query
def term_frequency_abbreviations(spark, d):
    """Terms of each document; abbreviations that the documents themselves teach keep their period."""
    docs = fx.abbreviated_documents(spark, d)
    return terms.count_terms(docs, ["doc_id"], abbreviations=plan.learn_abbreviations(docs))


@query
def index_two_lexicons(spark, d):
    """Two lexicons, a broadcast and a shuffled one, on one index of the posts."""
    index = ix.index_posts(fx.messy_posts(spark, d))
    big = written(fx.vocabulary_lexicon(spark, d), "vocabulary-lexicon")
    parts = []
    for name, lexicon, small in (("hand-made", fx.lexicon(spark), None), ("vocabulary", big, False)):
        sums = ix.indexed_sums(spark, index, lexicon, small)
        sides = [reduce(Column.__add__, [F.col(c) for c in lexicons.score_columns(lexicon) if c.endswith(end)]) for end in ("_pos", "_neg")]
        parts.append(sums.select(F.lit(name).alias("lexicon"), "tweet_id", sides[0].alias("pos"), sides[1].alias("neg")))
    return reduce(DataFrame.unionByName, parts)


@query
def score_posts_bucketed(spark, d):
    """Posts and their sums, laid out by id."""
    messy = fx.messy_posts(spark, d)
    posts = ix.bucket_posts(messy)
    sums = ix.bucket_sums(scoring.score_texts(plan.candidates(messy), fx.lexicon(spark)), posts)
    return rounded(ix.reattach_bucketed(spark, posts, sums))


# Scores


@query
def term_scores(spark, d):
    rows = terms.count_terms(fx.posts(spark, d), ["ord", "tweet_id"])
    return scoring.term_scores(rows, fx.lexicon(spark))


@query
def post_term_sums(spark, d):
    return scoring.sum_scores(term_scores(spark, d), fx.SCORE_COLUMNS)


@query
def score_posts(spark, d):
    return rounded(plan.score_posts(fx.messy_posts(spark, d), fx.lexicon(spark)))


@query
def score_posts_clean_reattach(spark, d):
    return rounded(plan.score_posts(fx.messy_posts(spark, d), fx.lexicon(spark), reattach="clean"))


@query
def score_posts_stored(spark, d):
    """Scored posts that a second call finds again."""
    root = scratch_path(spark, "store")
    for _ in range(2):
        found = stored(plan.score_posts, {"posts": fx.messy_posts(spark, d), "lexicon": fx.lexicon(spark)}, root, {"lang": "en"})
    return rounded(found)


def _extra_scored(spark, d) -> DataFrame:
    return plan.score_posts(
        fx.messy_posts(spark, d), fx.lexicon(spark), extra_lexicon=fx.extra_lexicon(spark), extra_driver="safety"
    )


@query
def score_posts_extra_driver(spark, d):
    return rounded(_extra_scored(spark, d))


# Series


def _series(spark, d, granularity) -> DataFrame:
    return rounded(plan.reputation_series(fx.messy_posts(spark, d), fx.lexicon(spark), granularity))


@query
def score_series_monthly(spark, d):
    return _series(spark, d, "Monthly")


@query
def series_weekly(spark, d):
    return _series(spark, d, "Weekly")


@query
def series_quarterly(spark, d):
    return _series(spark, d, "Quarterly")


@query
def series_yearly(spark, d):
    return _series(spark, d, "Yearly")


@query
def series_pooled_month(spark, d):
    return _series(spark, d, "month")


@query
def series_all_levels(spark, d):
    return rounded(series.series_all_levels(plan.score_posts(fx.messy_posts(spark, d), fx.lexicon(spark))))


@query
def series_shared(spark, d):
    """One scored table that four series read."""
    posts = fx.messy_posts(spark, d)
    scored = plan.shared(plan.score_posts(posts, fx.lexicon(spark)).drop("text"))
    parts = []
    for name in GRANULARITIES:
        periods = series.series(scored, name)
        parts.append(
            periods.agg(
                F.lit(name).alias("granularity"),
                F.count(F.lit(1)).alias("n_periods"),
                F.sum("total_tweets").alias("n_posts"),
                F.max("created_at").alias("last_at"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _half_states(spark, d) -> list[DataFrame]:
    scored = plan.score_posts(fx.messy_posts(spark, d), fx.lexicon(spark)).drop("text")
    return [written(state.period_state(scored.where(F.col("ord") % 2 == half)), "period-state") for half in (0, 1)]


@query
def series_merged_state(spark, d):
    """Two halves of the posts, each summed alone, then one series."""
    return rounded(state.series_of_state(state.merge_states(*_half_states(spark, d)), "Weekly"))


@query
def series_merged_moments(spark, d):
    """Months compared by moments that come from two sets of months."""
    months = state.period_scores(state.merge_states(*_half_states(spark, d)), "Monthly")
    months, cols = written(months, "months"), series.output_columns()
    known = state.merge_moments(*[state.moments(months.where(F.col("month") % 2 == half), cols) for half in (0, 1)])
    return rounded(state.z_scores_by_moments(months, cols, known))


@query
def series_streamed(spark, d):
    """Posts in three deliveries, each taken up by the stream where the last left off, then a series of the finished days."""
    posts = fx.messy_posts(spark, d).withColumn("tweet_id", F.col("ord") % 10_000_000)
    inbox, days, checkpoint = (scratch_path(spark, name) for name in ("stream-inbox", "stream-days", "stream-checkpoint"))
    late = posts.limit(1).select(
        F.lit(-1).cast("bigint").alias("tweet_id"), F.lit("2100-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.lit("this is the end of the day").alias("text"), F.lit("no").alias("retweet"), "source", F.lit(-1).cast("bigint").alias("ord"),
    )
    year = F.year("created_at")
    # The last delivery, a post of a day that never ends, closes all days before it.
    for part in (posts.where(year < 1994), posts.where(year.between(1994, 1995)), posts.where(year > 1995), late):
        part.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(part.schema).parquet(inbox)
        query = streaming.start_daily_sums(streaming.daily_sums(stream, fx.lexicon(spark)), days, checkpoint, availableNow=True)
        query.awaitTermination()
    return rounded(state.series_of_state(streaming.state_of_days(spark, days), "Weekly"))


@query
def series_extra_driver(spark, d):
    return rounded(series.series(_extra_scored(spark, d), "Monthly", extra_driver="safety"))


@query
def series_long(spark, d):
    monthly = plan.reputation_series(fx.messy_posts(spark, d), fx.lexicon(spark), "Monthly")
    return rounded(series.long_form(monthly, [series.TOTAL, "Value_Driver", "Brand_Driver"]))


@query
def series_plot(spark, d):
    monthly = plan.reputation_series(fx.messy_posts(spark, d), fx.lexicon(spark), "Monthly")
    return rounded(series.plot_columns(monthly, ["created_at", series.TOTAL]))


# Export


def _flagged(spark, d) -> DataFrame:
    return standardise.coerce_repost_flag(fx.messy_posts(spark, d))


@query
def export_rows(spark, d):
    return writers.csv_rows(_flagged(spark, d))


def _written_as(spark, d, filetype: str) -> str:
    path = scratch_path(spark, f"posts-{filetype}")
    writers.write_table(_flagged(spark, d), path, filetype)
    return path


@query
def export_csv(spark, d):
    types = {"tweet_id": "bigint", "created_at": "timestamp_ntz", "retweet": "boolean", "ord": "bigint"}
    return readers.read_posts_csv(spark, _written_as(spark, d, "CSV"), types, order_col="ord")


@query
def export_txt(spark, d):
    types = {"tweet_id": "bigint", "created_at": "timestamp_ntz", "retweet": "boolean", "ord": "bigint"}
    return readers.read_posts_csv(spark, _written_as(spark, d, "txt") + "/*.txt", types, order_col="ord")


@query
def export_parquet_naive(spark, d):
    # Read the events' times as instants first, so that the writer has a zone to remove.
    events = fx.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("naive"))
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("naive"))
    instants = events.select("event_id", F.timestamp_micros(micros).alias("created_at"))
    path = scratch_path(spark, "events-parquet")
    writers.write_table(instants, path, "parquet")
    return spark.read.parquet(path)
