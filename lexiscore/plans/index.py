"""Tables laid out for reuse: postings by term, so that another lexicon needs no text, and posts by id, so that sums join in place.

Both are written once, bucketed and sorted by the key of the later join, which then moves neither of them. A frequent word or
id is dealt over several buckets by a salt made from the row; the other side of the join repeats its few rows per salt.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscore.functions.language import LanguageModel
from lexiscore.functions.timestamps import calendar_parts
from lexiscore.operators.lexicons import check_lexicon, is_small, score_columns
from lexiscore.operators.scoring import sum_scores, with_scores
from lexiscore.operators.standardise import parse_created_at, text_digest
from lexiscore.operators.terms import count_terms
from lexiscore.plans.reputation import candidates
from lexiscore.session import scratch_path

BUCKETS = 64
SALTS = 8


@dataclass(frozen=True)
class Bucketed:
    """A bucketed table, by the name that the session knows it by."""

    name: str
    key: str
    buckets: int
    salts: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def drop(self, spark: SparkSession) -> None:
        """Forget the table; its files stay where they were written."""
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def write_bucketed(df: DataFrame, key: str, salt: Column, name: str, path: str | None = None, buckets: int = BUCKETS, salts: int = SALTS) -> Bucketed:
    """``df`` by ``key`` and ``salt``, a number below ``salts`` that tells rows of one key apart.

    Rows meet in the task of their bucket, so there is one file per bucket; ``path`` is a folder that all executors reach,
    by default under ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    salted = df.withColumn("_salt", salt).repartition(buckets, key, "_salt")
    salted.write.bucketBy(buckets, key, "_salt").sortBy(key, "_salt").option("path", path).format("parquet").saveAsTable(table)
    return Bucketed(table, key, buckets, salts)


def _of_row(*columns: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def _per_salt(df: DataFrame, salts: int) -> DataFrame:
    """Each row once per salt."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def postings(posts: DataFrame, lang: str | None = "en", model: LanguageModel | None = None, salts: int = SALTS) -> DataFrame:
    """``term, tweet_id, frequency, _salt``: a row per term of each text of an id.

    Copies of one text under one id are dropped before words are counted, so the many rows of words carry no digest, are not
    grouped again, and move once, to their buckets. Copies combine within a task before texts are shuffled.
    """
    rows = candidates(posts, lang, model).where(F.col("tweet_id").isNotNull())
    once = rows.select("tweet_id", "text", text_digest(F.col("text")).alias("digest")).dropDuplicates(["tweet_id", "digest"])
    salted = once.select("tweet_id", "text", _of_row("tweet_id", "digest", salts=salts).alias("_salt"))
    return count_terms(salted, ["tweet_id", "_salt"]).select("term", "tweet_id", "frequency", "_salt")


def index_posts(
    posts: DataFrame,
    lang: str | None = "en",
    model: LanguageModel | None = None,
    path: str | None = None,
    buckets: int = BUCKETS,
    salts: int = SALTS,
) -> Bucketed:
    """Postings of the posts that may be scored: ``term, tweet_id, frequency``, a row per term of each text of an id.

    Copies of one text under one id are one, reposts and other languages are left out, as in ``score_texts``; so are posts
    without an id. This is the only step that reads texts.
    """
    return write_bucketed(postings(posts, lang, model, salts), "term", F.col("_salt"), "postings", path, buckets, salts)


def indexed_sums(spark: SparkSession, index: Bucketed, lexicon: DataFrame, small: bool | None = None) -> DataFrame:
    """Score sums per post id, from postings and a lexicon alone; equal to ``score_texts`` over the indexed posts.

    A lexicon within the broadcast limits goes to the postings. A larger one is shuffled to their buckets, once per salt.
    """
    lexicon = check_lexicon(lexicon)
    columns = score_columns(lexicon)
    postings = index.read(spark)
    if is_small(lexicon) if small is None else small:
        hits = postings.join(F.broadcast(lexicon), "term")
    else:
        hits = postings.join(_per_salt(lexicon, index.salts).hint("merge"), ["term", "_salt"])
    return sum_scores(hits.select("tweet_id", *[(F.col("frequency") * F.col(c)).alias(c) for c in columns]), columns)


def bucket_posts(posts: DataFrame, path: str | None = None, buckets: int = BUCKETS, salts: int = SALTS) -> Bucketed:
    """Posts by id; posts without an id, which no sums belong to, are left out. ``ord`` tells the posts of an id apart."""
    return write_bucketed(posts.where(F.col("tweet_id").isNotNull()), "tweet_id", _of_row("ord", salts=salts), "posts", path, buckets, salts)


def bucket_sums(sums: DataFrame, like: Bucketed, path: str | None = None) -> Bucketed:
    """Sums per id in the buckets of ``like``, repeated per salt."""
    salted = _per_salt(sums, like.salts).withColumnRenamed("_salt", "_of")
    return write_bucketed(salted, "tweet_id", F.col("_of"), "sums", path, like.buckets, like.salts)


def reattach_bucketed(spark: SparkSession, posts: Bucketed, sums: Bucketed, extra_driver: str | None = None, fmt: str | None = None) -> DataFrame:
    """Posts with calendar, sums and scores, as ``score_posts`` with ``reattach="raw"`` gives them, without a shuffle."""
    left, right = posts.read(spark), sums.read(spark).drop("_of")
    joined = parse_created_at(left, fmt).join(right.hint("merge"), ["tweet_id", "_salt"])
    calendar = calendar_parts(F.col("created_at")) if "created_at" in left.columns else {}
    scores = [c for c in right.columns if c not in ("tweet_id", "_salt")]
    kept = [c for c in left.columns if c not in calendar and c != "_salt"]
    return with_scores(joined.withColumns(calendar).select(*kept, *calendar, *scores), "Brand_Reputation", extra_driver)
