"""Posts and lexicons built from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscore.config import sub_drivers
from lexiscore.operators.terms import explode_terms
from lexiscore.sources.readers import spread

SCORE_COLUMNS = [f"{s}_{side}" for s in sub_drivers() for side in ("pos", "neg")]
# One term per score column, in order.
TERMS = "the of and to a in is that it for was on with be by as this are at from tire worthless".split()
# Terms of special shape: term -> weights.
SPECIAL_TERMS = {
    "ther": {"price_pos": 1, "cool_neg": 1},  # two columns
    "he": {"trust_pos": 2},  # a weight above 1
    "an": {},  # no weight at all
    "by-nc": {"comm_pos": 1},  # hyphenated
    "erth": {"innov_neg": 1},  # also the stem of longer words
    "orant": {"exciting_neg": 1},  # a stem only
}
FLAG_TEXTS = ["True", " yes ", "1", "0", "no", "maybe", None, "1.0"]
FLAG_NUMBERS = [0.0, 1.0, 0.5, 2.0, None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def lexicon_rows() -> list[tuple]:
    weights = {term: {col: 1} for term, col in zip(TERMS, SCORE_COLUMNS)} | SPECIAL_TERMS
    return [(term, *[w.get(c, 0) for c in SCORE_COLUMNS]) for term, w in weights.items()]


def _literal_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    cells = [", ".join(f"'{v}'" if isinstance(v, str) else f"{v}L" for v in row) for row in rows]
    return spark.sql(f"SELECT * FROM VALUES ({'), ('.join(cells)}) AS t({', '.join(columns)})")


def lexicon(spark: SparkSession) -> DataFrame:
    return _literal_table(spark, lexicon_rows(), ["term", *SCORE_COLUMNS])


EXTRA_ROWS = [("the", 1, 0), ("of", 0, 1), ("he", 2, 0), ("by-nc", 0, 1), ("and", 1, 1), ("unseen", 1, 0)]


def extra_lexicon(spark: SparkSession) -> DataFrame:
    return _literal_table(spark, EXTRA_ROWS, ["term", "safety_pos", "safety_neg"])


def _cycle(values: list, by, kind: str):
    """The value at position ``by`` modulo the number of values."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.pmod(by, F.lit(len(values))).cast("int"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard posts: one per document, timed by the order of the same key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = docs.join(orders, docs.doc_id == orders.o_orderkey)
    hours = F.timestamp_add("HOUR", F.pmod("doc_id", F.lit(24)).cast("int"), F.col("o_orderdate").cast("timestamp_ntz"))
    return joined.select(
        F.col("doc_id").alias("tweet_id"), hours.alias("created_at"), "text", "source", F.col("doc_id").alias("ord")
    )


def messy_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with flags of many spellings, copies, flagged reposts, ids that own two texts, and missing times."""
    doc, copy = F.col("tweet_id"), F.col("copy")
    copies = F.explode(F.sequence(F.lit(0), F.when(doc % 5 == 0, 2).otherwise(0)))
    own_flag = _cycle(FLAG_TEXTS, doc, "string")
    return (
        posts(spark, sf_dir)
        .withColumn("copy", copies)
        .select(
            F.when(doc % 11 == 0, doc - 1).otherwise(doc).alias("tweet_id"),
            F.when(doc % 13 != 0, F.col("created_at")).alias("created_at"),
            F.when(copy == 2, F.concat(F.lit("RT "), F.col("text"))).otherwise(F.col("text")).alias("text"),
            F.when(copy == 1, "no").when(copy == 2, "TRUE").otherwise(own_flag).alias("retweet"),
            "source",
            (F.col("ord") + copy * 10_000_000).alias("ord"),
        )
    )


SHORTENED = {" the ": " th. ", " und ": " u. "}


def abbreviated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which two frequent words are shortened wherever spaces enclose them."""
    text = F.col("text")
    for word, short in SHORTENED.items():
        text = F.replace(text, F.lit(word), F.lit(short))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def reposted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without a flag, some of them marked by their first letters."""
    marked = F.when(F.col("tweet_id") % 7 == 0, F.concat(F.lit("RT "), F.col("text"))).otherwise(F.col("text"))
    return posts(spark, sf_dir).withColumn("text", marked)


def flag_numbers(by):
    return _cycle(FLAG_NUMBERS, by, "double")


def vocabulary_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon as large as the vocabulary of the documents."""
    terms = explode_terms(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["lang"])
    english = F.count(F.when(F.col("lang") == "en", 1))
    return terms.groupBy("term").agg(english.alias("cool_pos"), (F.count("*") - english).alias("cool_neg"))


def conversation_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon as large as the vocabulary of the conversations."""
    terms = explode_terms(table(spark, sf_dir, "conversations").select("role", "text"), ["role"])
    by_user = F.count(F.when(F.col("role") == "user", 1))
    return terms.groupBy("term").agg(by_user.alias("trust_pos"), (F.count("*") - by_user).alias("trust_neg"))
