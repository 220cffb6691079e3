"""Tables that are laid out for reuse: postings, bucketed posts."""

import pytest
from pyspark.sql import functions as F

from lexiscore.catalog import fixtures as fx
from lexiscore.operators import scoring
from lexiscore.plans import index as ix
from lexiscore.plans import reputation as plan
from lexiscore.plans.store import stored

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def posts(spark):
    df = fx.messy_posts(spark, SF_DIR)
    return df.unionAll(df.limit(3).select(F.lit(None).cast("long"), "created_at", "text", "retweet", "source", F.col("ord") + 10**9))


@pytest.mark.parametrize("salts", [1, 5])
def test_index_scores_without_texts(spark, posts, salts):
    index = ix.index_posts(posts, buckets=6, salts=salts)
    for small in (True, False):
        sums = ix.indexed_sums(spark, index, fx.lexicon(spark), small)
        assert rows(sums) == rows(scoring.score_texts(plan.candidates(posts), fx.lexicon(spark)))
        assert "text" not in plan_of(sums) and "documents" not in plan_of(sums)
    # Beyond broadcast, postings stay in their buckets: only the lexicon and the sums are shuffled.
    shown = plan_of(ix.indexed_sums(spark, index, fx.lexicon(spark), False))
    assert "SortMergeJoin" in shown and shown.count("Exchange hashpartitioning(term") <= 1
    assert shown.count("Exchange hashpartitioning(tweet_id") == 1
    index.drop(spark)
    assert not spark.catalog.tableExists(index.name)


def test_a_frequent_term_is_dealt_over_buckets(spark):
    hot = spark.range(4000).selectExpr("id AS tweet_id", "concat('the the ', id) AS text", "id AS ord")
    index = ix.index_posts(hot, lang=None, buckets=8, salts=8)
    found = index.read(spark).where("term = 'the'")
    assert found.count() == 4000 and found.agg(F.min("frequency")).first()[0] == 2
    per_file = [r["count"] for r in found.groupBy(F.input_file_name()).count().collect()]
    assert max(per_file) < 2500 and len(per_file) > 2


def test_words_of_an_index_move_once_and_without_digests(spark, posts):
    twice = spark.createDataFrame(
        [(1, "the the of"), (1, "the the of"), (1, "the to"), (2, "the the of"), (2, None), (2, ""), (None, "the")], "tweet_id long, text string"
    )
    index = ix.index_posts(twice.repartition(4), lang=None, buckets=2, salts=3)
    table = index.read(spark)
    assert set(table.columns) == {"term", "tweet_id", "frequency", "_salt"}
    found = sorted((r.term, r.tweet_id, r.frequency) for r in table.collect())
    assert found == [("of", 1, 1), ("of", 2, 1), ("the", 1, 1), ("the", 1, 2), ("the", 2, 2), ("to", 1, 1)]
    index.drop(spark)
    # Texts are shuffled by id and digest; their words are not shuffled or grouped before they go to their buckets.
    before_words = plan_of(ix.postings(posts)).split("Generate inline")
    assert len(before_words) == 2 and "Exchange" not in before_words[0] and "Aggregate" not in before_words[0]


def test_bucketed_reattach_has_no_exchange(spark, posts):
    by_id = ix.bucket_posts(posts, buckets=4, salts=3)
    sums = ix.bucket_sums(scoring.score_texts(plan.candidates(posts), fx.lexicon(spark)), by_id)
    joined = ix.reattach_bucketed(spark, by_id, sums)
    assert "SortMergeJoin" in plan_of(joined) and "Exchange" not in plan_of(joined)
    want = plan.score_posts(posts, fx.lexicon(spark))
    assert rows(joined.select(want.columns)) == rows(want)


def test_store_makes_each_result_once(spark, tmp_path):
    made = []

    def build(posts, lexicon, lang):
        made.append(lang)
        return plan.score_posts(posts, lexicon, lang=lang)

    def call(lang="en"):
        inputs = {"posts": spark.read.parquet(str(tmp_path / "posts")), "lexicon": spark.read.parquet(str(tmp_path / "lexicon"))}
        return rows(stored(build, inputs, str(tmp_path / "store"), {"lang": lang}))

    fx.messy_posts(spark, SF_DIR).write.parquet(str(tmp_path / "posts"))
    fx.lexicon(spark).write.parquet(str(tmp_path / "lexicon"))
    first = call()
    assert call() == first and made == ["en"]
    call("fr")
    assert made == ["en", "fr"]
    fx.lexicon(spark).where("term <> 'the'").write.mode("overwrite").parquet(str(tmp_path / "lexicon"))
    assert call() != first and made == ["en", "fr", "en"]
    # A table that its writer did not finish is made anew.
    unfinished = [p for p in (tmp_path / "store").iterdir() if p.name.startswith("build-")]
    assert len(unfinished) == 3
    for folder in unfinished:
        (folder / "_SUCCESS").rename(folder / "cut-off")
    call()
    assert len(made) == 4
