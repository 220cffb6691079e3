"""Scores and series: hand results, options, skew, plan shape."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from lexiscore.catalog import fixtures as fx
from lexiscore.operators import lexicons, scoring, series
from lexiscore.operators.standardise import dedupe_keep_first
from lexiscore.plans import reputation as plan

LEXICON = [("good", {"price_pos": 1}), ("bad", {"price_neg": 2}), ("cool", {"cool_pos": 1, "trust_neg": 1}), ("plain", {}),
           ("cut-edg", {"innov_pos": 1}), ("run", {"exciting_pos": 1})]


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [(term, *[w.get(c, 0) for c in fx.SCORE_COLUMNS]) for term, w in LEXICON]
    return spark.createDataFrame(rows, "term string, " + ", ".join(f"{c} bigint" for c in fx.SCORE_COLUMNS))


def posts(spark, rows):
    full = [(i, tid, None if when is None else dt.datetime.fromisoformat(when), text, rt)
            for i, (tid, when, text, rt) in enumerate(rows)]
    return spark.createDataFrame(
        full, "ord bigint, tweet_id bigint, created_at timestamp_ntz, text string, retweet string"
    )


ROWS = [
    (1, "2024-12-30 10:00:00", "The good, the GOOD and the bad of it", "no"),
    (1, "2024-12-31 10:00:00", "The good, the GOOD and the bad of it", "yes"),  # repost of post 1
    (1, "2025-01-01 10:00:00", "The good, the GOOD and the bad of it", "no"),  # copy of post 1
    (2, "2024-12-30 11:00:00", "the cat was with it", "no"),  # no lexicon term
    (3, None, "the plain one is it", "no"),  # only a term without weights; no time
    (4, "2024-11-01 00:00:00", "that is cool", "no"),
    (4, "2024-11-02 00:00:00", "that is cut-edg", "no"),  # same id, other text
    (5, "2024-11-03 00:00:00", "le bad est dans la rue", "no"),  # French
    (6, "2024-11-03 00:00:00", "", "no"),
    (7, "2024-11-03 00:00:00", None, "no"),
    (None, "2024-11-03 00:00:00", "the good", "no"),  # no id
    (8, "2024-10-03 00:00:00", "he was running to the bad cheap//good", "no"),
]


def test_raw_reattach(spark, lexicon):
    got = plan.score_posts(posts(spark, ROWS), lexicon).orderBy("ord").collect()
    assert [r.ord for r in got] == [0, 1, 2, 4, 5, 6, 11]
    first = got[0]
    assert (first.price_pos, first.price_neg, first.price_net) == (2, 2, 0)
    assert (first.year, first.quarter, first.month, first.week) == (2024, 4, 12, 1)
    assert first.text == ROWS[0][2]
    assert {got[0].price_pos, got[1].price_pos, got[2].price_pos} == {2}
    assert got[3].Brand_Reputation == 0.0 and got[3].year is None
    for row in got[4:6]:  # both texts of id 4 together, on each row
        assert (row.cool_pos, row.trust_neg, row.innov_pos) == (1, 1, 1)
        assert row.Brand_Driver == pytest.approx(2 / 4) and row.Relationship_Driver == pytest.approx(-1 / 4)
        assert row.Brand_Reputation == pytest.approx(1 / 4)
    assert got[6].price_net == -2 and got[6].exciting_pos == 0


def test_clean_reattach_and_stems(spark, lexicon):
    clean = plan.score_posts(posts(spark, ROWS), lexicon, reattach="clean").orderBy("ord").collect()
    assert [r.ord for r in clean] == [0, 4, 5, 6, 11]
    stemmed = plan.score_posts(posts(spark, ROWS), lexicon, match_on="stem").where("tweet_id = 8").first()
    assert (stemmed.exciting_pos, stemmed.price_neg) == (1, 2)


def test_term_rows(spark):
    got = plan.term_rows(posts(spark, ROWS[:2])).collect()
    assert {(r.term, r.frequency) for r in got} == {
        ("the", 3), ("good", 2), (",", 1), ("and", 1), ("bad", 1), ("of", 1), ("it", 1),
    }
    assert list(got[0].asDict()) == ["ord", "tweet_id", "created_at", "term", "frequency"]
    assert {r.text for r in plan.clean_texts(posts(spark, ROWS[:2])).collect()} == {ROWS[0][2].lower()}
    assert {r.text for r in plan.term_rows(posts(spark, ROWS[:2]), with_text=True).collect()} == {ROWS[0][2].lower()}
    words = plan.term_rows(posts(spark, ROWS[:2]), punctuation=False)
    assert "," not in {r.term for r in words.collect()}


def test_posts_without_optional_columns(spark, lexicon):
    df = posts(spark, ROWS).drop("retweet")
    assert plan.score_posts(df, lexicon).count() == 7
    assert plan.term_rows(df.drop("text")).count() == 0
    bare = df.drop("created_at", "ord")
    assert plan.score_posts(bare, lexicon).count() == 7
    assert plan.term_rows(bare).where("created_at is null").count() > 0


def test_extra_lexicon_and_driver(spark, lexicon):
    extra = spark.createDataFrame([("good", 3, 0), ("cool", 0, 1), ("new", 1, 1)], "term string, safety_pos int, safety_neg int")
    assert lexicons.merge_lexicons(lexicon, extra).count() == 2
    assert lexicons.merge_lexicons(lexicon, extra, how="full").where("term = 'new'").first().price_pos == 0
    with pytest.raises(ValueError, match="price_pos"):
        lexicons.merge_lexicons(lexicon, lexicon)
    got = plan.score_posts(posts(spark, ROWS), lexicon, extra_lexicon=extra, extra_driver="safety").where("ord = 0").first()
    assert (got.safety_net, got.safety_Driver, got.price_neg) == (6, 6.0, 0)
    assert got.Brand_Reputation == pytest.approx(2 / 3 + 6)
    missing = plan.score_posts(posts(spark, ROWS), lexicon, extra_driver="safety")
    assert missing.first().safety_net == 0
    with pytest.raises(ValueError, match="safety_pos"):
        series.series(missing, "Weekly", "safety")
    with pytest.raises(ValueError, match="price"):
        plan.score_posts(posts(spark, ROWS), lexicon, extra_driver="price").count()


def test_lexicon_checks(spark, lexicon):
    assert lexicons.free_of_substring(lexicon.select("term", "price_pos"), "_neg")
    assert not lexicons.free_of_substring(lexicon, "_neg")
    assert lexicons.unpaired_columns(lexicon.drop("cool_neg")) == ["cool_pos"]
    for wrong in (lexicon.drop("term"), lexicon.withColumn("price_pos", F.lit("x"))):
        with pytest.raises(ValueError):
            lexicons.check_lexicon(wrong)


def test_fractional_and_missing_weights(spark):
    lex = spark.createDataFrame([("good", 0.5, None), ("good", 1.0, 0.25), ("bad", None, None)],
                                "term string, price_pos double, price_neg double")
    got = {r.ord: r for r in plan.score_posts(posts(spark, ROWS), lex).collect()}
    assert (got[0].price_pos, got[0].price_neg) == (3.0, 0.5)  # a repeated term counts twice
    assert got[0].cool_net == 0
    assert (got[11].price_pos, got[11].price_net) == (0.0, 0.0)


def test_series(spark, lexicon):
    scored = plan.shared(plan.score_posts(posts(spark, ROWS), lexicon))
    weekly = series.series(scored, "Weekly").collect()
    # One ISO week on both sides of the year's end is two periods.
    assert [(r.year, r.quarter, r.month, r.week, r.total_tweets) for r in weekly] == [
        (2024, 4, 10, 40, 1), (2024, 4, 11, 44, 2), (2024, 4, 12, 1, 2), (2025, 1, 1, 1, 1),
    ]
    assert weekly[2].created_at == dt.datetime(2024, 12, 30, 10)
    price = [-2, 0, 0, 0]
    mean, spread = -0.5, 1.0
    assert [r.price_net for r in weekly] == pytest.approx([(p - mean) / spread for p in price])
    assert {r.goodsq_net for r in weekly} == {0.0}
    assert series.series(scored, ["year"]).columns[:3] == ["year", "created_at", "total_tweets"]
    assert series.series(scored, ["year"]).columns[3:] == series.output_columns()
    pooled = series.series(scored, "month").collect()
    assert sorted(r.month for r in pooled) == [1, 10, 11, 12]
    single = series.series(scored.where("year = 2025"), "Yearly").first()
    assert {single[c] for c in series.output_columns()} == {0.0}
    with pytest.raises(ValueError, match="granularity"):
        series.series(scored, "tweet_id")
    scored.unpersist()


def test_levels_agree(spark):
    scored = plan.score_posts(fx.messy_posts(spark, "/root/testdata/sf0.001"), fx.lexicon(spark))
    levels = series.series_all_levels(scored).toPandas()
    assert levels.groupby("granularity").total_tweets.sum().nunique() == 1
    for name, part in levels.groupby("granularity"):
        alone = series.series(scored, name).toPandas()
        assert len(alone) == len(part)
        mean, spread = part["Brand Reputation"].mean(), part["Brand Reputation"].std()
        assert mean == pytest.approx(0, abs=1e-9) and spread == pytest.approx(1)


def test_result_does_not_depend_on_partitions_or_row_order(spark):
    df = fx.messy_posts(spark, "/root/testdata/sf0.001")
    results = [
        plan.reputation_series(part, fx.lexicon(spark), "Monthly").toPandas().round(9)
        for part in (df, df.repartition(7), df.orderBy(F.desc("ord")).coalesce(1))
    ]
    assert results[0].equals(results[1]) and results[0].equals(results[2])


def test_large_lexicon_gives_the_same_sums(spark, monkeypatch):
    rows = plan.candidates(fx.messy_posts(spark, "/root/testdata/sf0.001"))
    small = sorted(map(tuple, scoring.score_texts(rows, fx.lexicon(spark)).collect()))
    monkeypatch.setattr(lexicons, "BROADCAST_ROWS", 3)
    assert not lexicons.is_small(fx.lexicon(spark))
    large = scoring.score_texts(rows, fx.lexicon(spark))
    assert sorted(map(tuple, large.collect())) == small
    assert "BroadcastHashJoin [term" not in large._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows are copies of one post, another third share one id."""
    return spark.range(0, 30_000, 1, 6).select(
        F.col("id").alias("ord"),
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 2).otherwise(F.col("id")).alias("tweet_id"),
        F.lit("2024-05-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("id") % 3 == 0, "the good of it").otherwise(F.concat(F.lit("the good and bad "), "id")).alias("text"),
    )


def test_skew_is_combined_before_each_shuffle(spark, lexicon, skewed):
    sums = {r.tweet_id: r for r in scoring.score_texts(plan.candidates(skewed), lexicon).where("tweet_id < 3").collect()}
    assert (sums[1].price_pos, sums[2].price_pos, sums[2].price_neg) == (1, 10_001, 20_002)
    plan_text = dedupe_keep_first(skewed)._jdf.queryExecution().executedPlan().toString()
    exchange = plan_text.index("Exchange hashpartitioning")
    assert "Partial" in plan_text[exchange:], "copies must be dropped in each task before the shuffle"
    assert dedupe_keep_first(skewed).count() == 20_001
    scored = plan.score_posts(skewed, lexicon)
    assert scored.count() == 30_000
    assert series.series(scored, "Yearly").first().total_tweets == 30_000


def test_scores_do_not_need_a_row_order(spark, lexicon, skewed):
    want = scoring.score_texts(skewed, lexicon).orderBy("tweet_id").collect()
    for order in (F.lit(0).cast("bigint"), F.rand().cast("bigint")):
        assert scoring.score_texts(skewed.withColumn("ord", order), lexicon).orderBy("tweet_id").collect() == want
    text = scoring.score_texts(skewed, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in "".join(line for line in text.splitlines() if "Exchange hashpartitioning" in line)


def test_hot_id_is_split_in_the_join(spark, lexicon, skewed):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        scored = plan.score_posts(skewed, lexicon)
        assert scored.count() == 30_000
        joined = scored.select("ord", "price_net")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_plan_shape(spark, lexicon):
    # The language model is the one step in Python, once where texts are read; all else stays in the JVM.
    for lang, python in (("en", 1), (None, 0)):
        monthly = plan.reputation_series(fx.messy_posts(spark, "/root/testdata/sf0.001"), lexicon, "Monthly", lang=lang)
        text = monthly._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text and text.count("EvalPython") == python
        assert "BatchEvalPython" not in text and "MapInArrow" not in text
    terms = plan.count_terms(fx.table(spark, "/root/testdata/sf0.001", "documents"), ["doc_id"])
    assert terms._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 0


def test_plot_and_long_form(spark, lexicon):
    monthly = plan.reputation_series(posts(spark, ROWS), lexicon, "Monthly")
    assert series.plot_columns(monthly).columns == [series.TOTAL]
    long = series.long_form(monthly, [series.TOTAL, "Value_Driver"])
    assert long.columns == ["year", "quarter", "month", "created_at", "driver", "score"]
    assert long.count() == 2 * monthly.count()


def test_stems_are_made_above_the_distinct(spark, lexicon):
    forms = plan.stem_vocabulary(posts(spark, ROWS)).join(lexicon.withColumnRenamed("term", "stem"), "stem")
    lines = forms._jdf.queryExecution().executedPlan().toString().splitlines()
    python = [i for i, line in enumerate(lines) if "ArrowEvalPython" in line]
    assert len(python) == 1
    # Parents come first in the listing.
    assert all(i > python[0] for i, line in enumerate(lines) if "HashAggregate" in line)


def test_large_lexicon_is_joined_by_shuffle(spark, lexicon):
    rows = plan.candidates(posts(spark, ROWS))
    large = scoring.score_texts(rows, lexicon, small=False)
    assert "BroadcastHashJoin [term" not in large._jdf.queryExecution().executedPlan().toString()
    small = scoring.score_texts(rows, lexicon, small=True)
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))


def test_term_filter_keeps_all_lexicon_terms(spark, monkeypatch):
    words = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("term"))
    known = words.where(F.col("term").endswith("0")).withColumn("cool_pos", F.lit(1))
    kept = lexicons.drop_unknown(words, known)
    assert kept.join(known, "term").count() == 2_000
    assert kept.count() < 2_000 + 18_000 * 0.05
    assert lexicons.drop_unknown(words, known.limit(0)).count() == 0
    monkeypatch.setattr(lexicons, "MAX_BLOCKS", 100)  # 20 terms in each block: a weaker filter, all terms still pass
    kept = lexicons.drop_unknown(words, known)
    assert kept.join(known, "term").count() == 2_000 and kept.count() < 18_000
    monkeypatch.setattr(lexicons, "MAX_BLOCKS", 10)
    assert lexicons.drop_unknown(words, known) is words


def test_clean_reattach_moves_each_text_once(spark, lexicon):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clean = plan.score_posts(posts(spark, ROWS), lexicon, reattach="clean", small=True)
        listing = spark._jvm.PythonSQLUtils.explainString(clean._jdf.queryExecution(), "formatted")
        rows = clean.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [part for part in listing.split("\n\n") if re.match(r"\s*\(\d+\) Exchange\b", part) and "text#" in part]
    assert len(moved) == 1
    assert len(rows) == len({r.ord for r in rows})


def test_z_scores_do_not_depend_on_the_unit(spark):
    rows = [(1.0,), (3.0,), (7.0,)]
    for factor in (1.0, 1e-13, 1e13):
        df = spark.createDataFrame([(x * factor,) for (x,) in rows], "v double")
        got = sorted(r.v for r in series.z_scores(df, ["v"]).collect())
        assert got == pytest.approx([-0.8729, -0.2182, 1.0911], abs=1e-3)
    equal = spark.createDataFrame([(0.1 + 0.2,), (0.3,)], "v double")
    assert [r.v for r in series.z_scores(equal, ["v"]).collect()] == [0.0, 0.0]


def test_clean_reattach_without_an_order(spark, lexicon):
    table = posts(spark, [r for r in ROWS if r[0] is not None and r[3] == "no"]).drop("ord")
    got = plan.score_posts(table, lexicon, reattach="clean")
    want = plan.score_posts(posts(spark, [r for r in ROWS if r[0] is not None and r[3] == "no"]), lexicon, reattach="clean")
    key = lambda r: (r.tweet_id, r.text, r.Brand_Reputation)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert "monotonically_increasing_id" not in got._jdf.queryExecution().executedPlan().toString()


def test_plot_without_a_time(spark):
    df = spark.createDataFrame([(2024, 3, 1.0), (2023, 4, 2.0), (2024, 1, 3.0)], "year int, month int, score double")
    assert [r.score for r in series.plot_columns(df, ["score"]).collect()] == [2.0, 3.0, 1.0]
    assert series.plot_columns(df.select("score"), ["score"]).count() == 3
