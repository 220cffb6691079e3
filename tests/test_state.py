"""Period state, moments, and streamed scores."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexiscore.catalog import fixtures as fx
from lexiscore.operators import series, state
from lexiscore.plans import reputation as plan
from lexiscore.streaming import scores as streaming

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    df = plan.score_posts(fx.messy_posts(spark, SF_DIR), fx.lexicon(spark)).drop("text").cache()
    yield df
    df.unpersist()


def near(a, b):
    return a == b or (isinstance(a, float) and a == pytest.approx(b, abs=1e-9))


def same_rows(got, want):
    assert got.columns == want.columns
    a, b = got.collect(), want.collect()
    assert len(a) == len(b) and all(near(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.mark.parametrize("granularity", ["Weekly", "Monthly", "Yearly", "month"])
def test_merged_states_give_the_series(scored, granularity):
    parts = [state.period_state(scored.where(F.pmod(F.hash("ord"), F.lit(3)) == i)) for i in range(3)]
    merged = state.merge_states(state.merge_states(parts[2], parts[0]), parts[1])
    same_rows(state.series_of_state(merged, granularity), series.series(scored, granularity))


def test_merged_moments_equal_one_pass(spark):
    rows = [(float(i % 17) * 1e3 + 1e7, 5.0, None if i % 3 else float(i)) for i in range(200)] + [(None, 5.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double").withColumn("part", F.monotonically_increasing_id() % 4)
    cols = ["a", "b", "c"]
    parts = [state.moments(df.where(F.col("part") == i), cols) for i in range(4)]
    merged = {r.column_name: r for r in state.merge_moments(state.merge_moments(*parts[:3]), parts[3]).collect()}
    for r in state.moments(df, cols).collect():
        m = merged[r.column_name]
        assert m.n == r.n and m.most == r.most
        assert m["mean"] == pytest.approx(r["mean"], rel=1e-13) and m.m2 == pytest.approx(r.m2, rel=1e-9, abs=1e-9)
    z = state.z_scores_by_moments(df, ["a", "b"], state.merge_moments(*parts))
    want = series.z_scores(df.select("part", "a", "b").where("a is not null"), ["a"]).collect()
    got = z.where("a is not null").collect()
    assert sorted(r.a for r in got) == pytest.approx(sorted(r.a for r in want)) and {r.b for r in got} == {0.0}


def test_stream_counts_copies_once_and_late_posts_never(spark, tmp_path):
    day = lambda text: dt.datetime.fromisoformat(text)
    lexicon = spark.createDataFrame([("good", 1, 0), ("bad", 0, 1)], "term string, cool_pos long, cool_neg long")
    deliveries = [
        [(1, 1, day("2024-03-01 10:00:00"), "the good one is good", "no"), (2, 1, day("2024-03-01 10:00:00"), "the good one is good", "no"),
         (3, 2, day("2024-03-01 09:00:00"), "the bad one", "no"), (4, 3, day("2024-03-02 09:00:00"), "the bad good one", "yes")],
        [(5, 1, day("2024-03-01 10:00:00"), "the good one is good", "no"), (6, 1, day("2024-03-02 10:00:00"), "the good one is it", "no"),
         (7, None, day("2024-03-02 10:00:00"), "the good one", "no"), (8, 9, None, "the good one", "no")],
        [(9, 4, day("2024-03-20 10:00:00"), "the bad one is bad", "no"), (10, 5, day("2024-03-20 10:00:00"), "nothing of it is here", "no")],
        [(11, 6, day("2024-03-01 12:00:00"), "the good one came late", "no"), (12, 7, day("2024-04-20 10:00:00"), "that is the end of it", "no")],
        [(13, 8, day("2024-06-20 10:00:00"), "that is the end of it", "no")],
    ]
    schema = "ord long, tweet_id long, created_at timestamp_ntz, text string, retweet string"
    inbox, days, checkpoint = (str(tmp_path / name) for name in ("in", "days", "checkpoint"))
    for rows in deliveries:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        streaming.start_daily_sums(streaming.daily_sums(stream, lexicon), days, checkpoint, availableNow=True).awaitTermination()
    got = sorted((str(r.day), r.total_tweets, r.cool_pos, r.cool_neg) for r in spark.read.parquet(days).collect())
    assert got == [("2024-03-01", 2, 2, 1), ("2024-03-02", 1, 1, 0), ("2024-03-20", 1, 0, 2)]
    weeks = streaming.state_of_days(spark, days).orderBy("created_at").collect()
    assert [(r.week, r.total_tweets, r.cool_pos) for r in weeks] == [(9, 3, 3), (12, 1, 0)]
    assert weeks[0].created_at == day("2024-03-01 10:00:00")
