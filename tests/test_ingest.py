"""Columns, flags, times, order, files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexiscore import session
from lexiscore.functions import timestamps as ts
from lexiscore.operators import selection, standardise
from lexiscore.plans.ingest import prepare_posts, prepare_with_report
from lexiscore.sources import readers, writers


def at(text):
    return dt.datetime.fromisoformat(text)


def test_map_columns(spark):
    df = spark.createDataFrame([(1, "t", "x", "old")], "id int, time string, text string, tweet_id string")
    out = standardise.map_columns(df, tweet_id="id", created_at="time", text="text")
    assert out.columns == ["tweet_id", "created_at", "text"]
    assert out.first().tweet_id == 1
    swapped = standardise.map_columns(df, tweet_id="text", created_at="time", text="tweet_id").first()
    assert (swapped.tweet_id, swapped.text) == ("x", "old")
    with pytest.raises(ValueError, match="different"):
        standardise.map_columns(df, "id", "id", "text")
    assert standardise.missing_columns(df) == ["created_at"]


def test_first_n_by_filter_equals_top_n(spark, monkeypatch):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 100_003).alias("ord"), "id")
    want = sorted(r.ord for r in df.collect())[:1234]
    monkeypatch.setattr(standardise, "TOP_N_ROWS", 10)
    got = standardise.first_n(df, 1234)
    assert sorted(r.ord for r in got.collect()) == want
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert standardise.first_n(df, 9999).count() == 5000
    spaced = df.select((F.col("ord") * 10**12 - 5 * 10**16).alias("ord"))
    assert standardise.first_n(spaced, 1234).count() == 1234


@pytest.mark.parametrize(
    ("kind", "values", "want"),
    [
        ("string", [" YES ", "t", "1.0", "True\n", "\t1", "no", "maybe", None], [1, 0, 0, 1, 1, 0, 0, 0]),
        ("double", [0.5, -0.5, 1.0, -3.0, 0.0, float("nan"), None], [0, 0, 1, 1, 0, 0, 0]),
        ("int", [0, 1, 2, None], [0, 1, 1, 0]),
        ("boolean", [True, False, None], [1, 0, 0]),
        ("decimal(5,2)", ["0.99", "1.00"], [0, 1]),
    ],
)
def test_flags(spark, kind, values, want):
    raw = spark.createDataFrame([(i, None if v is None else str(v)) for i, v in enumerate(values)], "i int, v string")
    df = raw.select("i", F.col("v").cast(kind).alias("retweet"))
    got = standardise.coerce_repost_flag(df).orderBy("i").collect()
    assert [int(r.retweet) for r in got] == want


def test_inferred_flags(spark):
    df = spark.createDataFrame([("RT x",), ("rt x",), (None,), (" RT",)], "text string")
    assert [r.retweet for r in standardise.infer_repost_flag(df).collect()] == [True, False, False, False]
    assert not standardise.infer_repost_flag(df.drop("text").withColumn("a", F.lit(1))).first().retweet


def test_dedupe(spark):
    rows = [(3, "a", 1), (1, "a", 1), (2, "A", 1), (4, None, None), (5, None, None), (6, "a", 2)]
    df = spark.createDataFrame(rows, "ord int, text string, tweet_id int").repartition(3)
    assert sorted(r.ord for r in standardise.dedupe_keep_first(df).collect()) == [1, 2, 4, 6]


PATTERN_TEXTS = [
    "2024-03-09 07:05:03", "2024-03-09 07:05:03.25", "2024-03-09 07:05", "2024-03-09", "9/3/2024 7:05:03",
    "09/03/2024 07:05", "09/03/2024", "03/09/2024 07:05:03", "03/09/2024 07:05", "03/09/2024", "2024/03/09 07:05:03",
    "2024/03/09 07:05", "2024/03/09",
]


def test_patterns(spark):
    df = spark.range(1).select(
        *[ts.parse_pattern(F.lit(t), p).alias(str(i)) for i, (t, p) in enumerate(zip(PATTERN_TEXTS, ts.COMMON_PATTERNS))]
    )
    day = dt.datetime(2024, 3, 9)
    minute, second = day.replace(hour=7, minute=5), day.replace(hour=7, minute=5, second=3)
    fraction = second.replace(microsecond=250_000)
    want = [second, fraction, minute, day, second, minute, day, second, minute, day, second, minute, day]
    assert list(df.first()) == want
    bad = ["2024-02-30", "2024-03-09 25:00", "x2024-03-09", "2024-03-09x", "n/a", ""]
    misses = spark.range(1).select(*[ts.parse_best_effort(F.lit(t)).alias(t or "empty") for t in bad]).first()
    assert list(misses) == [None] * len(bad)


def test_iso_offsets_do_not_depend_on_the_session_zone(spark):
    texts = ["2024-03-10T02:30:00", "2024-03-10T02:30:00Z", "2024-03-10 02:30:00+02:00", "2024-03-10 02:30:00.5 -0500"]
    want = ["2024-03-10 02:30:00", "2024-03-10 02:30:00", "2024-03-10 00:30:00", "2024-03-10 07:30:00.5"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.range(1).select(*[ts.parse_iso(F.lit(t)).alias(t) for t in texts]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert list(row) == [at(w.replace(".5", ".500000")) for w in want]


def test_format_detection(spark):
    rows = [(i, f"{i % 28 + 1}/02/2023 10:00") for i in range(60)] + [(60, "n/a"), (61, None)]
    df = spark.createDataFrame(rows, "ord int, created_at string")
    local, fmt = standardise.normalise_created_at(df)
    assert fmt == "%d/%m/%Y %H:%M"
    assert local.where("ord = 3").first().created_at == dt.datetime(2023, 2, 4, 11, 0)
    assert standardise.parse_ratio(local).first().ok_ratio == pytest.approx(60 / 62)
    mixed = df.withColumn("created_at", F.when(F.col("ord") == 5, "n/a").otherwise(F.col("created_at")))
    assert standardise.detect_format(mixed) is None
    iso = df.withColumn("created_at", F.lit("2024-01-02T03:04:05Z"))
    assert standardise.detect_format(iso) == "inferred"
    unchanged, none = standardise.normalise_created_at(df.drop("created_at"))
    assert none is None and unchanged.columns == ["ord"]


def test_local_time_and_calendar(spark):
    rows = [("2024-03-31 01:30:00",), ("2024-12-30 12:00:00",), ("2021-01-03 12:00:00",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp_ntz").alias("created_at"))
    assert df.select(ts.to_local(F.col("created_at"))).first()[0] == at("2024-03-31 03:30:00")
    got = standardise.add_calendar(df).select("year", "quarter", "month", "week").collect()
    assert [tuple(r) for r in got[1:]] == [(2024, 4, 12, 1), (2021, 1, 1, 53), (None,) * 4]


def test_csv_round_trip(spark, tmp_path):
    text = 'a, "quoted"\nline two\r\nthree \\ end '
    rows = [(1, text, at("2024-01-02 03:04:05"), True, 0.5), (2, None, None, None, None), (3, " x ", None, False, 1e-7)]
    df = spark.createDataFrame(rows, "id int, text string, created_at timestamp_ntz, flag boolean, v double")
    types = {"id": "int", "created_at": "timestamp_ntz", "flag": "boolean", "v": "double"}
    for filetype, glob in (("CSV", "*.csv"), ("txt", "*.txt")):
        path = str(tmp_path / filetype)
        writers.write_table(df, path, filetype)
        back = readers.read_posts_csv(spark, f"{path}/{glob}", types, order_col="id").drop("ord")
        assert sorted(map(tuple, back.collect())) == sorted(rows)
    lines = {r.row for r in writers.csv_rows(df).collect()}
    assert "2,,,," in lines and "3, x ,,False,1.0E-7" in lines
    assert writers.csv_header(df) == "id,text,created_at,flag,v"
    with pytest.raises(ValueError, match="xlsx"):
        writers.write_table(df, str(tmp_path / "no"), "xlsx")


def test_missing_texts_and_bad_cells(spark, tmp_path):
    (tmp_path / "p.csv").write_text("tweet_id,text\n1,NA\nx,fine\n3,null\n", encoding="utf-8")
    df = readers.read_posts_csv(spark, str(tmp_path / "p.csv"), {"tweet_id": "bigint"})
    assert [(r.tweet_id, r.text) for r in df.orderBy("ord").collect()] == [(1, None), (None, "fine"), (3, None)]


def test_naive_parquet(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-07-01 12:00:00 UTC' AS created_at, timestamp_ntz'2024-07-01 12:00:00' AS n, 1 AS i")
    writers.write_table(df, str(tmp_path / "p"), "Parquet")
    back = spark.read.parquet(str(tmp_path / "p"))
    assert [f.dataType.typeName() for f in back.schema] == ["timestamp_ntz", "timestamp_ntz", "integer"]
    assert tuple(back.first())[:2] == (at("2024-07-01 14:00:00"), at("2024-07-01 12:00:00"))


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "l.csv").write_text("term,price_pos,price_neg\ncheap,1,\ncostly,0,2\n", encoding="utf-8")
    rows = readers.read_lexicon(spark, str(tmp_path / "l.csv")).orderBy("term").collect()
    assert [tuple(r) for r in rows] == [("cheap", 1, 0), ("costly", 0, 2)]


def test_spread_keeps_large_scans(spark, tmp_path):
    spark.range(0, 8, 1, 8).write.parquet(str(tmp_path / "many"))
    spark.range(0, 8, 1, 1).write.parquet(str(tmp_path / "one"))
    spark.conf.set("spark.sql.files.openCostInBytes", 10**9)
    try:
        many = spark.read.parquet(str(tmp_path / "many"))
        assert readers.spread(many) is many
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert readers.spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("n", [3, 4, 5, 6, 8, 20])
@pytest.mark.parametrize("small", [True, False])
def test_first_n_with_ties_and_nulls(spark, monkeypatch, n, small):
    monkeypatch.setattr(standardise, "TOP_N_ROWS", 100 if small else 1)
    values = [None, None, 1, 2, 2, 2, 3, 4]
    df = spark.createDataFrame([(v, i // 2) for i, v in enumerate(values)], "ord long, other long")
    got = [r.ord for r in standardise.first_n(df, n).collect()]
    want = ([1, 2, 2, 2, 3, 4] + [None, None])[:n]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_first_n_is_the_same_rows_either_way(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 7).alias("ord"), (F.col("id") % 50).alias("copy"))
    few = sorted(map(tuple, standardise.first_n(df, 900).collect()))
    monkeypatch.setattr(standardise, "TOP_N_ROWS", 1)
    assert sorted(map(tuple, standardise.first_n(df, 900).collect())) == few


ORDERS = {
    "string": "concat('k', cast(id * 7919 % 1009 as string))",
    "double": "case id % 11 when 0 then double('NaN') when 1 then -double('inf') when 2 then -0.0d when 3 then 0.0d else id * 7919 % 1009 / 8 end",
    "decimal": "cast(id * 7919 % 1009 / 7 as decimal(20, 6))",
    "time": "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 7919 % 1009 / 1000)",
    "date": "date_add(date'2024-01-01', cast(id * 7919 % 1009 as int))",
    "boolean": "id % 3 = 0",
    "binary": "unhex(lpad(hex(id * 7919 % 1009), 4, '0'))",
    "array": "array(id % 5, id % 7)",
}


@pytest.mark.parametrize("kind", ORDERS)
def test_first_n_by_any_order(spark, monkeypatch, kind):
    order = f"case when id % 13 <> 5 then {ORDERS[kind]} end"
    df = spark.range(0, 3000, 1, 5).selectExpr(f"{order} AS ord", "id % 2 AS tie", "id % 250 AS id")
    few = {n: sorted(map(str, standardise.first_n(df, n, ties=("tie",)).collect())) for n in ((1, 700, 1000) if kind == "double" else (700,))}
    monkeypatch.setattr(standardise, "TOP_N_ROWS", 0)
    monkeypatch.setattr(selection, "FEW", 200)
    monkeypatch.setattr(selection, "PIVOTS", 16)
    for n, want in few.items():
        got = standardise.first_n(df, n, ties=("tie",))
        assert sorted(map(str, got.collect())) == want and len(want) == n
    with pytest.raises(ValueError, match="without an order"):
        standardise.first_n(df.selectExpr("map(1, 2) AS ord"), 5)


def test_first_n_where_most_rows_share_a_key(spark, monkeypatch):
    monkeypatch.setattr(standardise, "TOP_N_ROWS", 0)
    monkeypatch.setattr(selection, "FEW", 10)
    values = ["m"] * 400 + [f"a{i}" for i in range(30)] + [f"z{i}" for i in range(30)]
    df = spark.createDataFrame([(v,) for v in values], "ord string").repartition(4)
    for n in (20, 30, 31, 430, 431, 459):
        assert sorted(r.ord for r in standardise.first_n(df, n).collect()) == sorted(values)[:n]


def test_flags_of_numbers_in_a_csv(spark, tmp_path):
    (tmp_path / "posts.csv").write_text("tweet_id,created_at,text,retweet\n1,2024-01-01,a,1.0\n2,2024-01-01,b,0.0\n3,2024-01-01,c,\n4,2024-01-01,d,2\n")
    raw = readers.read_posts_csv(spark, str(tmp_path / "posts.csv"))
    kept = standardise.drop_reposts(prepare_posts(raw))
    assert sorted(r.tweet_id for r in kept.collect()) == [2, 3]
    (tmp_path / "words.csv").write_text("tweet_id,created_at,text,retweet\n1,2024-01-01,a,1.0\n2,2024-01-01,b,yes\n")
    words = readers.read_posts_csv(spark, str(tmp_path / "words.csv"))
    assert dict(words.dtypes)["retweet"] == "string"


def test_read_posts_parquet(spark, tmp_path):
    spark.range(10).withColumn("text", F.lit("x")).write.parquet(str(tmp_path / "p"))
    posts = readers.read_posts_parquet(spark, str(tmp_path / "p"), order_col="id")
    assert sorted(r.ord for r in posts.collect()) == list(range(10))


TIMES = [
    ("Wed Oct 10 20:19:24 +0000 2018", "2018-10-10 20:19:24"),
    ("Oct 10, 2018", "2018-10-10 00:00:00"),
    ("10 October 2018 14:00", "2018-10-10 14:00:00"),
    ("Wed, 10 Oct 2018 20:19:24 +0200", "2018-10-10 18:19:24"),
    ("20240131", "2024-01-31 00:00:00"),
    ("01/31/2024 02:15 PM", "2024-01-31 14:15:00"),
    ("31/01/2024 12:15 AM", "2024-01-31 00:15:00"),
    ("31-01-2024", "2024-01-31 00:00:00"),
    ("31.01.2024 10:00", "2024-01-31 10:00:00"),
    ("32.01.2024", None),
    ("20241331", None),
    ("Oct 10 25:00:00 2018", None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_inferred_times(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(TIMES, "t string, want string")
        got = df.select(F.date_format(ts.parse_inferred(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("got"), "want").collect()
        assert [r.got for r in got] == [r.want for r in got]
        # An hour that the zone leaves out in spring.
        gap = spark.createDataFrame([("10-03-2024 02:30",)], "t string").select(ts.parse_timestamp(F.col("t"), "dd-MM-yyyy HH:mm"))
        assert str(gap.first()[0]) == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_epochs_need_a_unit(spark):
    df = spark.createDataFrame([(1_700_000_000,)], "created_at long")
    with pytest.raises(ValueError, match="epoch_unit"):
        standardise.parse_created_at(df)
    for unit, factor in (("s", 1), ("ms", 1000), ("us", 10**6), ("ns", 10**9)):
        moved = df.withColumn("created_at", F.col("created_at") * factor)
        assert str(standardise.parse_created_at(moved, epoch_unit=unit).first()[0]) == "2023-11-14 22:13:20"


def test_report_of_a_format_that_does_not_hold(spark):
    rows = [(i, f"2024-01-{i % 28 + 1:02d}", "x") for i in range(25)] + [(i, "n/a", "x") for i in range(25, 50)]
    raw = spark.createDataFrame(rows, "tweet_id long, created_at string, text string").withColumn("ord", F.col("tweet_id"))
    report = prepare_with_report(raw)
    assert (report.fmt, report.ratio.first()[0]) == ("inferred", 0.5)
    assert prepare_with_report(raw, sample_rows=None).fmt is None


def test_scratch_tables_go_when_asked(spark):
    import os

    table = session.written(spark.range(3), "t")
    (path,) = {os.path.dirname(f) for f in table.inputFiles()}
    assert os.path.isdir(path.removeprefix("file:").replace("//", "/"))
    assert session.clear_scratch(spark) >= 1
    assert not os.path.isdir(path.removeprefix("file:").replace("//", "/"))


@pytest.mark.parametrize(
    ("texts", "order"),
    [
        (["03/04/2024", "05/06/2024 10:00", "13/01/2024"], "day"),
        (["03/04/2024", "05.06.2024", "01/13/2024 02:15 PM"], "month"),
        (["03/04/2024", "n/a", None, "2024-13-01"], "day"),
        (["13/01/2024", "01/13/2024", "14.02.2024"], "day"),
        (["31/31/2024", "2-14-2024"], "month"),
    ],
)
def test_a_column_has_one_order_of_day_and_month(spark, texts, order):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord long, created_at string")
    assert standardise.date_order(df) == order
    got = [r.created_at for r in standardise.normalise_created_at(df, zone="UTC")[0].orderBy("ord").collect()]
    for text, read in zip(texts, got):
        first, second = (text or "").replace(".", "/").replace("-", "/").split("/")[:2] if (text or "")[2:3] in "/.-" and text else (None, None)
        if first and len(first) <= 2 and read is not None:
            assert (read.day, read.month) == ((int(first), int(second)) if order == "day" else (int(second), int(first)))
    if texts[0] == "03/04/2024":
        assert got[0] == (at("2024-04-03") if order == "day" else at("2024-03-04"))


def test_types_of_all_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "a,b,c,d,e,f,g\n 1 ,1.5,2024-01-31 10:00:00,x,,007,12345678901234567890\n-2,1e3,2024-02-01,2,,8,1\nNA,.5,,3,,+9,2\n"
    )
    got = readers.read_posts_csv(spark, str(tmp_path / "t.csv"))
    assert dict(got.drop("ord").dtypes) == {
        "a": "bigint", "b": "double", "c": "timestamp_ntz", "d": "string", "e": "string", "f": "bigint", "g": "double",
    }
    assert sorted(str(r.a) for r in got.collect()) == ["-2", "1", "None"] and sorted(r.f for r in got.collect()) == [7, 8, 9]
    plain = readers.read_posts_csv(spark, str(tmp_path / "t.csv"), infer=False)
    assert set(dict(plain.drop("ord").dtypes).values()) == {"string"}
    some = readers.read_posts_csv(spark, str(tmp_path / "t.csv"), {"f": "string"}, infer=True)
    assert dict(some.dtypes)["f"] == "string" and dict(some.dtypes)["a"] == "bigint"


def test_pivots_are_searched_by_halves(spark):
    rows = [(i % 97 if i % 5 else None, float("nan") if i % 11 == 0 else i / 7, f"t{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b double, c string")
    keys = df.select(selection.ordered_key(df, ["a", "b", "c"]).alias("key")).distinct()
    for n in (1, 2, 3, 31, 63, selection.PIVOTS):
        pivots = keys.orderBy(F.xxhash64("key")).limit(n).agg(F.sort_array(F.collect_list("key")).alias("pivots"))
        got = keys.crossJoin(pivots).select(
            selection._interval(F.col("pivots"), F.col("key")).alias("got"),
            (2 * F.size(F.filter("pivots", lambda p: p < F.col("key"))) + F.array_contains("pivots", F.col("key")).cast("int")).alias("want"),
        )
        assert got.where("got <> want OR got IS NULL").count() == 0
    # One comparison per halving, not one per pivot.
    assert "filter" not in str(selection._interval(F.col("pivots"), F.col("key")))
