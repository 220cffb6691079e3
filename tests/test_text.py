"""Tokens, language and stems."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiscore.catalog import oracle
from lexiscore.functions import language
from lexiscore.functions.language import detect_language
from lexiscore.functions.stemming import STEP_2, STEP_3, STEP_4, stem, stem_joined, stem_word
from lexiscore.functions.tokens import tokens
from lexiscore.operators import abbreviations
from lexiscore.session import ARROW_BYTES

TOKEN_CASES = {
    "Can't stop! #Cool": ["ca", "n't", "stop", "!", "#", "cool"],
    "http://cheap.com deal2day good/bad, 1,000 it's cut-edg. End": [
        "http", ":", "//cheap.com", "deal2day", "good/bad", ",", "1,000", "it", "'s", "cut-edg", ".", "end",
    ],
    'He said "hi there." (Really?)': ["he", "said", "``", "hi", "there", ".", "''", "(", "really", "?", ")"],
    "'Tis cannot 'quoted' o'clock dogs' a--b wait...": [
        "'t", "is", "can", "not", "'quoted", "'", "o'clock", "dogs", "'", "a", "--", "b", "wait", "...",
    ],
    "at 3:30 foo:bar std::vector": ["at", "3:30", "foo", ":", "bar", "std", ":", ":vector"],
    "shouldn't've don't.": ["shouldn't", "'ve", "do", "n't", "."],
    "(etc.), v1.2.3 u.s. gonna": ["(", "etc.", ")", ",", "v1.2.3", "u.s", ".", "gon", "na"],
    "a b\tc\nd": ["a", "b", "c", "d"],
    "": [],
    " \n ": [],
}


def test_token_cases(spark):
    df = spark.createDataFrame([(text,) for text in TOKEN_CASES], "text string")
    got = {r.text: r.t for r in df.select("text", tokens(F.col("text")).alias("t")).collect()}
    assert got == TOKEN_CASES


def test_abbreviations_keep_their_period(spark):
    cases = {
        "Dr. No met Mr. X at 5 p.m. in the U.S.": ["dr.", "no", "met", "mr", ".", "x", "at", "5", "p.m.", "in", "the", "u.s."],
        '(etc.) "said etc." and so on etc .': ["(", "etc.", ")", "``", "said", "etc.", "''", "and", "so", "on", "etc", "."],
        "etc.. etc... Dr.": ["etc", "..", "etc", "...", "dr."],
        ". ends .": [".", "ends", "."],
        "": [],
    }
    df = spark.createDataFrame([(text,) for text in cases] + [(None,)], "text string")
    known = ["dr", "p.m", "u.s", "etc"]
    got = {r.text: r.t for r in df.select("text", tokens(F.col("text"), known).alias("t")).collect()}
    assert got == cases | {None: None}


def test_abbreviations_are_learnt(spark):
    rows = ["the dr. said that the end came.", "a dr. came to the u.s. today.", "no end to it", "the dr. left the u.s. and came", None, ""] * 40
    posts = spark.createDataFrame([(text,) for text in rows], "text string")
    counts = abbreviations.period_counts(posts)
    with_period = {r.term: (r.n, r.n_period) for r in counts.collect() if r.n_period}
    assert with_period == {"dr": (120, 120), "came": (120, 40), "u.s": (80, 80), "today": (40, 40)}
    # "today" has a period each time, too; here its length alone tells it from an abbreviation.
    scores = {r.term: r.score for r in abbreviations.score_abbreviations(counts).collect()}
    assert scores["dr"] > 10 and scores["u.s"] > 10 and scores["came"] <= 0 < scores["today"] < 3
    assert abbreviations.learned_abbreviations(counts, 3.0) == ["dr", "u.s"]
    with pytest.MonkeyPatch.context() as patch, pytest.raises(ValueError, match="min_score"):
        patch.setattr(abbreviations, "MAX_ABBREVIATIONS", 1)
        abbreviations.learned_abbreviations(counts, 3.0)
    assert abbreviations.learned_abbreviations(abbreviations.period_counts(posts.limit(0))) == []
    halves = [abbreviations.period_counts(spark.createDataFrame([(t,) for t in part], "text string")) for part in (rows[:99], rows[99:])]
    assert set(map(tuple, abbreviations.merge_counts(*halves).collect())) == set(map(tuple, counts.collect()))


def test_one_pattern_equals_the_chain_of_replacements(spark):
    rng = random.Random(11)
    bits = ["a", "b", "n't", "don't", "it's", "they'll", " ", " ", " ", "'", "''", '"', ".", "...", ",", ":", "-", "--",
            "(", ")", "]", "?", "!", "1", "2,3", "é", "cannot", "gonna", "'tis", "\n", "“", "’", "`", "#", "@", "/", "_",
            "u.s.", "'s"]
    rows = [(i, " ".join("".join(rng.choices(bits, k=rng.randint(1, 5))) for _ in range(4))) for i in range(3000)]
    got = spark.createDataFrame(rows, "i int, text string").select("i", tokens(F.col("text")).alias("t")).collect()
    con = duckdb.connect()
    con.register("texts", pd.DataFrame(rows, columns=["i", "text"]))
    want = dict(con.execute(f"SELECT i, {oracle.tokens('text')} FROM texts").fetchall())
    different = [rows[r.i][1] for r in got if list(r.t) != want[r.i]]
    # Runs of three or more colons and commas are the known difference.
    assert len(different) <= 3, different


def test_one_long_token_and_one_long_text(spark):
    text = "n.a'n-" * 20_000 + " the " * 50_000
    row = spark.createDataFrame([(text,)], "text string").select(tokens(F.col("text")).alias("t")).first()
    assert row.t.count("the") == 50_000
    assert max(map(len, row.t)) > 100_000


def test_language(spark):
    rows = [("The cat was on the mat", "en"), ("le chat est dans la maison", "fr"), ("", None), (None, None),
            ("der hund und die katze", "de"), ("?! 123", None), ("el perro y los gatos", "es"),
            ("the le", "en")]
    df = spark.createDataFrame(rows, "text string, want string")
    assert df.where(~detect_language(F.col("text")).eqNullSafe(F.col("want"))).count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right = F.coalesce(detect_language(F.col("text")) == F.col("lang"), F.lit(False))
    assert docs.agg(F.avg(right.cast("double"))).first()[0] >= 0.97


# Published examples of the algorithm, step by step, plus the common extensions.
STEMS = """caresses:caress ponies:poni ties:tie caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled
motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss
fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration
valenci:valenc hesitanci:hesit digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile
analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis
hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic
formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv
allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit
replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ
angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas
controll:control roll:roll dying:die skies:sky tied:tie cried:cri news:news enjoy:enjoy by:by geology:geolog
wonderfully:wonder pricey:pricey costly:costli expensive:expens joy:joy""".split()


@pytest.mark.parametrize("pair", STEMS)
def test_stem(pair):
    word, want = pair.split(":")
    assert stem_word(word) == want


def test_stems_equal_sql():
    rng = random.Random(3)
    endings = [s for s, _ in STEP_2 + STEP_3] + STEP_4 + "s es ies sses ed eed ied ing y e ll ating bling ly n't".split()
    words = {
        "".join(rng.choice(rng.choice(["bcdfghjklmnpqrstvwxyz", "aeiouy"])) for _ in range(rng.randint(0, 5)))
        + "".join(rng.choices(endings, k=rng.randint(0, 3)))
        for _ in range(8000)
    }
    con = duckdb.connect()
    con.register("words", pd.DataFrame({"term": sorted(words)}))
    want = dict(con.execute(f"WITH {oracle.stems('words')} SELECT term, stem FROM stems").fetchall())
    assert {w: stem_word(w) for w in words} == want


def test_stem_columns(spark):
    df = spark.createDataFrame([(["running", "cats"], "ponies"), ([], ""), (None, None)], "ws array<string>, w string")
    got = df.select(stem_joined(F.col("ws")).alias("a"), stem(F.col("w")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("run cat", "poni"), ("", ""), ("", None)]


SHORT_POSTS = [
    ("en", "Great price, love this phone!"), ("en", "Terrible service. Never again"), ("en", "worst airline ever, lost my bags"),
    ("nl", "Dit is een heel goede telefoon"), ("nl", "de trein was weer te laat"), ("it", "Questo telefono è molto bello"),
    ("it", "non mi piace per niente"), ("pt", "Este telefone é muito bom"), ("fr", "service très lent"),
    ("es", "muy buen servicio, gracias"), ("de", "ich habe kein Geld"), ("sv", "jag är inte nöjd med det"),
    ("da", "jeg er ikke glad for det"), ("pl", "to jest bardzo dobre"), ("tr", "bu telefon çok iyi"), ("fi", "tämä on hyvin hyvä"),
    (None, ""), (None, None), (None, "123 !!!"),
]


def test_short_posts_have_a_language(spark):
    df = spark.createDataFrame(SHORT_POSTS, "want string, text string")
    rows = df.select("want", "text", detect_language(F.col("text")).alias("got")).collect()
    assert [(r.text, r.got) for r in rows] == [(r.text, r.want) for r in rows]


# English posts of one to five words; some of their words are in the samples that the model learns from, most are not.
ENGLISH_POSTS = """Terrible service|good|broken screen|worst delivery|Nike Air Max restock today|wow|OK|lol|bad app|innovative|iPhone 15 Pro
|awful coffee|new store opening|nice|cheap flights|so happy right now|battery died|refund please|too expensive|my order arrived broken
|never again|shipping was quick|love it|hate this update|friendly driver|ugly shoes|customer support rocks|why so slow|price hike again
|eco friendly packaging|loud engine|game night|trusted brand|soft fabric|poor quality|can't log in|stock is up|garbage|yes!|thank you
|limited edition sneakers|reliable car|sounds great|what a mess|worth every penny|they ignored me|long wait times|finally fixed""".replace("\n", "")


def test_english_posts_of_few_words(spark):
    posts = ENGLISH_POSTS.split("|")
    rows = spark.createDataFrame([(p,) for p in posts], "text string").select("text", detect_language(F.col("text")).alias("got")).collect()
    wrong = [(r.text, r.got) for r in rows if r.got != "en"]
    assert len(posts) >= 40 and not wrong


def plain_judgement(text, model):
    """Sum of weights over the runs of one text, one run at a time."""
    letters = "".join(c if c in model.letters else " " for c in (text or "").lower())
    padded = f" {letters} "
    at = {g: i for i, g in enumerate(model.grams)}
    scores = [0] * len(model.languages)
    for i in range(len(padded) - 2):
        if padded[i + 1] != " " and padded[i : i + 3] in at:
            scores = [s + int(w) for s, w in zip(scores, model.weights[at[padded[i : i + 3]]])]
    best = max(range(len(scores)), key=lambda j: (scores[j], -j))
    second = max([s for j, s in enumerate(scores) if j != best], default=0)
    return (model.languages[best], scores[best] - second) if scores[best] else (None, 0)


def test_language_scores_against_a_plain_version(spark, monkeypatch):
    model = language.default_language_model(spark)
    rng = random.Random(4)
    words = " ".join(text for _, text in SHORT_POSTS if text).split() + ["漢字", "😀", "x", "İ", "1st", "don't", "\n", "–"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 9, 700]))) for _ in range(150)]
    texts += [None, "", " ", "a", "straße ÉTÉ", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16"), "the " * 3000]
    want = [plain_judgement(t, model) for t in texts]
    judged = [(t or "").lower() for t in texts]
    for size in (1 << 20, 50):
        monkeypatch.setattr(language, "_SLICE", size)
        scores = language._Scorer(model).scores(judged)
        for row, (lang, margin) in zip(scores.tolist(), want):
            best = row.index(max(row))
            assert (model.languages[best] if row[best] else None) == lang and row[best] - max(row[:best] + row[best + 1 :]) == margin
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(language.score_languages(F.col("text")).alias("s")).collect()
    assert [(r.s.language, r.s.margin) for r in got] == want


def test_margin_and_trained_model(spark):
    samples = [("xx", "abba abba cab"), ("yy", "dada deed a"), ("yy", None), (None, "abba")]
    table = language.train_language_model(spark.createDataFrame(samples, "lang string, text string"))
    assert {r.lang for r in table.collect()} == {"xx", "yy"}
    assert table.where("lang = 'yy' and gram = 'dee'").count() == 1 and language.train_language_model(table.select("lang", table.gram.alias("text")), 3).select("gram").distinct().count() == 3
    model = language.load_language_model(table)
    df = spark.createDataFrame([("Abba!",), ("deed",), ("zzz",), ("a",)], "text string")
    assert [r[0] for r in df.select(detect_language(F.col("text"), model)).collect()] == ["xx", "yy", None, "yy"]
    assert [r[0] for r in df.select(detect_language(F.col("text"), model, 10**9)).collect()] == [None] * 4


def test_texts_reach_python_in_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    posts = spark.createDataFrame([(i, "the cats and the dogs are running in the rain " * 5) for i in range(50)], "id long, text string")
    before = spark.conf.get(setting)
    for made in (lambda: detect_language(F.col("text")), lambda: stem_joined(F.split("text", " "))):
        spark.conf.set(setting, str(64 << 20))
        column = made()
        assert int(spark.conf.get(setting)) == ARROW_BYTES
        want = {r[0] for r in posts.select(column).collect()}
        # A smaller bound of the session stays; batches of a row or two give the same.
        spark.conf.set(setting, "300")
        assert {r[0] for r in posts.select(made()).collect()} == want and len(want) == 1
        assert spark.conf.get(setting) == "300"
    spark.conf.set(setting, before)
