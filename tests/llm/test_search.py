"""Nearest neighbours, decontamination, toxicity."""

import math
import random
import zlib
from functools import partialmethod
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from lexiscore.llm import ann, decontaminate, toxicity
from tests.llm.cases import AWKWARD, LONG, awkward, prose

SMALL = "/root/testdata/sf0.01"


def exact(ids, x, queries, k):
    """Ids of the k nearest of each query."""
    out = {}
    for q in queries:
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        out[q] = [int(i) for i in ids[np.lexsort((ids, -scores))][:k]]
    return out


def test_recall_and_order(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = ann.search(table, F.col("vec_id") % 20 == 0).toPandas()
    pdf = table.toPandas()
    ids, x = pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"].to_numpy()).astype(float)
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 20)
    hits = 0
    for q, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, 21)) and q not in set(rows["vec_id"])
        assert (np.diff(rows["score"]) <= 0).all()
        direct = [float((x[ids == v][0] * x[ids == q][0]).sum()) for v in rows["vec_id"]]
        assert rows["score"].tolist() == direct
        hits += len(set(rows["vec_id"]) & set(want[q]))
    assert set(got["query_id"]) == set(want) and hits >= 0.9 * 20 * len(want)


def test_whole_share_is_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "ENTRY_BLOCK", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(5)]) for i in range(120)] + [(1000 + i, [1.0] * 5) for i in range(40)]
    rows = [(i, v) for i, v in rows if any(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=7, centroids=3, share=1.0).orderBy("query_id", "rank").collect()
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    want = exact(ids, x, [i for i in ids.tolist() if i % 20 == 0], 7)
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r.vec_id)
    assert by_query == want


def test_vectors_that_take_no_part(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0, 1.0]), (1, [0.0, 0.0, 0.0]), (2, None), (3, [1.0, None, 1.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]),
            (6, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (7, [2.0, 0.0, 0.0]), (20, [0.5, 0.5, 0.5]), (7, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("c1", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 7, 2.0), (0, 2, 7, 2.0), (0, 3, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 7, 1.0), (20, 3, 7, 1.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id = 7"), F.col("vec_id") % 20 == 0).count() == 0


def test_traversal_goes_by_summed_nearness():
    rng = np.random.default_rng(2)
    a, b, sizes = rng.normal(size=6), rng.normal(size=5), rng.integers(0, 4, (6, 5))
    cells = ann.traverse(a, b, sizes, 10**6)
    want = sorted(((-(a[i] + b[j]), (i, j)) for i in range(6) for j in range(5) if sizes[i, j]))
    assert cells == [c for _, c in want]


# Decontamination


def leaks(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("hash", F.lit("h"))
    return {(r.doc_id, r.item_id): (r.n_agree, r.n_words) for r in decontaminate.find_leaks(awkward(spark, rows), bench).collect()}


def test_passages_are_found_with_replaced_words(spark):
    item = prose(1, 40)
    words = item.split()
    replaced = [w if i % 9 != 4 else "other" for i, w in enumerate(words)]
    rows = [
        (1, f"{prose(2, 50)} {item} {prose(3, 30)}"),
        (2, f"{prose(4, 50)}. {' '.join(replaced).upper()}!"),
        (3, prose(5, 500)),
        (4, " ".join(words[:8])),
        (5, f"{prose(6, 20)} {' '.join(words[10:30])} {prose(7, 20)}"),
        *AWKWARD[2:],
    ]
    items = [(10, item), (11, prose(8, 30)), (12, ""), (13, None), (None, item), (14, "two words"), (15, "six short words are in here")]
    got = leaks(spark, rows, items)
    assert got[1, 10] == (40, 40) and got[2, 10][0] == sum(a == b for a, b in zip(words, replaced)) and got[5, 10] == (20, 40)
    assert set(got) == {(1, 10), (2, 10), (5, 10)}
    short = leaks(spark, [(9, "and Six short words, are in here too"), (8, "six short words are not in here")], items)
    assert short == {(9, 15): (6, 6)}
    assert leaks(spark, [], items) == {} and leaks(spark, rows, []) == {}


def test_parts_of_one_alignment_add_up(spark, monkeypatch):
    item = prose(21, 300)
    words = item.split()
    copy = [*words[:40], *prose(22, 220).split(), *words[260:]]
    apart = [*words[:40], *prose(23, 150).split(), *words[260:]]
    rows = [(1, f"{prose(24, 30)} {' '.join(copy)} {prose(25, 200)}"), (2, " ".join(apart)), (3, f"{' '.join(words[:100])} end")]
    assert leaks(spark, rows, [(10, item)]) == {(1, 10): (80, 300), (2, 10): (40, 300), (3, 10): (100, 300)}
    # A table that is far too small lets everything through, and the result is the same.
    monkeypatch.setattr(decontaminate, "LEAST_SLOTS", 64)
    monkeypatch.setattr(decontaminate, "MOST_SLOTS", 64)
    assert leaks(spark, rows, [(10, item)]) == {(1, 10): (80, 300), (2, 10): (40, 300), (3, 10): (100, 300)}


def replaced_words(n):
    """Sets of words that may be replaced in a stretch of ``n``."""
    return [c for k in range(n + 1) if n - k >= decontaminate.AGREE * n for c in combinations(range(n), k)]


def test_a_mask_fits_between_all_replaced_words():
    for n in range(decontaminate.MIN_ITEM, decontaminate.STRETCH + 1):
        for gone in replaced_words(n):
            places = ((m, a) for m in decontaminate.masks_of((n,)) for a in range(n - len(m) + 1))
            assert any(all(bit == "0" or i + a not in gone for i, bit in enumerate(m)) for m, a in places), (n, gone)


def test_all_patterns_of_replaced_words_are_found(spark):
    rows, want = [], {}
    for n in range(decontaminate.MIN_ITEM, decontaminate.STRETCH + 1):
        for gone in replaced_words(n):
            words = [f"new{i}" if i in gone else f"w{n}x{i}" for i in range(n)]
            want[len(rows), n] = (n - len(gone), n)
            rows.append((len(rows), f"before it {' '.join(words)} and after"))
    assert leaks(spark, rows, [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(5, 14)]) == want


def test_a_passage_in_very_many_documents(spark):
    item = prose(1, 30)
    rows = [(i, f"{prose(100 + i, 10)} {item} {prose(900 + i, 10)}") for i in range(300)]
    assert set(leaks(spark, rows, [(1, item)])) == {(i, 1) for i in range(300)}


def test_agreeing_against_a_plain_version():
    rng = np.random.default_rng(3)
    for _ in range(200):
        doc, item = rng.integers(0, 3, 60).astype(np.uint64), rng.integers(0, 3, rng.integers(5, 40)).astype(np.uint64)
        shift = int(rng.integers(-10, 50))
        same = {i: doc[i + shift] == item[i] for i in range(len(item)) if 0 <= i + shift < len(doc)}
        size, covered = min(decontaminate.STRETCH, len(item)), set()
        for a in same:
            stretch = range(a, a + size)
            if all(i in same for i in stretch) and sum(same[i] for i in stretch) >= decontaminate.AGREE * size:
                covered |= {i for i in stretch if same[i]}
        assert decontaminate.agreeing(doc, item, shift) == len(covered)


# Toxicity

BAD = ["vilething", "foulperson", "nastyword"]


def labelled(n=600):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(i, 80).split()
        if toxic:
            rng = random.Random(i)
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_awkward_rows(spark):
    rows, labels = labelled()
    docs = awkward(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 1), (5001, None)], "doc_id long, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    net = toxicity.train(docs, marks, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    wrong = [i for i, y in labels if held(i) and (scores[i] >= toxicity.THRESHOLD) != y]
    assert len(wrong) <= 0.03 * sum(held(i) for i, _ in labels)
    # A word far into a very long text counts as much as any.
    odd = [*AWKWARD, (90, LONG + " vilething foulperson"), (91, LONG)]
    got = [(r.doc_id, r.score) for r in toxicity.score(awkward(spark, odd), net).collect()]
    assert len(got) == len(odd) and all(0 <= s <= 1 for _, s in got)
    assert dict(got)[90] >= toxicity.THRESHOLD > dict(got)[91]
    assert dict(got)[2] == dict(got)[3] < toxicity.THRESHOLD
    kept = toxicity.keep_clean(awkward(spark, odd), net)
    assert 90 not in {r.doc_id for r in kept.collect()} and kept.columns == docs.columns


def test_nothing_to_learn_from(spark):
    docs = awkward(spark)
    marks = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, marks, F.lit(True)) is None
    assert toxicity.train(docs.limit(0), marks, F.lit(True)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), None).count() == 0
    assert toxicity.keep_clean(docs, None).count() == docs.count()


def test_training_does_not_depend_on_the_order_of_rows(spark):
    rows, labels = labelled(80)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    one = toxicity.train(awkward(spark, rows), marks, F.lit(True))
    two = toxicity.train(awkward(spark, rows[::-1]).repartition(3), marks, F.lit(True))
    assert one.edges == two.edges and (one.embedding == two.embedding).all()


def test_toxic_words_far_into_long_texts_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(toxicity.TextNetwork, "fit", partialmethod(toxicity.TextNetwork.fit, steps=2500))
    long = lambda i, toxic: prose(i, 4100) + (f" {BAD[i % 3]} {BAD[(i + 1) % 3]}" if toxic else "")
    rows = [(i, long(i, i % 2)) for i in range(60)]
    marks = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    net = toxicity.train(awkward(spark, rows), marks, F.lit(True))
    fresh = [(100 + i, long(100 + i, i % 2)) for i in range(20)]
    got = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.score(awkward(spark, fresh), net).collect()}
    assert sum(got[100 + i] == bool(i % 2) for i in range(20)) >= 18


def test_training_in_parts_is_training_on_whole_texts(monkeypatch, tmp_path):
    texts = [toxicity.features(prose(i, 90) + (" vilething" if i % 2 else ""))[0] for i in range(20)]
    labels = np.array([i % 2 for i in range(20)])
    path, stored, at = tmp_path / "buckets", [], 0
    path.write_bytes(b"".join(t.tobytes() for t in texts))
    with open(path, "rb") as file:
        for t in texts:
            stored.append(toxicity.Stored(file.fileno(), [(at, 40), (at + 40 * 10, len(t) - 40)]))
            at += t.nbytes
        assert all((s[a : a + 37] == t[a : a + 37]).all() for s, t in zip(stored, texts) for a in range(0, 100, 7))
        # Which words are left out depends on the parts, so none are here.
        monkeypatch.setattr(toxicity, "DROPPED", 0)
        nets = [toxicity.TextNetwork.fresh() for _ in range(2)]
        nets[0].fit(texts, labels, steps=20)
        monkeypatch.setattr(toxicity, "STRIDE", 7)
        nets[1].fit(stored, labels, steps=20)
    assert np.allclose([nets[0].output(t) for t in texts], [nets[1].output(t) for t in texts], atol=0.05)


def test_parts_of_a_text_give_the_whole_maximum(monkeypatch):
    net = toxicity.TextNetwork.fresh()
    buckets, _ = toxicity.features(prose(1, 300))
    whole = net.output(buckets)
    monkeypatch.setattr(toxicity, "STRIDE", 7)
    assert abs(net.output(buckets) - whole) < 1e-4


def test_every_labelled_row_is_learnt_in_shards_too(spark, monkeypatch):
    ids = spark.range(9400).select("id", (F.xxhash64("id") > 5 * 10**18).alias("late")).collect()
    rows, labels = [], []
    for r in ids:
        toxic = r.id % 5 < 2
        # Among the 3,760 toxic rows those of the largest hashes, beyond any 3,000, have a word of their own.
        rows.append((r.id, prose(r.id, 6) + (" " + ("latefoul" if r.late else "vilething") if toxic else "")))
        labels.append((r.id, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    fresh = spark.createDataFrame([(i, prose(20_000 + i, 6) + ["", " latefoul", " vilething"][i % 3]) for i in range(60)], docs.schema)
    for shard in (toxicity.SHARD_ROWS, 2000):
        monkeypatch.setattr(toxicity, "SHARD_ROWS", shard)
        net = toxicity.train(docs, marks, F.lit(True))
        got = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.score(fresh, net).collect()}
        assert sum(got[i] == (i % 3 > 0) for i in got) >= 57
