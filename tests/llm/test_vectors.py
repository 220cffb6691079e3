"""Hard negatives and whitening against plain versions."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiscore.llm import hard_negatives, whitening
from lexiscore.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


# Hard negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (130, 64, 200), (65, 33, 67), (256, 128, 96), (0, 4, 3), (4, 0, 3)])
@pytest.mark.parametrize("top", [300, 1 << 27])
def test_strassen_is_exact(shape, top):
    rng = np.random.default_rng(1)
    m, k, n = shape
    a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
    want = a.astype(object) @ b.astype(object) if k else np.zeros((m, n), object)
    for leaf in (1, 8, 32):
        got = hard_negatives.strassen(a, b, leaf)
        assert got.dtype == np.int64 and got.shape == (m, n) and (got == want).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    slot, score = rng.integers(0, 6, 500), rng.integers(-5, 5, 500)
    ids, rows = rng.integers(0, 90, 500), np.arange(500)
    want = {}
    for s in range(6):
        want[s] = sorted((-score[i], ids[i], rows[i]) for i in np.flatnonzero(slot == s))[:4]
    for _ in range(5):
        heap, order = hard_negatives.Heap(6, 4), rng.permutation(500)
        for part in np.array_split(order, 17):
            heap.merge(slot[part], score[part], ids[part], rows[part])
        got = {s: [(-c, i, r) for t, c, i, r in zip(heap.slot, heap.score, heap.id, heap.row) if t == s] for s in range(6)}
        assert got == want


def plain_mining(rows, is_anchor, n_pos=5, n_neg=5):
    part = []
    for vec_id, vector, label in rows:
        ok = vector is not None and vector and all(c is not None and math.isfinite(c) for c in vector)
        if vec_id is not None and label is not None and ok:
            part.append((vec_id, label, [math.floor(256 * c) for c in vector]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (a_id, a_label, a) in enumerate(part):
        if not is_anchor(a_id):
            continue
        scored = sorted((-dot(a, v), v_id, label) for j, (v_id, label, v) in enumerate(part) if j != i)
        for p_score, p_id, _ in [s for s in scored if s[2] == a_label][:n_pos]:
            fits = [(n_id, -s) for s, n_id, label in scored if label != a_label and 80 * -p_score <= 100 * -s <= 100 * -p_score]
            out += [(a_id, p_id, k, n_id, -p_score, s) for k, (n_id, s) in enumerate(fits[:n_neg], 1)]
    return sorted(out)


def mined(df, **options):
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("tiles", [(512, 4096, 1024), (4, 16, 5)])
def test_mining_against_a_plain_version(spark, monkeypatch, tiles):
    for name, size in zip(("ANCHOR_TILE", "CANDIDATE_TILE", "STRIP"), tiles):
        monkeypatch.setattr(hard_negatives, name, size)
    rng = random.Random(3)
    # Few values make ties; a third of the rows are one vector, and one label is frequent.
    rows = [(i, [rng.randrange(-3, 4) / 4 for _ in range(6)], rng.choice([1, 1, 1, 2, 3, 4])) for i in range(240)]
    rows += [(1000 + i, [0.5] * 6, i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6)
    want = plain_mining(rows, lambda i: i % 10 == 0)
    assert len(want) > 500 and mined(df) == want


@pytest.mark.parametrize("limits", [(16, 64), (16, 2), (3, 1)])
def test_copies_of_anchor_tiles_never_pass_the_driver(spark, monkeypatch, limits):
    sizes = {"ANCHOR_TILE": 4, "CANDIDATE_TILE": 16, "GROUP": limits[0], "SPREAD": limits[1]}
    for name, size in sizes.items():
        monkeypatch.setattr(hard_negatives, name, size, raising=False)
    plans = []

    def written(df, name):
        out = spark.createDataFrame(df.collect(), df.schema)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(hard_negatives, "written", written)
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-3, 4) / 4 for _ in range(6)], rng.choice([1, 1, 1, 2])) for i in range(300)]
    found = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 10 == 0)
    got = sorted(tuple(r) for r in found.collect())
    assert got == plain_mining(rows, lambda i: i % 10 == 0) and len(got) > 300
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("Generate explode" in plan for plan in plans) == 2
    for plan in plans:
        lines = [(len(line) - len(line.lstrip(" :+-*")), line) for line in plan.splitlines()]
        for at, (depth, line) in enumerate(lines):
            if "BroadcastExchange" in line:
                below = list(itertools.takewhile(lambda x: x[0] > depth, lines[at + 1 :]))
                assert below and not any("Generate explode" in x or "collect_list" in x for _, x in below)


def test_rows_that_take_no_part_in_mining(spark):
    nan, inf = math.nan, math.inf
    one = [1.0, 0.5]
    rows = [(0, one, 1), (1, one, 1), (2, [0.9, 0.5], 2), (3, None, 2), (4, [nan, 1.0], 2), (5, [1.0, None], 2), (6, [inf, 1.0], 2),
            (7, one, None), (None, one, 2), (8, [], 2), (9, [1.0, 1.0, 1.0], 2), (10, [-1.0, 0.0], 1), (11, [1e30, 1.0], 2),
            (0, one, 1), (20, [0.0, 0.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumn("row", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("score", F.lit(0))
    part = [r for r in rows if r[0] not in (9, 11)]
    assert mined(df) == plain_mining(part, lambda i: i % 10 == 0)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id = 20")) == [] and mined(df.where("vec_id % 10 > 0")) == []


# Whitening


def random_covariance(rng, d, rank):
    a = rng.normal(size=(d, rank)) * np.logspace(0, 3, rank)
    return a @ a.T


@pytest.mark.parametrize(("d", "rank"), [(1, 1), (2, 2), (7, 7), (64, 64), (33, 20), (12, 3)])
def test_decomposition(d, rank):
    v = random_covariance(np.random.default_rng(d), d, rank)
    factor = whitening.pivoted_cholesky(v)
    assert factor.shape[1] >= rank and np.allclose(factor @ factor.T, v, rtol=0, atol=1e-12 * np.trace(v))
    pivots = [int(np.flatnonzero(np.abs(factor[:, j]) == np.abs(factor[:, j]).max())[0]) for j in range(1)]
    assert pivots == [int(np.diag(v).argmax())]
    rows, values = whitening.decompose(v, 8)
    want = np.linalg.eigvalsh(v)[::-1][: len(values)]
    assert len(values) == min(8, rank) and np.allclose(values, want, rtol=1e-9, atol=0)
    assert np.allclose(rows @ rows.T, np.eye(len(rows)), atol=1e-12)
    assert np.allclose(v @ rows.T, rows.T * values, atol=1e-11 * values[0])


def test_every_pair_of_columns_meets_once_a_sweep():
    for n in range(2, 12):
        pairs = [(int(a), int(b)) for x, y in whitening.rounds(n) for a, b in zip(x, y)]
        assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]
        assert all(len({*x, *y}) == 2 * len(x) for x, y in whitening.rounds(n))


def plain_whitening(ids, vectors):
    x = np.floor(1024 * vectors.astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), [int(s) for s in x.sum(0)]
    z = np.array([[float(Fraction(int(c) * n - s, n)) for c, s in zip(row, sums)] for row in x])
    values, columns = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:8]
    whitened = z @ columns[:, order] / np.sqrt(values[order])
    deviation = [sum((int(c) * n - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return n, deviation, whitened, values[order] / values.sum()


def compare(found, ids, vectors):
    rows = found.collect()
    n, deviation, whitened, explained = plain_whitening(ids, vectors)
    at = {i: j for j, i in enumerate(ids)}
    k = whitened.shape[1]
    assert len(rows) == len(ids) * k and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error <= 1e-8
    signs = {}
    for r in rows:
        j, c = at[r.vec_id], r.component - 1
        assert r.n == n and int(r.deviation) == deviation[j] and abs(r.explained / explained[c] - 1) < 1e-9
        if abs(whitened[j, c]) > 0.1:
            signs.setdefault(c, np.sign(r.whitened * whitened[j, c]))
            assert abs(r.whitened * signs[c] - whitened[j, c]) < 1e-7
    assert set(signs) == set(range(k))


def test_whitening_query_against_a_plain_version(spark):
    pdf = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    found = QUERIES["op12_embedding_whitening"](spark, SMALL)
    assert dict(found.dtypes)["deviation"] == "bigint" and dict(found.dtypes)["n"] == "bigint"
    compare(found, pdf["vec_id"].tolist(), np.stack(pdf["embedding"].to_numpy()))


def test_exact_deviations_beyond_a_long():
    y, n = np.array([[5, -7], [1 << 40, 3]]), 1 << 30
    got = whitening.deviations(y, n, (n * 100 + 11, n * 50 - 3), [100, 49]).to_pylist()
    rest = [11, n - 3]
    want = [sum((int(c) * n - r) ** 2 for c, r in zip(row, rest)) for row in y]
    assert [int(g) if g is not None else None for g in got] == [w if w < 10**38 else None for w in want]


def test_awkward_vectors(spark):
    nan, inf = math.nan, math.inf
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 3)) * [1.0, 3.0, 0.2]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    out = [(100, None), (101, [nan, 1.0, 1.0]), (102, [inf, 1.0, 1.0]), (103, [None, 1.0, 1.0]), (104, []), (105, [1.0]), (106, [1e300, 1.0, 1.0])]
    df = spark.createDataFrame(rows + out, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("n", F.lit("a"))
    compare(whitening.whitened_components(df), list(range(40)), x)
    assert whitening.whitened_components(df.limit(0)).count() == 0
    assert whitening.whitened_components(df.where("vec_id = 3")).count() == 0
    twice = whitening.whitened_components(df.unionAll(df.select(F.lit(None).cast("long"), "embedding", "x", "n")))
    assert twice.count() == 2 * 40 * 3 and twice.where("vec_id is null").count() == 40 * 3
    # One direction only.
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    flat = whitening.whitened_components(line).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
