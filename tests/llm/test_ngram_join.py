import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from lexiscore.llm import ngram_join
from lexiscore.llm.components import components
from tests.llm.cases import LONG, awkward, grams_of, prose


def plain(rows, threshold=0.8):
    """Class, links and copies of each row by comparing all pairs."""
    sets = defaultdict(list)
    for doc, text in rows:
        if doc is not None and grams_of(text):
            sets[grams_of(text)].append(doc)
    node = {s: min(v) for s, v in sets.items()}
    parent = {d: d for v in sets.values() for d in v}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a, b in combinations(node, 2):
        if node[a] != node[b] and len(a & b) / len(a | b) >= threshold:
            links[node[a]] += 1
            links[node[b]] += 1
            x, y = sorted((find(node[a]), find(node[b])))
            parent[y] = x
    out = []
    for doc, text in rows:
        s = grams_of(text)
        if doc is None or not s:
            out.append((doc, doc, 0, 1))
        else:
            out.append((doc, find(node[s]), links[node[s]], len(sets[s])))
    return out


def check(spark, rows):
    got = [tuple(r) for r in ngram_join.join(awkward(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    return got


def near(text, seed, changes):
    rng, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_banding_meets_the_recall():
    bands, rows = ngram_join.banding(0.8, 0.9999)
    assert bands * rows <= ngram_join.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        ngram_join.banding(0.3, 0.999999, most_hashes=8)


def test_against_all_pairs(spark):
    rows = []
    for g in range(25):
        base = prose(g, 60 + 7 * g)
        rows += [(100 * g + k, near(base, g * 50 + k, k)) for k in range(8)]
        rows += [(100 * g + 50, base.upper()), (100 * g + 51, base + " ...")]
    got = check(spark, rows)
    assert any(links for _, _, links, _ in got)


def test_a_large_group_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 16)
    base = prose(7, 400)
    rows = [(i, near(base, i, i % 12)) for i in range(150)] + [(1000 + i, prose(1000 + i, 50)) for i in range(20)]
    check(spark, rows)


def test_chains_are_one_class(spark):
    words = prose(3, 300).split()
    rows = [(i, " ".join(words[8 * i : 8 * i + 160])) for i in range(15)]
    got = check(spark, rows)
    assert len({c for _, c, _, _ in got}) < len(rows)


def test_awkward_rows(spark):
    rows = [(1, "Alpha beta gamma delta epsilon zeta")] * 2 + [(2, None), (3, ""), (4, " \n "), (None, "a b c d e f"), (6, LONG),
            (7, LONG + " more"), (8, "one two"), (9, "One, two!"), (10, "The The The The The The"), (11, "the " * 90)]
    check(spark, rows)
    assert ngram_join.join(awkward(spark).limit(0)).count() == 0
    repeated = ngram_join.join(awkward(spark, [(5, prose(1, 40)), (5, prose(2, 40)), (6, prose(1, 40)), (7, prose(2, 40))]))
    # Rows that repeat an id are one document.
    assert {r.class_id for r in repeated.collect()} == {5}


def test_pairs_never_are_rows(spark):
    base = prose(11, 200)
    rows = [(i, near(base, i, 2)) for i in range(120)]
    got = ngram_join.join(awkward(spark, rows)).collect()
    assert len(got) == 120 and {r.class_id for r in got} == {0}


def test_similar_counts_whole_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    n = np.arange(30)
    got = ngram_join.similar(sets, n, n, 0.5)
    for i in n:
        for j in n:
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert got[i, j] == (len(a & b) / len(a | b) >= 0.5)


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (301, 300), (302, 301), (300, 303)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 300 for i in (300, 301, 302, 303)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
