"""Exact dedup against a plain version."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiscore.llm import exact_dedup
from tests.llm.cases import AWKWARD, LONG, awkward

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def plain(rows):
    """Sorted ``id, keep_id, group_size, sha`` and how many rows of each group stay."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def check(spark, rows, counters):
    found = exact_dedup.group_copies(awkward(spark, rows).repartition(5), counters=counters)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = found.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) <= {1} and set(kept) == {r.text_sha256 for r in got}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


COPIES = [
    *AWKWARD,
    (20, "ÉCLAIR Au Chocolat"), (21, "éclair au chocolat"), (22, "Éclair AU chocolat"), (23, "İstanbul KELVIN K"),
    (24, "istanbul kelvin K"), (25, "İstanbul kelvin K"), (30, LONG.upper()), (31, LONG + " "), (40, " "), (41, "  "),
    (None, "Alpha beta"), (None, "ALPHA BETA"), (50, "the same row"), (50, "the same row"), (50, "THE same row"), (49, "the same row"),
]


@pytest.mark.parametrize("counters", [1, 3, exact_dedup.COUNTERS])
def test_awkward_rows(spark, counters):
    check(spark, COPIES, counters)


@pytest.mark.parametrize("counters", [4, 60])
def test_a_third_of_all_rows_are_copies(spark, counters):
    rng = random.Random(5)
    rows = [(i, "Hot Text" if i % 3 == 0 else f"warm {i % 40}" if i % 3 == 1 else f"own {rng.randrange(400)}") for i in range(1500)]
    check(spark, rows, counters)


def test_summaries_hold_all_frequent_digests(spark):
    rng = random.Random(6)
    keys = [rng.choice("ab") if rng.random() < 0.4 else str(rng.randrange(3000)) for _ in range(4000)]
    placed = spark.createDataFrame([(k.encode(),) for k in keys], "digest binary").repartition(7)
    counts, counters = Counter(k.encode() for k in keys), 15
    found = {bytes(r.digest): r.least for r in exact_dedup.frequent_digests(placed, counters).collect()}
    assert {k for k, n in counts.items() if n > 2 * len(keys) / (counters + 1)} <= found.keys() and len(found) <= counters + 1
    assert all(least <= counts[k] for k, least in found.items())


def test_drop_copies_keeps_whole_rows(spark):
    df = awkward(spark, COPIES).withColumn("kept", F.lit("mine")).withColumn("keep_id", F.lit(1)).withColumn("digest", F.lit(2))
    for counters in (2, 100):
        kept = exact_dedup.drop_copies(df, counters=counters)
        assert kept.columns == df.columns
        got = sorted(((r.doc_id, (r.text or "").translate(LOWER)) for r in kept.collect()), key=str)
        texts = {(t or "").translate(LOWER) for _, t in COPIES}
        want = [(max((i for i, u in COPIES if (u or "").translate(LOWER) == t and i is not None), default=None), t) for t in texts]
        assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert exact_dedup.group_copies(awkward(spark, [])).count() == 0
    assert exact_dedup.drop_copies(awkward(spark, [])).count() == 0
