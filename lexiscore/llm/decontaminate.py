"""Benchmark decontamination by spaced seeds.

A seed is a mask over a few words; the words at its blanks are ignored. Masked word hashes of every document meet those of
the benchmark, and around each hit the words are compared one to one, so a passage is found with some words replaced.
Documents are read once, and only the words near hits leave the first pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscore.llm.words import U64, bound_batches, mix, texts_of, word_hashes
from lexiscore.session import written

#: Masks, 1 for a word that counts. Whichever words of a stretch are replaced, as many as may be, one of them fits between.
MASKS = ("11011011", "1100101011", "101101110001", "111010010011", "1000101001111")
#: Words that masks of items shorter than a stretch count at least, where so many must agree.
MASK_WORDS = 6
#: A stretch of the item of so many words (all of a shorter item) must agree in this share of its words.
STRETCH, AGREE = 13, 0.8
#: Items of fewer words are no evidence of anything and are not sought.
MIN_ITEM = 5
#: Words on both sides of a hit that are compared.
REACH = 64
#: Slots, a power of two, of the table that sorts out hashes which no item has: so many a window, within these bounds. A
#: table at the upper bound (32 MB) is less selective, and the result the same.
WINDOW_SLOTS, LEAST_SLOTS, MOST_SLOTS = 128, 1 << 16, 1 << 28


@lru_cache
def whole_masks(n: int) -> tuple[str, ...]:
    """Masks over all words of an item of ``n`` words: each set of words that may be replaced is ignored by one of them.

    Taken one by one, each the one that ignores most of the sets left, of equals the first in order of ignored positions.
    """
    replaced = n - int(np.ceil(AGREE * n))
    ignored = [frozenset(z) for z in combinations(range(n), max(replaced, n - MASK_WORDS))]
    left, masks = {frozenset(c) for c in combinations(range(n), replaced)}, []
    while left:
        best = max(ignored, key=lambda z: sum(c <= z for c in left))
        left = {c for c in left if not c <= best}
        masks.append("".join("0" if i in best else "1" for i in range(n)))
    return tuple(masks)


def masks_of(sizes: tuple[int, ...]) -> tuple[str, ...]:
    """Masks for items of these numbers of words."""
    short = (m for n in sorted(set(sizes)) if n < STRETCH for m in whole_masks(n))
    return (*(MASKS if any(n >= STRETCH for n in sizes) else ()), *short)


def masked_hashes(words: np.ndarray, first: np.ndarray, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every masked window that lies within one text."""
    hashes, starts = [], []
    text_end = np.repeat(first[1:], np.diff(first))
    for mask in masks:
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        total = np.full(n, int(mask, 2) + (len(mask) << 32), np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                total = total * U64(0x9FB21C651E98DF25) + words[j : j + n]
        at = np.flatnonzero(np.arange(n) + len(mask) <= text_end[:n])
        hashes.append(mix(total[at]))
        starts.append(at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def _known(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of the hashes both of whose slots are filled; the table has a bit per slot."""
    last = U64(8 * len(table) - 1)
    filled = lambda slot: (table[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1
    keep = np.flatnonzero(filled(hashes & last))
    return keep[filled((hashes[keep] >> U64(32)) & last) > 0]


def _item_words(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    narrow = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = narrow.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes([t])[0] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(map(len, words), pa.int32())],
                names=["item_id", "item", "n_words"],
            )

    items = narrow.mapInArrow(cut, f"item_id {id_type}, item binary, n_words int")
    # Rows that repeat an item count once.
    return items.where(F.col("item_id").isNotNull() & (F.col("n_words") >= MIN_ITEM)).distinct()


def _windows(items: DataFrame) -> DataFrame:
    id_type = items.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = np.frombuffer(batch.column(1)[i].as_py(), np.uint64)
                hashes, starts = masked_hashes(words, np.array([0, len(words)]), masks_of((len(words),)))
                item = pa.array([batch.column(0)[i].as_py()] * len(hashes), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays(
                    [item, pa.array(hashes.view(np.int64)), pa.array(starts, pa.int64())], names=["item_id", "hash", "item_pos"]
                )

    return items.select("item_id", "item").mapInArrow(cut, f"item_id {id_type}, hash long, item_pos long")


def _table(windows: DataFrame) -> np.ndarray:
    """Which slots the benchmark's hashes fill, a bit each; made by Spark as at most a 64th as many numbers of 64 bits."""
    wanted = WINDOW_SLOTS * max(1, windows.count())
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (wanted - 1).bit_length()))
    slot = F.explode(F.array(F.col("hash").bitwiseAND(slots - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(slots - 1)))
    filled = windows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    bits = filled.agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toPandas()
    packed = np.zeros(slots // 64, np.int64)
    packed[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    return packed.view(np.uint8)


def _regions(docs: DataFrame, table: np.ndarray, masks: tuple[str, ...]) -> DataFrame:
    """Stretches of documents around hashes that the table has: ``doc_id, same, start, words, hits``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    longest = max(map(len, masks), default=0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sames, starts, stretches, hits = [], [], [], [], []
            for i, text in enumerate(texts_of(batch)):
                words, first = word_hashes([text])
                hashes, at = masked_hashes(words, first, masks)
                keep = _known(hashes, table)
                if not len(keep):
                    continue
                keep = keep[np.argsort(at[keep], kind="stable")]
                at, hashes = at[keep], hashes[keep]
                low, high = np.maximum(at - REACH, 0), np.minimum(at + longest + REACH, len(words))
                # A new region where the stretch of a hit begins beyond the one before.
                cuts = np.flatnonzero(low[1:] > high[:-1]) + 1
                for a, b in zip([0, *cuts], [*cuts, len(at)]):
                    ids.append(batch.column(0)[i].as_py())
                    sames.append(batch.column(2)[i].as_py())
                    starts.append(int(low[a]))
                    stretches.append(words[low[a] : high[b - 1]].tobytes())
                    hits.append([{"pos": int(p), "hash": h} for p, h in zip(at[a:b], hashes[a:b].view(np.int64).tolist())])
            kind = pa.list_(pa.struct([("pos", pa.int64()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, batch.schema.field(0).type), pa.array(sames, pa.int64()), pa.array(starts, pa.int64()),
                    pa.array(stretches, pa.binary()), pa.array(hits, kind),
                ],
                names=["doc_id", "same", "start", "words", "hits"],
            )

    return docs.mapInArrow(
        cut, f"doc_id {id_type}, same long, start long, words binary, hits array<struct<pos: long, hash: long>>"
    )


def agreeing(words: np.ndarray, item: np.ndarray, shift: int) -> int:
    """Words that agree in all sufficient stretches where item word i stands at ``words[i + shift]``; 0 if none suffices."""
    low, high = max(0, -shift), min(len(item), len(words) - shift)
    size = min(STRETCH, len(item))
    if high - low < size:
        return 0
    same = words[low + shift : high + shift] == item[low:high]
    sums = np.concatenate([[0], np.cumsum(same)])
    enough = np.flatnonzero(sums[size:] - sums[:-size] >= AGREE * size)
    if not len(enough):
        return 0
    covered = np.zeros(len(same), bool)
    for a in enough:
        covered[a : a + size] = True
    return int((same & covered).sum())


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_agree, n_words``: each document and benchmark item of which the document holds a passage.

    A passage is a stretch of ``STRETCH`` item words (all words of a shorter item) of which the share ``AGREE`` stands in
    the document in the same places. ``n_agree`` counts the words that agree in all such stretches of the best alignment,
    ``n_words`` the words of the item. Null texts are empty. Documents and items with a null id are not compared. Rows that
    repeat an id count as one document, items that repeat an id with another text as one item with several texts. No rows on
    either side give no rows.
    """
    bound_batches(docs.sparkSession)
    items = written(_item_words(benchmark, item_col, item_text_col), "leaks-items")
    # Items shorter than a stretch have masks of their own length; a set of at most STRETCH lengths.
    sizes = items.agg(F.sort_array(F.collect_set(F.least("n_words", F.lit(STRETCH))))).first()[0]
    windows = written(_windows(items), "leaks-windows")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("same"))
    narrow = narrow.where(F.col("doc_id").isNotNull())
    regions = written(_regions(narrow, _table(windows), masks_of(tuple(sizes))), "leaks-regions")
    hits = regions.select("doc_id", "same", "start", F.explode("hits").alias("hit"))
    hits = hits.select("doc_id", "same", "start", F.col("hit.pos").alias("pos"), F.col("hit.hash").alias("hash"))
    lines = hits.join(windows, "hash").select(
        "doc_id", "same", "start", "item_id", (F.col("pos") - F.col("start") - F.col("item_pos")).alias("shift")
    )
    # Regions of a text lie apart, so the words of an alignment that agree in several regions add up.
    places = lines.distinct().join(regions.drop("hits"), ["doc_id", "same", "start"]).join(items, "item_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [
                agreeing(np.frombuffer(w, np.uint64), np.frombuffer(t, np.uint64), shift)
                for w, t, shift in zip(*(batch.column(i).to_pylist() for i in (6, 7, 8)))
            ]
            done = pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(counts, pa.int64())],
                names=["doc_id", "item_id", "n_words", "same", "wording", "place", "n_agree"],
            )
            yield done.filter(pa.array([n > 0 for n in counts], pa.bool_()))

    types = {f.name: f.dataType.simpleString() for f in (*docs.select(F.col(f"`{id_col}`").alias("doc_id")).schema, *items.schema)}
    compared = places.select(
        "doc_id", "item_id", "n_words", "same", F.xxhash64("item").alias("wording"), (F.col("start") + F.col("shift")).alias("place"),
        "words", "item", "shift",
    ).mapInArrow(
        compare,
        f"doc_id {types['doc_id']}, item_id {types['item_id']}, n_words int, same long, wording long, place long, n_agree long",
    )
    aligned = compared.groupBy("doc_id", "item_id", "n_words", "same", "wording", "place").agg(F.sum("n_agree").alias("n_agree"))
    best = aligned.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_agree", "n_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_agree", F.col("best.n_words").cast("long").alias("n_words"))
