"""Hard-negative mining.

Anchors and candidates are dealt into tiles of bounded size by a written row number, so neither a frequent label nor a
frequent id fills a tile. The scores of a pair of tiles are one product of whole-number matrices, by Strassen's seven
recursive products. Two rounds of tiles: the first, within each label, finds every anchor's positives; the second, over
all candidates, the negatives whose score lies in the window below a positive's. Both keep what they find in heaps of
bounded size that merge: over the strips of a tile, the tiles of a task, and the tasks. Anchor tiles are copied once for
each group of candidate tiles and meet them by a shuffle, never through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscore.llm.words import bound_batches
from lexiscore.session import ship_package, written

SCALE = 256
ANCHOR_TILE, CANDIDATE_TILE = 512, 4096
# Candidates whose scores are held at once.
STRIP = 1024
# A matrix side is halved while the halves have at least this length.
LEAF = 32
# Heaps that a task holds before it passes the oldest on.
HELD = 32
# Candidate tiles that share one copy of the anchor tiles, at most; fewer while that leaves fewer groups of tiles than SPREAD.
GROUP, SPREAD = 16, 64


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of small int64 matrices; in doubles, which are faster, where no sum can exceed their 53 bits."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _halves(a: np.ndarray, b: np.ndarray, turns: int) -> np.ndarray:
    if not turns:
        return _product(a, b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = _halves(a11 + a22, b11 + b22, turns - 1)
    p2 = _halves(a21 + a22, b11, turns - 1)
    p3 = _halves(a11, b12 - b22, turns - 1)
    p4 = _halves(a22, b21 - b11, turns - 1)
    p5 = _halves(a11 + a12, b22, turns - 1)
    p6 = _halves(a21 - a11, b11 + b12, turns - 1)
    p7 = _halves(a12 - a22, b21 + b22, turns - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n], out[:m, n:] = p1 + p4 - p5 + p7, p3 + p5
    out[m:, :n], out[m:, n:] = p2 + p4, p1 - p2 + p3 + p6
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` for int64 matrices, exact wherever the result fits 64 bits (sums in between wrap, and wrap back).

    Sides are padded with zeros to a multiple of the power of two by which they are halved.
    """
    (m, k), n = a.shape, b.shape[1]
    turns = max(0, int(min(m, k, n) // leaf).bit_length() - 1) if min(m, k, n) else 0
    up = lambda size: -size % (1 << turns)
    wide = np.pad(a, ((0, up(m)), (0, up(k)))), np.pad(b, ((0, up(k)), (0, up(n))))
    return _halves(*wide, turns)[:m, :n]


class Heap:
    """The best ``k`` entries of each slot: largest score first, ties by smaller id, then by smaller row. Heaps merge."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot = self.score = self.id = self.row = np.zeros(0, np.int64)
        # The score below which a slot takes nothing more.
        self.floor = np.full(slots, np.iinfo(np.int64).min)

    def merge(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fits = score >= self.floor[slot]
        slot, score, ids, rows = (
            np.concatenate([old, new[fits]])
            for old, new in ((self.slot, slot), (self.score, score), (self.id, ids), (self.row, rows))
        )
        order = np.lexsort((rows, ids, -score, slot))
        sorted_slot = slot[order]
        first = np.flatnonzero(np.diff(sorted_slot, prepend=-1))
        place = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
        order, place = order[place < self.k], place[place < self.k]
        self.slot, self.score, self.id, self.row = slot[order], score[order], ids[order], rows[order]
        full = place == self.k - 1
        self.floor[self.slot[full]] = self.score[full]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, d)


def _strips(anchors: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for low in range(0, len(candidates), STRIP):
        yield low, strassen(anchors, np.ascontiguousarray(candidates[low : low + STRIP].T))


def positives_of_tile(heap: Heap, a_row, a, c_id, c_row, c) -> None:
    """Merge the scores of a tile's candidates with each anchor into its slot; a row is not compared with itself."""
    for low, scores in _strips(a, c):
        high = low + scores.shape[1]
        own = a_row[:, None] == c_row[None, low:high]
        keep = min(heap.k + 1, scores.shape[1])
        edge = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
        slot, place = np.nonzero((scores >= np.maximum(edge, heap.floor)[:, None]) & ~own)
        heap.merge(slot, scores[slot, place], c_id[low + place], c_row[low + place])


def negatives_of_tile(heap: Heap, a_label, a, tops, lows, c_id, c_row, c_label, c) -> None:
    """Merge candidates of other labels into the windows: slot ``i * windows + w`` for window ``w`` of anchor ``i``.

    ``tops`` and ``lows`` are the bounds of the windows, both part of them; an absent window has a top below its low.
    """
    n_windows = tops.shape[1]
    real = tops >= lows
    highest = np.where(real, tops, np.iinfo(np.int64).min).max(1)
    lowest = np.where(real, lows, np.iinfo(np.int64).max).min(1)
    for low, scores in _strips(a, c):
        high = low + scores.shape[1]
        other = a_label[:, None] != c_label[None, low:high]
        i, place = np.nonzero((scores <= highest[:, None]) & (scores >= lowest[:, None]) & other)
        found = scores[i, place]
        for w in range(n_windows):
            inside = np.flatnonzero((found <= tops[i, w]) & (found >= lows[i, w]))
            at = low + place[inside]
            heap.merge(i[inside] * n_windows + w, found[inside], c_id[at], c_row[at])


def _placed(vectors: DataFrame, is_anchor: Column, id_col: str, label_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``row, id, label, anchor, v``: the rows that take part, ``v`` the bytes of their whole numbers, and the dimensions."""
    doubles = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{label_col}`").cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("x"),
    )
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    part = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite
    doubles = doubles.where(part)
    common = doubles.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 1
    # Scores, and a hundred times a score, then fit 64 bits.
    largest = (2.0**55 / d) ** 0.5
    doubles = doubles.where((F.size("x") == d) & F.forall("x", lambda c: F.abs(c * SCALE) < largest))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(batch.column(4).flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int64).reshape(-1, d)
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], raw], names=["row", "id", "label", "anchor", "v"])

    return written(doubles.mapInArrow(whole, "row long, id long, label long, anchor boolean, v binary"), "mining-rows"), d


def _dealt(n_tiles: Column) -> Column:
    return F.pmod(F.xxhash64("row"), n_tiles).cast("int")


def _groups(n_tiles: Column) -> Column:
    """How many groups the candidate tiles form: tile ``t`` is in group ``t`` modulo this number."""
    size = F.least(F.lit(GROUP), F.greatest(F.lit(1), F.floor(n_tiles / SPREAD)))
    return F.ceil(n_tiles / size).cast("int")


def _listed(*columns: str) -> Column:
    return F.collect_list(F.struct(*columns))


def _met(anchors: DataFrame, candidates: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """``anchors``, tiles with a ``groups``, beside each tile of the ``candidates``, rows with a ``ct``, of their ``keys``.

    Anchor tiles are copied once a group, and Spark plans by their size before that; so the join is never left to a
    broadcast, which would take all copies through the driver. A task passes the anchor tiles by one group of candidates.
    """
    keys = [*keys, "group"]
    copied = anchors.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    tiles = candidates.withColumn("group", F.col("ct") % F.col("groups")).repartition(*keys)
    tiles = tiles.groupBy(*keys, "ct").agg(_listed(*columns).alias("candidates"))
    return copied.join(tiles.hint("merge"), keys)


def _fields(part: pa.Array, *names: str) -> list[np.ndarray]:
    return [part.field(name).to_numpy(zero_copy_only=False) for name in names]


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    n_positives: int = 5,
    n_negatives: int = 5,
    lowest: int = 80,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``is_anchor`` holds.

    Components become ``floor(256 * component)``; a score is the inner product of two such vectors, exact. Higher scores
    come first, ties go to the smaller id, then by the table's rows. An anchor's positives are its first ``n_positives``
    other rows of its label; for each, the first ``n_negatives`` rows of other labels come back whose score is at most the
    positive's and at least ``lowest`` percent of it, so a positive of negative score has none. With fewer rows, all.

    Rows take no part whose id, label or vector is null or whose vector is empty, has a component that is null, not finite
    or so large that scores might leave 64 bits, or has another length than the commonest (of several, the longest). Rows
    that repeat an id are rows of their own. An empty table gives no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    bound_batches(spark)
    rows, d = _placed(vectors, is_anchor, id_col, label_col, vector_col)
    positives = _positives(rows, d, n_positives)

    n_rows, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    n_tiles, anchor_tiles = max(1, -(-n_rows // CANDIDATE_TILE)), max(1, -(-n_anchors // ANCHOR_TILE))
    groups = _groups(F.lit(n_tiles)).alias("groups")
    windows = positives.groupBy("anchor_row").agg(F.sort_array(_listed("place", "id", "score")).alias("windows"))
    asked = rows.where("anchor").join(windows.hint("merge"), F.col("row") == F.col("anchor_row"))
    tile = _dealt(F.lit(anchor_tiles)).alias("at")
    asked = asked.groupBy(tile).agg(_listed("row", "id", "label", "v", "windows").alias("anchors")).select("*", groups)
    candidates = rows.select("row", "id", "label", "v", _dealt(F.lit(n_tiles)).alias("ct"), groups)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for tile, asked_list, candidate_list in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if tile not in held:
                    if len(held) == HELD:
                        yield _found(*held.pop(next(iter(held))), n_positives)
                    held[tile] = _windows(asked_list.values, n_positives, n_negatives, lowest)
                anchors, heap, tops, lows, _ = held[tile]
                c_row, c_id, c_label = _fields(candidate_list.values, "row", "id", "label")
                c = _matrix(candidate_list.values.field("v"), d)
                negatives_of_tile(heap, anchors["label"], _matrix(anchors["v"], d), tops, lows, c_id, c_row, c_label, c)
        for state in held.values():
            yield _found(*state, n_positives)

    pairs = _met(asked, candidates, [], "row", "id", "label", "v").select("at", "anchors", "candidates")
    schema = "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, id long, row long, score long"
    found = pairs.mapInArrow(search, schema)
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _positives(rows: DataFrame, d: int, k: int) -> DataFrame:
    """``anchor_row, place, id, score``: the first ``k`` other rows of each anchor's label."""
    sizes = rows.groupBy("label").agg(
        F.ceil(F.count(F.lit(1)) / CANDIDATE_TILE).alias("tiles"), F.ceil(F.count_if("anchor") / ANCHOR_TILE).alias("anchor_tiles")
    )
    # The hash as a second key has both sides shuffled for this join alone, which adaptive execution may then split.
    by_hash = F.xxhash64("label").alias("h")
    sized = rows.select("*", by_hash).join(sizes.where("anchor_tiles > 0").select("*", by_hash), ["label", "h"])
    sized = sized.withColumn("groups", _groups(F.col("tiles")))
    candidates = sized.select("label", "row", "id", "v", _dealt(F.col("tiles")).alias("ct"), "groups")
    tile = _dealt(F.col("anchor_tiles")).alias("at")
    anchors = sized.where("anchor").groupBy("label", "groups", tile).agg(_listed("row", "v").alias("anchors"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor_list, candidate_list in zip(batch.column(0), batch.column(1)):
                (a_row,), (c_row, c_id) = _fields(anchor_list.values, "row"), _fields(candidate_list.values, "row", "id")
                heap = Heap(len(a_row), k)
                a, c = _matrix(anchor_list.values.field("v"), d), _matrix(candidate_list.values.field("v"), d)
                positives_of_tile(heap, a_row, a, c_id, c_row, c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (a_row[heap.slot], heap.id, heap.row, heap.score)],
                    names=["anchor_row", "id", "row", "score"],
                )

    pairs = _met(anchors, candidates, ["label"], "row", "id", "v").select("anchors", "candidates")
    found = pairs.mapInArrow(search, "anchor_row long, id long, row long, score long")
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row")
    ranked = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return written(ranked.select("anchor_row", "place", "id", "score"), "mining-positives")


def _windows(part: pa.Array, n_positives: int, n_negatives: int, lowest: int) -> tuple:
    """A tile's anchors, their empty heap, the bounds of their windows, and the positives behind them."""
    row, ids, label = _fields(part, "row", "id", "label")
    tops, ends = np.full((len(row), n_positives), -1), np.full((len(row), n_positives), 0)
    names = np.zeros((len(row), n_positives), np.int64)
    for i, windows in enumerate(part.field("windows").to_pylist()):
        for window in windows:
            w, score = window["place"] - 1, window["score"]
            # The least whole number that is at least this percentage.
            tops[i, w], ends[i, w], names[i, w] = score, -(-lowest * score // 100), window["id"]
    anchors = {"row": row, "id": ids, "label": label, "v": part.field("v")}
    return anchors, Heap(len(row) * n_positives, n_negatives), tops, ends, names


def _found(anchors: dict, heap: Heap, tops: np.ndarray, _, names: np.ndarray, n_positives: int) -> pa.RecordBatch:
    i, w = heap.slot // n_positives, heap.slot % n_positives
    columns = {
        "anchor_row": anchors["row"][i], "anchor_id": anchors["id"][i], "place": (w + 1).astype(np.int32),
        "positive_id": names[i, w], "positive_score": tops[i, w], "id": heap.id, "row": heap.row, "score": heap.score,
    }
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
