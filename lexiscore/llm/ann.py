"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector has its own centroids, so K + K centroids name K x K cells. A query walks the cells in the order of
the summed nearness of their two centroids, by a heap, until the cells it has passed hold the wanted share of all vectors.
Its candidates are then scored exactly, in blocks: entries of some first centroids in blocks of bounded size, queries too. A
query carries one bit for each cell of the block's centroids; its product with the entries of its cells gives the block's best.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscore.llm.words import bound_batches
from lexiscore.session import written

CENTROIDS = 64
SAMPLE_ROWS = 20_000
SHARE = 0.45
#: A query travels once to each of at most so many groups of first centroids, whatever their number.
GROUPS = 16
ENTRY_BLOCK, QUERY_BLOCK = 4096, 512


def usable(vector: Column) -> Column:
    """True for vectors without null, infinite or missing components that are not zero throughout."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def kmeans(rows: np.ndarray, k: int, turns: int = 20, seed: int = 1) -> np.ndarray:
    """Lloyd's centroids; an empty one takes the row that lies farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = np.unique(rows, axis=0)
    centres = centres[rng.permutation(len(centres))[:k]].copy()
    for _ in range(turns):
        gaps = (centres * centres).sum(1) - 2 * rows @ centres.T
        own = gaps.argmin(1)
        for j in range(len(centres)):
            mine = own == j
            if mine.any():
                centres[j] = rows[mine].mean(0)
            else:
                centres[j] = rows[gaps.min(1).argmax()]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * rows @ centres.T).argmin(1)


def traverse(near1: np.ndarray, near2: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Cells in falling order of ``near1[i] + near2[j]``, until those passed hold ``wanted`` vectors."""
    first, second = np.argsort(-near1, kind="stable"), np.argsort(-near2, kind="stable")
    ones, twos, held_by = near1[first].tolist(), near2[second].tolist(), sizes[np.ix_(first, second)].tolist()
    names1, names2 = first.tolist(), second.tolist()
    # A row of cells enters with its first cell, once the row before has; then each cell brings the next of its row.
    heap, cells, held = [(-(ones[0] + twos[0]), 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heap[0]
        if held_by[i][j]:
            cells.append((names1[i], names2[j]))
            held += held_by[i][j]
        if j + 1 < len(twos):
            heapq.heapreplace(heap, (-(ones[i] + twos[j + 1]), i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(ones):
            heapq.heappush(heap, (-(ones[i + 1] + twos[0]), i + 1, 0))
    return cells


def best_of_block(entry_ids, entries, query_id, query, k) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's ``k`` best for one query, ties to the smaller id, the query itself left out."""
    rough = entries @ query
    rough[entry_ids == query_id] = -np.inf
    free = int((rough > -np.inf).sum())
    if not free:
        return entry_ids[:0], rough[:0]
    edge = np.partition(rough, len(rough) - min(k, free))[len(rough) - min(k, free)]
    # A matrix product may round equal vectors apart; what lies this close to the edge is summed anew, always in one order.
    close = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge)))
    close = close[rough[close] > -np.inf]
    exact = (entries[close] * query).sum(1)
    order = np.lexsort((entry_ids[close], -exact))[:k]
    return entry_ids[close][order], exact[order]


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    centroids: int = CENTROIDS,
    share: float = SHARE,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds, the ``k`` rows of largest inner product found.

    The nearness is the inner product in double precision. Ranks run from 1, ties go to the smaller id; a row is never its
    own neighbour; with fewer candidates than ``k`` all come back. Rows whose id or vector is null, whose vector is zero or
    has a component that is null or not finite, or whose length differs from the commonest (of several, the longest) take no
    part. Rows that repeat an id are neighbours of other ids each; of a query's own id none is. No rows give no rows.

    ``centroids`` per half are fitted on the ``sample_rows`` vectors of the smallest hashes; every vector is indexed.
    ``share`` of all vectors are candidates of each query: recall grows with it, and work too. An entry block holds about
    ``ENTRY_BLOCK`` vectors and a query block ``QUERY_BLOCK``, however many vectors share a centroid. A query is copied to
    at most ``GROUPS`` places, with one bit a cell, so more centroids do not make more rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    doubles = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"), is_query.alias("q")
    ).where(F.col("id").isNotNull() & usable(F.col("x")))
    doubles = doubles.withColumn("q", F.coalesce("q", F.lit(False)))
    schema = "query_id long, rank int, vec_id long, score double"
    length = doubles.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    n_dims = length["n"]
    doubles = doubles.where(F.size("x") == n_dims)
    sample = doubles.select("x", F.xxhash64("id").alias("h")).orderBy("h", "x").limit(sample_rows).select("x").toPandas()
    rows = np.stack(sample["x"].to_numpy())
    half = max(1, n_dims // 2)
    centres = kmeans(rows[:, :half], centroids), kmeans(rows[:, half:], centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_dims)
            cells = [pa.array(nearest(part, c), pa.int32()) for part, c in zip((x[:, :half], x[:, half:]), centres)]
            raw = pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cells, raw], names=["id", "q", "c1", "c2", "v"])

    index = written(doubles.mapInArrow(assign, "id long, q boolean, c1 int, c2 int, v binary"), "ann-index")
    sizes = np.zeros((len(centres[0]), len(centres[1])), np.int64)
    # At most K x K rows, whatever the table.
    n_queries = 0
    for c1, c2, n, nq in index.groupBy("c1", "c2").agg(F.count(F.lit(1)), F.count_if("q")).collect():
        sizes[c1, c2] = n
        n_queries += nq
    total = int(sizes.sum())
    wanted = max(int(np.ceil(share * total)), min(total, k + 1))
    # First centroids in groups of neighbouring numbers; of each group a query knows which cells it visits.
    per = max(1, -(-len(centres[0]) // GROUPS))
    n_second = len(centres[1])
    group = F.floor(F.col("c1") / per).cast("int").alias("g")
    group_sizes = np.add.reduceat(sizes.sum(1), np.arange(0, len(centres[0]), per))
    blocks = np.maximum(1, -(-group_sizes // ENTRY_BLOCK))
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups, cells, raws = [], [], [], []
            for query_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q = np.frombuffer(raw, np.float64)
                visited = np.zeros((len(blocks), per * n_second), bool)
                for c1, c2 in traverse(centres[0] @ q[:half], centres[1] @ q[half:], sizes, wanted):
                    visited[c1 // per, c1 % per * n_second + c2] = True
                for g in np.flatnonzero(visited.any(1)).tolist():
                    ids.append(query_id)
                    groups.append(g)
                    cells.append(np.packbits(visited[g]).tobytes())
                    raws.append(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(groups, pa.int32()), pa.array(cells, pa.binary()), pa.array(raws, pa.binary())],
                names=["query_id", "g", "cells", "q"],
            )

    visits = index.where("q").select("id", "v").mapInArrow(walk, "query_id long, g int, cells binary, q binary")
    n_blocks = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("g") + 1)
    query_block = F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("qb")
    queries = visits.groupBy("g", query_block).agg(F.collect_list(F.struct("query_id", "cells", "q")).alias("queries"))
    queries = queries.withColumn("eb", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    entry_block = F.pmod(F.xxhash64(F.lit(1), "id"), n_blocks).cast("int").alias("eb")
    cell = (F.pmod("c1", F.lit(per)) * n_second + F.col("c2")).alias("cell")
    entries = index.select("id", group, cell, "v").groupBy("g", entry_block).agg(F.collect_list(F.struct("id", "cell", "v")).alias("entries"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_q, out_id, out_score = [], [], []
            for entry_list, query_list in zip(batch.column(0), batch.column(1)):
                part = entry_list.values
                x = _vectors(part.field("v")).reshape(-1, n_dims)
                ids, cells = part.field("id").to_numpy(), part.field("cell").to_numpy()
                for asked in query_list:
                    mine = np.unpackbits(np.frombuffer(asked["cells"].as_py(), np.uint8))[cells].astype(bool)
                    query_id, q = asked["query_id"].as_py(), np.frombuffer(asked["q"].as_py(), np.float64)
                    best, scores = best_of_block(ids[mine], x[mine], query_id, q, k)
                    out_q += [query_id] * len(best)
                    out_id.append(best)
                    out_score.append(scores)
            flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_q, pa.int64()), pa.array(flat(out_id, np.int64)), pa.array(flat(out_score, np.float64))],
                names=["query_id", "vec_id", "score"],
            )

    pairs = entries.join(queries, ["g", "eb"]).select("entries", "queries")
    found = pairs.mapInArrow(score, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
