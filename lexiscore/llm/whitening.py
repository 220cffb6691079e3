"""Embedding whitening.

Vectors become whole numbers, their scatter around the mean is summed as matrix products where the vectors are, and the
one D x D matrix that is left is decomposed: a Cholesky factor with diagonal pivoting, then one-sided Jacobi rotations of
the factor's columns until all are orthogonal. As the factor times its transpose is the covariance, the squared norms of
the rotated columns are its eigenvalues, and the normalised columns its components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscore.llm.words import bound_batches
from lexiscore.session import ship_package, written

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
# Entries beyond this would not be exact as doubles.
LARGEST = float(1 << 42)
# Partial matrices meet in so many tasks, whose sums come to the driver.
MERGE_TASKS = 16
# An eigenvalue of at most this part of the largest counts as zero: the covariance holds no more digits of it.
RANK = 1e-10


@dataclass(frozen=True)
class Whitening:
    """What a fit found: rows, sums per dimension, components by falling eigenvalue, and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``L`` with ``L @ L.T == v`` for a symmetric, positive semidefinite ``v``; as many columns as its numeric rank.

    The pivot of each step is the largest diagonal entry that is left. Rows are in the order of ``v``; taken in the order
    of the pivots, they form a lower triangle.
    """
    left = v.astype(np.float64).copy()
    columns = []
    edge = len(v) * np.finfo(float).eps * max(np.diag(v).max(initial=0.0), 0.0)
    for _ in range(len(v)):
        p = int(np.diag(left).argmax())
        if left[p, p] <= edge:
            break
        column = left[:, p] / np.sqrt(left[p, p])
        columns.append(column)
        left -= np.outer(column, column)
        left[p, :] = left[:, p] = 0.0
    return np.array(columns).T.reshape(len(v), -1)


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``n`` columns in rounds of disjoint pairs, as in a tournament."""
    size = n + n % 2
    ring = list(range(size))
    out = []
    for _ in range(size - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: size // 2], reversed(ring[size // 2 :])) if max(a, b) < n]
        out.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray, most_sweeps: int = 60) -> np.ndarray:
    """``factor`` times a rotation, its columns orthogonal to double precision and in falling order of their norms."""
    w = factor.copy()
    if w.shape[1] < 2:
        return w
    edge = w.shape[0] * np.finfo(float).eps
    plan = rounds(w.shape[1])
    for _ in range(most_sweeps):
        turned = False
        for a, b in plan:
            x, y = w[:, a], w[:, b]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(xy) > edge * np.sqrt(xx * yy)
            if not turn.any():
                continue
            turned = True
            safe = np.where(turn, xy, 1.0)
            zeta = (yy - xx) / (2 * safe)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            w[:, a], w[:, b] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    return w[:, np.argsort(-(w * w).sum(0), kind="stable")]


def decompose(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` components (as rows) and eigenvalues of a covariance; the largest entry of each component is positive."""
    w = one_sided_jacobi(pivoted_cholesky(v))
    values = (w * w).sum(0)
    k = min(k, int((values > RANK * values.max(initial=0.0)).sum()))
    rows = (w[:, :k] / np.sqrt(values[:k])).T.reshape(k, len(v))
    signs = np.sign(rows[np.arange(k), np.abs(rows).argmax(1)]) if k else np.ones(0)
    return rows * signs[:, None], values[:k]


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, x``: the vectors that take part, as whole numbers, written down."""
    spark = vectors.sparkSession
    ship_package(spark)
    bound_batches(spark)
    entries = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    def fits(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)

    # The size keeps the test of the entries from null vectors.
    usable = entries.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fits))
    whole = F.transform("v", lambda c: F.floor(c * SCALE).cast("bigint") + OFFSET)
    table = written(usable.select("id", whole.alias("x")), "integer-vectors")
    common = table.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return table.where(F.size("x") == (common["d"] if common else 0))


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _totals(table: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sums per dimension; one row per dimension reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0), len(batch.column(0)[0]))
                n, sums = n + len(x), x.sum(0) + (0 if sums is None else sums)
        d = 0 if sums is None else len(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([] if sums is None else sums, pa.int64())],
            names=["i", "n", "s"],
        )

    parts = table.select("x").mapInArrow(add, "i int, n long, s long")
    found = parts.groupBy("i").agg(F.sum("n"), F.sum(F.col("s").cast("decimal(38,0)"))).orderBy("i").collect()
    return (found[0][1] if found else 0), tuple(int(s) for _, _, s in found)


def centre(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whole distances from the rounded mean, and the rest of the mean: ``x - sums / n`` is their exact difference."""
    near = [s // n for s in sums]
    rest = [(s - n * m) / n for s, m in zip(sums, near)]
    return x - np.array(near, np.int64), np.array(rest)


def _scatter(table: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Sum of the outer products of all centred vectors."""
    d = len(sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            y, rest = centre(_rows(batch.column(0), d), n, sums)
            z = y - rest
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_py(), np.float64).reshape(d, d)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = table.select("x").mapInArrow(products, "m binary").repartition(MERGE_TASKS).mapInArrow(merged, "m binary")
    return sum((np.frombuffer(r["m"], np.float64).reshape(d, d) for r in parts.collect()), np.zeros((d, d)))


def fit(table: DataFrame, k: int = COMPONENTS) -> Whitening:
    """The whitening of ``integer_vectors``. Only sums and the D x D scatter reach the driver."""
    n, sums = _totals(table)
    if not n:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    covariance = _scatter(table, n, sums) / n
    components, eigenvalues = decompose(covariance, k)
    return Whitening(n, sums, components, eigenvalues, float(np.trace(covariance)))


def deviations(y: np.ndarray, n: int, sums: tuple[int, ...], near: list[int]) -> pa.Array:
    """Exact sum over dimensions of ``(n * x - sums) ** 2`` for vectors ``x = y + near``."""
    rest = [s - n * m for s, m in zip(sums, near)]
    top = int(np.abs(y).max(initial=0)) * n + max(map(abs, rest), default=0)
    if top * top * max(1, y.shape[1]) < 1 << 63:
        u = y * n - np.array(rest, np.int64)
        return pa.array((u * u).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
    u = y.astype(object) * n - np.array(rest, object)
    # Beyond 38 digits there is no value.
    wide = [value if value < 10**38 else None for value in (u * u).sum(1)]
    return pa.array([None if value is None else str(value) for value in wide], pa.string()).cast(pa.decimal128(38, 0))


def whiten(table: DataFrame, fitted: Whitening) -> DataFrame:
    """``id, deviation decimal(38,0), whitened array<double>``: one row per vector, one entry per component."""
    n, sums = fitted.n, fitted.sums
    projection = (fitted.components / np.sqrt(fitted.eigenvalues)[:, None]).T
    near = [s // n for s in sums]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, rest = centre(_rows(batch.column(1), len(sums)), n, sums)
            w = (y - rest) @ projection
            offsets = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviations(y, n, sums, near), lists], names=["id", "deviation", "whitened"])

    kind = table.schema["id"].dataType.simpleString()
    return table.select("id", "x").mapInArrow(project, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity."""
    entry = [F.get("whitened", F.lit(i)) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = whitened.agg(*[F.covar_pop(entry[i], entry[j]) for i, j in pairs]).first()
    return max(abs(value - (i == j)) for (i, j), value in zip(pairs, found))


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """``<id_col>, component, n, deviation, whitened, explained, identity_error`` for each vector and component up to ``k``.

    Each entry becomes ``floor(1024 * entry) + 100000``. Vectors that are null or empty, or have an entry that is null, not
    finite or beyond 2 ** 42, or a length other than the commonest (of several, the longest), take no part; rows without an
    id, with equal ids or equal vectors do. All the others are fitted and whitened. An eigenvalue of at most 1e-10 of the
    largest counts as zero, and its component has no rows; so there are none for an empty table or equal vectors.
    ``deviation`` is a decimal of 38 digits. Other columns are not looked at, whatever their names.
    """
    table = integer_vectors(vectors, id_col, vector_col)
    fitted = fit(table, k)
    found = len(fitted.eigenvalues)
    kind = table.schema["id"].dataType.simpleString()
    if not found:
        schema = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {schema}")
    rows = written(whiten(table, fitted), "whitened")
    explained = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.eigenvalues])
    return rows.select(
        F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("i", "whitened"),
    ).select(
        id_col, (F.col("i") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("i")).alias("explained"), F.lit(identity_error(rows, found)).alias("identity_error"),
    )
