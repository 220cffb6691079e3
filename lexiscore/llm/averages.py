"""Weighted means of long vectors that tasks have made, such as the networks that each has trained on its own rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Entries of a vector that travel and are averaged together.
BLOCK = 1 << 13
PARTS = "block int, task int, own binary, weight binary"


def parts(own: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's vector and the weight of each of its entries, as rows of ``PARTS``. Both have the same kind of float."""
    task = TaskContext.get().partitionId()
    for at in range(0, len(own), BLOCK):
        columns = [[at // BLOCK], [task], [own[at : at + BLOCK].tobytes()], [weight[at : at + BLOCK].tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "task", "own", "weight"])


def weighted_means(rows: DataFrame, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each entry over all tasks by its weights, and the mean weight, itself by weight.

    An entry without any weight stays what it was ``before``. Blocks are averaged where they meet; one vector reaches the driver.
    """
    kind = before.dtype

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        top, total, square = 0.0, 0.0, 0.0
        for own, weight in zip(table.column("own"), table.column("weight")):
            own, weight = (np.frombuffer(x.as_py(), kind).astype(np.float64) for x in (own, weight))
            top, total, square = top + weight * own, total + weight, square + weight**2
        safe = np.where(total > 0, total, 1)
        data = [[table.column("block")[0].as_py()], [0], [(top / safe).astype(kind).tobytes()], [(square / safe).astype(kind).tobytes()]]
        return pa.table([pa.array(c, t) for c, t in zip(data, table.schema.types)], schema=table.schema)

    means, weights = before.copy(), np.zeros_like(before)
    for row in rows.groupBy("block").applyInArrow(mean, PARTS).collect():
        at = slice(row["block"] * BLOCK, row["block"] * BLOCK + BLOCK)
        weights[at] = np.frombuffer(row["weight"], kind)
        means[at] = np.where(weights[at] > 0, np.frombuffer(row["own"], kind), before[at])
    return means, weights
