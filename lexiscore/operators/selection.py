"""The n-th smallest key of a table of any size, for keys of any type that has an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscore.session import written

# Keys sampled per turn; each turn leaves about a pivot's share of the keys.
PIVOTS = 64
# Up to this many keys are sorted in one task.
FEW = 1000


def has_order(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(has_order(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return has_order(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def ordered_key(df: DataFrame, columns: list[str]) -> Column:
    """One value that orders rows by ``columns``, nulls last, and rows that tie in them by a hash of their content."""
    unordered = [c for c in columns if not has_order(df.schema[c].dataType)]
    if unordered:
        raise ValueError(f"columns without an order: {unordered}")
    fields = [f(F.col(f"`{c}`")) for c in columns for f in (Column.isNull, lambda col: col)]
    content = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return F.struct(*[field.alias(f"k{i}") for i, field in enumerate([*fields, content])])


def _interval(pivots: Column, key: Column) -> Column:
    """Twice the number of pivots below the key, and one more if it equals a pivot: a number that rises with the key.

    The sorted pivots are searched by halves; a place beyond them has no pivot and so none below the key.
    """
    steps = F.array(*[F.lit(PIVOTS >> i) for i in range(PIVOTS.bit_length())])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(pivots, at + step - 1) < key, at + step).otherwise(at))
    placed = F.transform(F.array(below), lambda at: 2 * at + F.coalesce(F.get(pivots, at) == key, F.lit(False)).cast("int"))
    return F.get(placed, F.lit(0))


def nth_key(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A table of one row with the ``n``-th smallest ``key``, and how many of the rows that equal it are among the first ``n``.

    ``n`` is at least 1 and at most the number of rows. Each turn samples pivots, counts the keys at each pivot and between
    two, and goes on with those of one interval, which are written down. Only counts reach the driver, and keys are never
    moved to be sorted until ``FEW`` are left; a key that very many rows share becomes a pivot and ends the search.
    """
    while keys.count() > FEW:
        sample = keys.orderBy(F.rand(20240229)).limit(PIVOTS)
        pivots = written(sample.agg(F.sort_array(F.collect_set("key")).alias("pivots")), "pivots")
        placed = keys.withColumn("pivots", pivots.scalar()).select("key", _interval(F.col("pivots"), F.col("key")).alias("interval"))
        for interval, rows in placed.groupBy("interval").count().orderBy("interval").collect():
            if n <= rows:
                break
            n -= rows
        if interval % 2:
            return pivots.select(F.get("pivots", F.lit(interval // 2)).alias("edge")), n
        keys = written(placed.where(F.col("interval") == interval).select("key"), "interval")
    first = keys.orderBy("key").limit(n)
    edge = written(first.agg(F.max("key").alias("edge")), "edge")
    return edge, first.where(F.col("key") == edge.scalar()).count()
