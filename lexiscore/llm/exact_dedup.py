"""Exact dedup with a heavy-hitter split.

Each task sums up the digests it reads in a Misra-Gries summary of bounded size. Summaries add up: a digest that makes up
more than 2 / (counters + 1) of all rows has a summed count of at least 1 / (counters + 1) of them, and no more than
counters + 1 digests can. Those few are counted exactly, and their winners are broadcast, so rows of a frequent text are
judged where they are and never meet in one task. All other digests take an ordinary shuffle.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscore.llm.words import bound_batches
from lexiscore.session import ship_package, written

COUNTERS = 8191


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is empty."""
    whole = F.coalesce(text, F.lit(""))
    # Of a text in ASCII alone, lower() changes just these letters, and far faster.
    plain = F.octet_length(whole) == F.length(whole)
    return F.when(plain, F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))


def cut(counts: dict, counters: int) -> dict:
    """At most ``counters`` of the counts, all less the largest one that has to go: the merge of Misra-Gries summaries."""
    if len(counts) <= counters:
        return counts
    spent = sorted(counts.values(), reverse=True)[counters]
    return {key: n - spent for key, n in counts.items() if n > spent}


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            counted = pc.value_counts(batch.column(0))
            for key, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist()):
                held[key] = held.get(key, 0) + n
            held = cut(held, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["digest", "least"]
        )

    return run


def frequent_digests(placed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``digest, least``: at most ``counters + 1`` digests, among them all with over ``2 / (counters + 1)`` of the rows."""
    total = placed.count()
    sums = placed.select("digest").mapInArrow(_summaries(counters), "digest binary, least long")
    return sums.groupBy("digest").agg(F.sum("least").alias("least")).where(F.col("least") * (counters + 1) >= total)


def _winners(rows: DataFrame) -> DataFrame:
    """Number of rows and the row that stays, for each digest."""
    best = F.max(F.struct("id", "row")).alias("best")
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best)
    return groups.select("digest", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"))


def _marked(placed: DataFrame, counters: int) -> DataFrame:
    """All rows of ``placed`` with ``group_size, keep_id, keep_row``."""
    candidates = F.broadcast(written(frequent_digests(placed, counters), "frequent-digests"))
    verified = _winners(placed.join(candidates.select("digest"), "digest", "left_semi"))
    # No more rows than candidates, of some 60 bytes.
    winners = F.broadcast(written(verified, "frequent-winners"))
    frequent = placed.join(winners, "digest")
    rest = placed.join(winners.select("digest"), "digest", "left_anti")
    # The second key has both sides shuffled for this join, which adaptive execution may then split.
    by_hash = F.xxhash64("digest").alias("h")
    ordinary = rest.select("*", by_hash).join(_winners(rest).select("*", by_hash), ["digest", "h"]).drop("h")
    return frequent.unionByName(ordinary)


def _placed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """One row per document with its digest and a row number that is written down, so that equal rows can be told apart."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    digest = F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256)).alias("digest")
    row = F.monotonically_increasing_id().alias("row")
    return written(docs.select(F.col(f"`{id_col}`").alias("id"), digest, row, *more), "digests")


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``<id_col>, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal if they are after lower-casing A-Z; null is the empty text, and empty texts equal each other. Of equal
    texts the row of the largest id stays (a null id is the smallest); of rows that repeat that id just one does. The digest
    is that of the whole normalised text, of any length, in UTF-8. Other columns are not looked at, whatever their names; an
    empty table gives no rows.
    """
    marked = _marked(_placed(docs, id_col, text_col), counters)
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    return marked.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), sha)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that ``group_copies`` keeps, all columns; rows of infrequent texts are shuffled once."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    marked = _marked(_placed(docs, id_col, text_col, whole), counters)
    return marked.where("row = keep_row").select("whole.*")
