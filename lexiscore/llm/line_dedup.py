"""Drop lines that many documents share, all but in one document each. DataFrame functions only.

Texts never travel by line: only (document, 128-bit line hash) rows do. A text is shuffled once, to its own positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHARS = 20
MIN_DOCS = 3
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII space around it and with A-Z in lower case; other letters keep their case."""
    trimmed = F.btrim(line, F.lit(_SPACE))
    # lower() is fast but also lowers letters beyond ASCII, so it serves lines that have none.
    ascii_only = F.octet_length(trimmed) == F.char_length(trimmed)
    return F.when(ascii_only, F.lower(trimmed)).otherwise(F.translate(trimmed, _UPPER, _LOWER))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"))


def _identity(text: Column) -> Column:
    """Rows that repeat an id with another text are told apart by it."""
    return F.xxhash64(text)


def dropped_positions(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """``_id, _same, _drop``: for each document that loses lines, their positions."""
    line = F.posexplode(F.split("_text", "\n")).alias("_pos", "_line")
    keyed = _lines(docs, id_col, text_col).select("_id", _identity(F.col("_text")).alias("_same"), line)
    keyed = keyed.select("_id", "_same", "_pos", line_key(F.col("_line")).alias("_key"))
    keyed = keyed.where(F.char_length("_key") >= min_chars)
    # Two seeds make 128 bits: at 10^12 lines a 64-bit hash alone would meet another line by chance.
    hashed = keyed.select(
        "_id", "_same", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2")
    )
    # First one row per key and document, dealt by both, so that a key in a third of all documents is no hot spot.
    per_doc = hashed.groupBy("_h1", "_h2", "_id").agg(F.count(F.lit(1)).alias("_n"))
    shared = per_doc.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("_keeper"))
    # The counts already lie by hash, and such a side cannot be copied for the parts of a hot hash. One more key has both
    # sides dealt for the join alone, so adaptive execution splits the rows of a line that very many documents have.
    both = F.xxhash64("_h2", "_h1").alias("_both")
    shared = shared.where(F.col("_docs") >= min_docs).select("_h1", "_h2", both, "_keeper")
    lost = hashed.select("*", both).join(shared, ["_h1", "_h2", "_both"]).where(~F.col("_id").eqNullSafe(F.col("_keeper")))
    return lost.groupBy("_id", "_same").agg(F.collect_set("_pos").alias("_drop"))


def drop_shared_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    n_lines: str | None = None,
    n_dropped: str | None = None,
) -> DataFrame:
    """``docs`` with each shared line kept in the document of the largest id only; other lines stay in order.

    A line is shared if its key has at least ``min_chars`` code points and stands in at least ``min_docs`` documents; all
    its repeats go, except in the keeper, where all stay. A null or empty text is one empty line and comes back empty. Rows
    that repeat an id count as one document. Rows with a null id count as one document that never is the keeper. No rows
    give no rows. All columns of ``docs`` stay; ``n_lines`` and ``n_dropped`` name columns to add for the numbers of lines
    before and dropped.
    """
    drops = dropped_positions(docs, id_col, text_col, min_chars, min_docs)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # What the join needs of the documents, under names of its own, beside all their columns in one struct.
    whole = docs.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").alias("_doc"), _identity(text).alias("_is"))
    joined = whole.join(drops, whole["_doc"].eqNullSafe(drops["_id"]) & (whole["_is"] == drops["_same"]), "left")
    row_text = F.coalesce(F.col("_row")[text_col], F.lit(""))
    lines = F.split(row_text, "\n")
    keep = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop")))
    kept = F.array_join(F.transform(keep, lambda i: F.get(F.col("_lines"), i)), "\n")
    named = joined.withColumn("_lines", lines)
    text_after = F.when(F.col("_drop").isNull(), row_text).otherwise(kept)
    columns = [
        text_after.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns
    ]
    if n_lines:
        columns.append(F.size("_lines").cast("long").alias(n_lines))
    if n_dropped:
        columns.append(F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias(n_dropped))
    return named.select(*columns)
