"""Scans of posts and lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscore.operators.lexicons import score_columns

# Cell texts that mean "missing" in a CSV file of posts.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def with_order(posts: DataFrame, order_col: str | None = None) -> DataFrame:
    """Add ``ord``, the row order that "first" and "keep first" refer to.

    Name a column that orders the rows wherever there is one. The default is the scan position, which is only as stable
    as the layout of the files, so it should be written down with the posts if they are read more than once.
    """
    order = F.col(order_col).cast("bigint") if order_col else F.monotonically_increasing_id()
    return posts.withColumn("ord", order)


def spread(scan: DataFrame) -> DataFrame:
    """Deal out the rows of a scan that has fewer splits than the cluster has cores.

    Scoring a text takes far longer than reading it, so a small table must not leave cores idle. A scan with splits for
    every core, which any large table has, is returned as it is. Counting splits runs no job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


# The types that a column of text cells may turn out to have, narrow to wide; every type holds what those before it hold, but
# a time holds no number. What fits none is text.
_LATTICE = ["bigint", "double", "timestamp_ntz"]
_TIME = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?\s*$"


def _fits(cell: Column) -> list[Column]:
    """Whether a cell can be read as each type of ``_LATTICE``."""
    whole = cell.rlike(r"^\s*[+-]?\d+\s*$") & F.trim(cell).try_cast("bigint").isNotNull()
    return [whole, cell.rlike(_NUMBER), cell.rlike(_TIME) & cell.try_cast("timestamp_ntz").isNotNull()]


def infer_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The narrowest type that holds all cells of each text column; columns of text or without any cell are left out.

    One aggregate over whole columns: per column and type, the number of cells that do not fit. One row comes back.
    """
    if not columns:
        return {}
    misfits = [
        F.count_if(F.col(f"`{c}`").isNotNull() & ~fits).alias(f"{i}_{kind}")
        for i, c in enumerate(columns)
        for kind, fits in zip(_LATTICE, _fits(F.col(f"`{c}`")))
    ]
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(columns)], *misfits).first()
    found = {c: next((kind for kind in _LATTICE if not row[f"{i}_{kind}"]), None) for i, c in enumerate(columns) if row[f"n_{i}"]}
    return {c: kind for c, kind in found.items() if kind}


def read_posts_csv(
    spark: SparkSession,
    path: str,
    types: dict[str, str] | None = None,
    order_col: str | None = None,
    multi_line: bool = True,
    flags: tuple[str, ...] = ("retweet",),
    infer: bool | None = None,
) -> DataFrame:
    """Posts from CSV, read as strings and cast as ``types`` says; a cell that does not fit becomes null.

    Without ``types``, every column gets the narrowest of whole number, number, time and text that holds all its cells
    (``infer_types``); ``infer`` says so explicitly, for the columns that ``types`` leaves out. Times are such as
    ``2024-01-31 10:00``; other forms stay text, which ``prepare_posts`` reads. A column of ``flags`` without a type is read
    as numbers if all its cells are numbers, since ``1.0`` is how a table with blank flags spells 1. A file with line breaks
    inside cells cannot be split among tasks. Set ``multi_line=False`` for large files without them, or keep large tables in
    Parquet.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    cells = {c: F.when(~F.col(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")) for c in raw.columns}
    infer = types is None if infer is None else infer
    types = types or {}
    untyped = [c for c in cells if c not in types and (infer or c in flags)]
    found = infer_types(raw.select(*[cells[c].alias(c) for c in untyped]), untyped)
    # A flag is a number or left to the rules of flags.
    found = {c: "double" if c in flags else kind for c, kind in found.items() if c not in flags or kind != "timestamp_ntz"}
    types = found | types
    typed = {c: (F.trim(cell) if types.get(c) == "bigint" else cell).try_cast(types[c]) if c in types else cell for c, cell in cells.items()}
    return spread(with_order(raw.select(*[col.alias(c) for c, col in typed.items()]), order_col))


def read_posts_parquet(spark: SparkSession, path: str, order_col: str | None = None) -> DataFrame:
    scan = spark.read.parquet(path)
    return spread(with_order(scan, order_col))


def read_lexicon(spark: SparkSession, path: str, weight_type: str = "bigint") -> DataFrame:
    """Wide lexicon from CSV: ``term`` and one weight column per side of each sub-driver; an empty weight is 0.

    Use ``weight_type="double"`` for fractional weights; a weight that does not fit the type raises.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    weights = [F.coalesce(F.col(c).cast(weight_type), F.lit(0).cast(weight_type)).alias(c) for c in score_columns(raw)]
    return raw.select("term", *weights)
