"""Sinks. Every writer works per partition; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscore.config import LOCAL_ZONE
from lexiscore.functions.timestamps import as_naive, format_timestamp

# Values are kept as they are: no trimming, doubled quotes inside quoted cells.
_CSV = {
    "escape": '"',
    "escapeQuotes": "true",
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def naive_times(df: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Every timestamp that carries a zone as wall-clock time in ``zone``; all other columns unchanged."""
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: as_naive(F.col(c), T.TimestampType(), zone) for c in zoned})


def format_created_at(df: DataFrame) -> DataFrame:
    """``created_at`` as text for report tools; what is no time becomes null. Unchanged without the column."""
    if "created_at" not in df.columns:
        return df
    naive = as_naive(F.col("created_at"), df.schema["created_at"].dataType)
    return df.withColumn("created_at", format_timestamp(naive))


def _cells(df: DataFrame) -> DataFrame:
    """Report-ready cells: formatted times, and flags spelled True / False."""
    flags = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]
    return format_created_at(df).withColumns({c: F.initcap(F.col(f"`{c}`").cast("string")) for c in flags})


def csv_rows(df: DataFrame) -> DataFrame:
    """One CSV line per row, as a table with the single column ``row``."""
    cells = _cells(df)
    return cells.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in cells.columns]), _CSV).alias("row"))


def csv_header(df: DataFrame) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n') else c for c in df.columns)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    _cells(df).write.mode(mode).options(header="true", encoding="UTF-8", **_CSV).csv(path)


def write_txt(df: DataFrame, path: str, mode: str = "error") -> None:
    """The CSV text in files named ``.txt``."""
    _cells(df).write.mode(mode).options(header="true", encoding="UTF-8", extension="txt", **_CSV).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    """Typed table with zone-free timestamps."""
    naive_times(df).write.mode(mode).parquet(path)


WRITERS = {"csv": write_csv, "txt": write_txt, "parquet": write_parquet}


def write_table(df: DataFrame, path: str, filetype: str = "csv", mode: str = "error") -> None:
    """Write by file type, in any letter case; an unknown type raises before any job starts."""
    writer = WRITERS.get(filetype.lower())
    if writer is None:
        raise ValueError(f"no writer for {filetype!r}; choose one of {sorted(WRITERS)}")
    writer(df, path, mode)
