"""Boolean flags from columns of any type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strings that count as true; all others are false.
TRUE_STRINGS = ["true", "1", "yes"]


def coerce_flag(col: Column, dtype: T.DataType) -> Column:
    """Boolean without nulls. Numbers are cut to whole numbers first, so 0.5 is false."""
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(col, F.lit(False))
    if isinstance(dtype, T.NumericType):
        number = F.nanvl(col, F.lit(0.0)) if isinstance(dtype, (T.FloatType, T.DoubleType)) else col
        return F.coalesce((number >= 1) | (number <= -1), F.lit(False))
    cleaned = F.lower(F.regexp_replace(F.regexp_replace(col.cast("string"), r"^\s+", ""), r"\s+$", ""))
    return F.coalesce(cleaned.isin(*TRUE_STRINGS), F.lit(False))


def looks_like_repost(text: Column) -> Column:
    return F.coalesce(F.startswith(text, F.lit("RT")), F.lit(False))
