"""Timestamps: parsing, local time, calendar columns. All results are TIMESTAMP_NTZ and independent of the session zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscore.config import LOCAL_ZONE, SOURCE_ZONE

# The known patterns, in the order in which they are tried.
COMMON_PATTERNS = [
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%d %H:%M",
    "%Y-%m-%d",
    "%d/%m/%Y %H:%M:%S",
    "%d/%m/%Y %H:%M",
    "%d/%m/%Y",
    "%m/%d/%Y %H:%M:%S",
    "%m/%d/%Y %H:%M",
    "%m/%d/%Y",
    "%Y/%m/%d %H:%M:%S",
    "%Y/%m/%d %H:%M",
    "%Y/%m/%d",
]
INFERRED = "inferred"

_FIELDS = {"Y": r"(\d{4})", "m": r"(\d{1,2})", "d": r"(\d{1,2})", "H": r"(\d{1,2})",
           "M": r"(\d{1,2})", "S": r"(\d{1,2})", "f": r"(\d{1,6})"}
_ISO = r"^\s*\d{4}-\d{1,2}(-\d{1,2}([T ].*)?)?\s*$"
_ZONE = r"(Z|UTC|[+-]\d{2}(:?\d{2})?)\s*$"
_TIMED_ZONE = r":\d{2}(\.\d+)?\s*" + _ZONE


def parse_pattern(text: Column, pattern: str) -> Column:
    """Parse by one strftime-style pattern; null where the text or the date does not fit."""
    order = re.findall(r"%(\w)", pattern)
    regex = "^" + re.sub(r"%(\w)", lambda m: _FIELDS[m[1]], pattern.replace(".", r"\.")) + "$"
    part = {field: f"${i}" for i, field in enumerate(order, start=1)}
    iso = f"{part['Y']}-{part['m']}-{part['d']}"
    if "H" in part:
        iso += f" {part['H']}:{part['M']}:{part.get('S', '00')}"
    if "f" in part:
        iso += f".{part['f']}"
    return F.when(text.rlike(regex), F.regexp_replace(text, regex, iso)).try_cast("timestamp_ntz")


def parse_iso(text: Column) -> Column:
    """Parse ISO forms. An offset is applied, text without one is taken as UTC."""
    zoned = text.rlike(_TIMED_ZONE)
    spaced = F.regexp_replace(text, r"\s+(Z|UTC|[+-]\d{2}(:?\d{2})?)\s*$", "$1")
    instant = F.when(zoned, spaced).try_cast("timestamp")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    shifted = F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)
    return F.when(text.rlike(_ISO), F.when(zoned, shifted).otherwise(text.try_cast("timestamp_ntz")))


_MONTHS = "jan,feb,mar,apr,may,jun,jul,aug,sep,oct,nov,dec"
_MONTH = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?)"
)
_WEEKDAY = "(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\\s+)?"
_CLOCK = r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)"
_HALF = r"(?:\s*([ap])\.?m\.?)?"
_OFFSET = r"(?:\s*(z|utc|gmt|[+-]\d{2}:?\d{2}))?"
_TIME = rf"(?:(?:,|\s+at|t)?\s*{_CLOCK}{_HALF}{_OFFSET})?"
# Forms that are read beside ISO. Each names the groups of year, month, day, clock, half of the day and offset.
_FORMS = [
    # Wed Oct 10 20:19:24 +0000 2018
    (rf"^\s*{_WEEKDAY}{_MONTH}\.?\s+(\d{{1,2}})\s+{_CLOCK}{_HALF}{_OFFSET}\s+(\d{{4}})\s*$", (6, 1, 2, 3, 4, 5)),
    # Oct 10, 2018 2:15 PM
    (rf"^\s*{_WEEKDAY}{_MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_TIME}\s*$", (3, 1, 2, 4, 5, 6)),
    # Wed, 10 October 2018 14:00:00 +0200
    (rf"^\s*{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{_MONTH}\.?,?[\s-]+(\d{{4}}){_TIME}\s*$", (3, 2, 1, 4, 5, 6)),
    # 31-01-2024, 31.01.2024 10:00
    (rf"^\s*(\d{{1,2}})[-.](\d{{1,2}})[-.](\d{{4}}){_TIME}\s*$", (3, 2, 1, 4, 5, 6)),
]
# 01/31/2024 02:15 PM; where the first number cannot be a month, it is the day.
_SLASHED = rf"^\s*(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_CLOCK}\s*([ap])\.?m\.?{_OFFSET})\s*$"
_COMPACT = r"^\s*(\d{4})(\d{2})(\d{2})(?:[Tt]?(\d{2})(\d{2})(\d{2})?(z|Z)?)?\s*$"


def _assembled(year: Column, month: Column, day: Column, clock: Column, half: Column, offset: Column) -> Column:
    """Zone-free UTC time of the parts, as texts; null where they are no date or time of day."""
    hour = F.regexp_extract(clock, r"^(\d{1,2}):", 1).try_cast("int")
    # With am and pm, hours run from 12 over 1 to 11.
    hour24 = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    rest = F.regexp_extract(clock, r"^\d{1,2}(:.*)$", 1)
    time = F.when(clock == "", F.lit("00:00")).otherwise(F.concat(F.lpad(hour24.cast("string"), 2, "0"), rest))
    local = F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), time).try_cast("timestamp_ntz")
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    hours = F.regexp_extract(offset, r"(\d{2}):?\d{2}$", 1).try_cast("int")
    minutes = F.regexp_extract(offset, r"(\d{2})$", 1).try_cast("int")
    shift = F.coalesce(sign * (hours * 60 + minutes), F.lit(0))
    return F.timestamp_add("MINUTE", -shift, local)


DAY_FIRST, MONTH_FIRST = "day", "month"
# Two short numbers before a year: which of them is the month, only a number above 12 can tell.
_TWO_ORDERS = r"^\s*(\d{1,2})([/.\-])(\d{1,2})\2(\d{4})(?:\D.*)?$"


def digit_shape(text: Column) -> Column:
    """The text with every digit as 9, for texts that may have the day or the month first; null for others."""
    return F.when(text.rlike(_TWO_ORDERS), F.regexp_replace(text, r"\d", "9"))


def order_evidence(text: Column) -> Column:
    """What a text proves about its column: the day comes first, the month does, or null."""
    first, second = (F.regexp_extract(text, _TWO_ORDERS, g).try_cast("int") for g in (1, 3))
    return F.when((first > 12) & (second <= 12), DAY_FIRST).when((second > 12) & (first <= 12), MONTH_FIRST)


def patterns_of(order: str | None) -> list[str]:
    """The known patterns, without those of the other order."""
    other = {DAY_FIRST: "%m/%d", MONTH_FIRST: "%d/%m"}.get(order)
    return [p for p in COMMON_PATTERNS if other is None or not p.startswith(other)]


def parse_named_forms(text: Column, order: str | None = None) -> Column:
    """Forms with month names, weekdays, AM and PM, dashes or dots, or digits alone; else null.

    By default the day is first with dashes or dots, and the month before AM and PM unless it is above 12; with ``order`` the
    same one is first in all of them.
    """
    low = F.lower(text)
    month_of = lambda part: F.coalesce(
        F.nullif(F.find_in_set(F.substring(part, 1, 3), F.lit(_MONTHS)), F.lit(0)).cast("string"), part
    )
    readings = []
    for regex, groups in _FORMS:
        if order == MONTH_FIRST and groups[:3] == (3, 2, 1) and _MONTH not in regex:
            groups = (3, 1, 2, *groups[3:])
        year, month, day, clock, half, offset = (F.regexp_extract(low, regex, g) for g in groups)
        readings.append(F.when(low.rlike(regex), _assembled(year, month_of(month), day, clock, half, offset)))
    first, second, year, clock, half, offset = (F.regexp_extract(low, _SLASHED, g) for g in range(1, 7))
    swap = F.lit(order == DAY_FIRST) if order else first.try_cast("int") > 12
    month, day = F.when(swap, second).otherwise(first), F.when(swap, first).otherwise(second)
    readings.append(F.when(low.rlike(_SLASHED), _assembled(year, month, day, clock, half, offset)))
    year, month, day, h, m, s, _ = (F.regexp_extract(low, _COMPACT, g) for g in range(1, 8))
    clock = F.when(h == "", F.lit("")).otherwise(F.concat_ws(":", h, m, F.when(s != "", s)))
    readings.append(F.when(low.rlike(_COMPACT), _assembled(year, month, day, clock, F.lit(""), F.lit(""))))
    return F.coalesce(*readings)


def parse_inferred(text: Column, order: str | None = None) -> Column:
    """ISO forms, then the forms of ``parse_named_forms``."""
    return F.coalesce(parse_iso(text), parse_named_forms(text, order))


def parse_best_effort(text: Column, order: str | None = None) -> Column:
    """First reading that fits: ISO forms, the known patterns in turn (those of ``order`` alone, if given), then named forms."""
    return F.coalesce(parse_iso(text), *[parse_pattern(text, p) for p in patterns_of(order)], parse_named_forms(text, order))


# Microseconds of a whole number in each unit; nanoseconds are cut.
EPOCH_UNITS = {"s": 1_000_000, "ms": 1000, "us": 1, "ns": 0.001}


def parse_epoch(number: Column, unit: str) -> Column:
    """Zone-free UTC time of a number since 1970 in ``unit`` (s, ms, us or ns)."""
    if unit not in EPOCH_UNITS:
        raise ValueError(f"unknown unit {unit!r}; choose one of {list(EPOCH_UNITS)}")
    exact = number.cast("decimal(38,6)")
    micros = F.floor(exact / 1000 if unit == "ns" else exact * EPOCH_UNITS[unit]).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def parse_timestamp(text: Column, fmt: str | None, order: str | None = None) -> Column:
    """``fmt`` is ``"inferred"``, ``"ISO8601"``, a strftime-style pattern, a Spark datetime pattern, or None for best effort.

    A Spark pattern without a zone reads UTC wall-clock times, whatever the zone of the session. ``order`` (``"day"`` or
    ``"month"`` first) holds for all rows of inferred and best-effort readings; None decides row by row.
    """
    if fmt is None:
        return parse_best_effort(text, order)
    if fmt == INFERRED:
        return parse_inferred(text, order)
    if fmt == "ISO8601":
        return parse_iso(text)
    if "%" in fmt:
        return parse_pattern(text, fmt)
    # Letters in quotes are text; of the others these name a zone.
    zoned = re.search("[VzOXxZ]", re.sub("'[^']*'", "", fmt))
    if not zoned:
        text, fmt = F.concat(text, F.lit(" +00:00")), f"{fmt} XXX"
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.try_to_timestamp(text, F.lit(fmt))), epoch)


def as_naive(col: Column, dtype: T.DataType, zone: str = SOURCE_ZONE) -> Column:
    """Wall-clock time in ``zone``; text is parsed by best effort, naive times and dates are kept."""
    if isinstance(dtype, T.TimestampType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        utc = F.timestamp_add("MICROSECOND", F.unix_micros(col), epoch)
        return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return col.cast("timestamp_ntz")
    return parse_best_effort(col.cast("string"))


def to_local(naive_utc: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC wall-clock to local wall-clock, with summer time."""
    return F.convert_timezone(F.lit(SOURCE_ZONE), F.lit(zone), naive_utc)


def calendar_parts(naive: Column) -> dict[str, Column]:
    """Calendar year, quarter and month, with the ISO week; null for null."""
    return {
        "year": F.year(naive),
        "quarter": F.quarter(naive),
        "month": F.month(naive),
        "week": F.weekofyear(naive),
    }


def format_timestamp(naive: Column) -> Column:
    return F.date_format(naive, "yyyy-MM-dd HH:mm:ss")
