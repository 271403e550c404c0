"""Dates found inside text, shared by the page and text jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gigmesh.functions import temporal, text

# Patterns (fixed values).
MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
MONTH_DAY = rf"(?i)\b{MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\b(?:,?\s*(\d{{4}}))?"
DAY_MONTH_YEAR = rf"(?i)\b(\d{{1,2}})\s+{MONTH}\s+(\d{{4}})"
SLASHED = r"\b(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?\b"
DASHED = r"(\d{2})-(\d{2})-(\d{4})"
ISO = r"(\d{4})-(\d{2})-(\d{2})"
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
WEEKDAY_LINE = r"(?i)^(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday),?\s"


def _int(c: Column, pattern: str, group: int) -> Column:
    return text.number(F.regexp_extract(c, pattern, group))


def _month(c: Column, pattern: str, group: int) -> Column:
    return temporal.month_number(F.substring(F.regexp_extract(c, pattern, group), 1, 3))


_make = temporal.date_or_null


def _found(c: Column, pattern: str, read: Callable[[Column], Column]) -> Column:
    """The text is searched once; the parts are read from what was found, and nothing is read where nothing was."""
    return text.bound(F.regexp_extract(c, pattern, 0), lambda m: F.when(m != "", read(m)))


def _dated(year: Column, month: Column, day: Column, as_of, rule: str) -> Column:
    """Year, month and day are computed once; without a year the rule decides."""
    parts = F.struct(year.alias("y"), month.alias("m"), day.alias("d"))
    return text.bound(
        parts, lambda p: F.when(p["y"].isNotNull(), _make(p["y"], p["m"], p["d"])).otherwise(temporal.infer_year(p["m"], p["d"], as_of, rule))
    )


def month_day(c: Column, as_of, rule: str = "none") -> Column:
    """``Jan 24``, ``January 24, 2026``; without a year the rule decides."""
    return _found(c, MONTH_DAY, lambda m: _dated(_int(m, MONTH_DAY, 3), _month(m, MONTH_DAY, 1), _int(m, MONTH_DAY, 2), as_of, rule))


def day_month_year(c: Column) -> Column:
    return _found(c, DAY_MONTH_YEAR, lambda m: _make(_int(m, DAY_MONTH_YEAR, 3), _month(m, DAY_MONTH_YEAR, 2), _int(m, DAY_MONTH_YEAR, 1)))


def slashed(c: Column, as_of, rule: str = "none") -> Column:
    """``M/D``, ``M/D/YY`` or ``M/D/YYYY``."""

    def read(m: Column) -> Column:
        month, day, year = (_int(m, SLASHED, i) for i in (1, 2, 3))
        return _dated(F.when(year < 100, year + 2000).otherwise(year), month, day, as_of, rule)

    return _found(c, SLASHED, read)


def dashed(c: Column) -> Column:
    return _found(c, DASHED, lambda m: _make(_int(m, DASHED, 3), _int(m, DASHED, 1), _int(m, DASHED, 2)))


def iso(c: Column) -> Column:
    return _found(c, ISO, lambda m: _make(_int(m, ISO, 1), _int(m, ISO, 2), _int(m, ISO, 3)))


def compact(c: Column) -> Column:
    return _found(c, COMPACT, lambda m: _make(_int(m, COMPACT, 1), _int(m, COMPACT, 2), _int(m, COMPACT, 3)))


def midnight(c: Column) -> Column:
    return c.cast("timestamp_ntz")
