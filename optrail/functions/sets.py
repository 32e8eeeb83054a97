"""Enabled sets as sorted arrays of distinct strings, so that equal arrays are equal sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT_TYPE = "struct<a:string,en:array<string>>"

#: Fixed values. Names under which an event table may hold its enabled sets, in the order in which they are looked for.
ENABLED_NAMES = ("enabled_activities", "enabled", "en", "translucent:enabled", "enabledActivities")


def empty_set() -> Column:
    return F.array().cast("array<string>")


def as_set(values: Column) -> Column:
    """Stripped, non-empty, distinct and sorted; null counts as empty."""
    stripped = F.transform(values, lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.coalesce(F.filter(stripped, lambda x: x.isNotNull() & (x != "")), empty_set())))


def parse_set(cell: Column, separator: str = ",") -> Column:
    """A cell with separated names as a set; the separator is taken literally, not as a pattern."""
    return as_set(F.split(cell, F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E"))))


def with_executed(en: Column, a: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(en, empty_set()), F.array(a)))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def minus(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def common(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def shown(en: Column) -> Column:
    """A set as text, the same for any engine."""
    return F.array_join(en, ",")


def detect_enabled(columns: list[str]) -> str | None:
    """The first known name of an enabled column among ``columns``."""
    return next((name for name in ENABLED_NAMES if name in columns), None)
