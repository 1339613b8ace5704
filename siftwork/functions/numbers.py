"""Lenient numbers: text that is not a number becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# Surrounding white space is allowed; type suffixes and hexadecimal forms, which a cast takes, are not.
_NUMBER = r"(?i)^\s*(?:[+-]?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:e[+-]?[0-9]+)?|[+-]?inf(?:inity)?|nan)\s*$"
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"


def lenient_double(c: Column) -> Column:
    """Decimal text, ``nan`` and ``inf`` in any case; else null."""
    t = c.cast("string")
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def lenient_long(c: Column) -> Column:
    """Whole part of a decimal text; null for text, nan, inf and values out of range."""
    return lenient_double(c).try_cast("long")


def whole_long(c: Column) -> Column:
    """Whole-number text only."""
    t = c.cast("string")
    return F.when(t.rlike(_WHOLE), t.try_cast("long"))


def whole_int(c: Column) -> Column:
    return whole_long(c).try_cast("int")


def is_finite(d: Column) -> Column:
    return ~F.isnan(d) & (F.abs(d) < float("inf"))
