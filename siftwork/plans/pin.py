"""Keeping expensive expressions from being computed more than once.

Spark moves filters below projections by copying the projected expressions into them, merges
adjacent projections, and puts a non-empty test of a computed array below an ``explode`` of it. For
cheap expressions that is right; for JSON parsing, regexes and header look-ups it multiplies the
work. The plan shapes here prevent it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def pinned(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later filters and projections read but never recompute.

    The columns come out of a generator with exactly one row, which the optimizer does not look into.
    """
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select(*[F.col(c) for c in df.columns if c not in cols], F.inline(F.array(row)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exploded(df: DataFrame, keep: list[str], array: Column, pos: str, item: str) -> DataFrame:
    """``posexplode`` of a computed array that is evaluated once; null and empty arrays give no rows.

    The outer form gets no copied non-empty test. A position is null only where there is no item.
    """
    out = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return out.filter(F.col(pos).isNotNull())
