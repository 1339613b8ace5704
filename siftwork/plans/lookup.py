"""Joins of many rows with one row per key, where one key may hold a large share of the many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

_HASHABLE = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def lookup(many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "left", slices: int = 8) -> DataFrame:
    """Join ``many`` with ``one`` (a row per key) on ``keys``; ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.

    Where ``one`` comes out of an aggregate on the keys it is already partitioned by them, and a
    plain join would put every row of a hot key into the one task that holds it; AQE does not split
    such a join. So the rows of a key go to ``slices`` places by a hash of their own columns, and
    each row of ``one`` to all of them. Both sides are then shuffled for the join alone, which also
    lets AQE split further. When ``one`` is small Spark broadcasts it and shuffles nothing.
    """
    own = [f.name for f in many.schema if isinstance(f.dataType, _HASHABLE)]
    sliced = many.withColumn("_slice", F.pmod(F.xxhash64(*own), F.lit(slices)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice")
    return sliced.join(one.select("*", copies), [*keys, "_slice"], how).drop("_slice")
