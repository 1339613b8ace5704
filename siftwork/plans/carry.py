"""Last known and next known values per key, through an ordered log cut into buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def carry_forward(
    df: DataFrame, key: str, seq: str, values: dict[str, Column], span: int = 1_000_000
) -> DataFrame:
    """Add each of ``values`` as its last non-null value at or before the row.

    A plain running window would put a whole key in one task. Here a key's log is cut into buckets
    of ``span`` consecutive ``seq`` values: each bucket yields its last values (a partial aggregate), one small running window
    over the bucket summaries gives every bucket its starting values, and a second window runs
    inside buckets only. A key that holds a third of all rows is spread over all of its buckets.

    ``seq`` is a whole number that grows with the log; ``key`` is not null.
    """
    cut = df.withColumn("_bucket", F.floor(F.col(seq) / span))
    for name, value in values.items():
        cut = cut.withColumn(f"_in_{name}", value)

    last = [
        F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col(seq))).alias(f"_last_{n}")
        for n in values
    ]
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(key, "_bucket")
        .agg(*last)
        .select(
            key, "_bucket", *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_start_{n}") for n in values]
        )
    )

    inside = (
        Window.partitionBy(key, "_bucket").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = cut.join(starts, [key, "_bucket"], "left")
    picked = [
        F.coalesce(F.last(f"_in_{n}", ignorenulls=True).over(inside), F.col(f"_start_{n}")).alias(n) for n in values
    ]
    return out.select(*[F.col(c) for c in df.columns], *picked)


def next_known(df: DataFrame, key: str, at: str, order: Sequence[Column], value: Column, name: str, span: int) -> DataFrame:
    """Add ``name``, the first non-null ``value`` at or after the row; values never fall along the log.

    The mirror of ``carry_forward``: a key's log is cut into buckets of ``span`` of the whole number ``at``. Each bucket
    yields its smallest value (a partial aggregate), a window over these summaries gives every bucket the first value of
    later buckets, and a second window, by ``order``, runs inside buckets only, so a hot key is spread over its buckets.
    """
    cut = df.withColumns({"_bucket": F.floor(F.col(at) / span), "_value": value})
    later = Window.partitionBy(key).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    ends = cut.groupBy(key, "_bucket").agg(F.min("_value").alias("_least")).select(key, "_bucket", F.min("_least").over(later).alias("_later"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = cut.withColumn("_inside", F.min("_value").over(inside)).alias("c").join(ends.alias("e"), (F.col(f"c.{key}").eqNullSafe(F.col(f"e.{key}"))) & (F.col("c._bucket") == F.col("e._bucket")), "left")
    return found.select(*[F.col(f"c.{c}") for c in df.columns], F.coalesce("c._inside", "e._later").alias(name))
