"""Shuffling a table into shards in two passes, on Spark operations only.

Pass one scatters the rows into buckets of a stated size by a seeded hash; pass two lays the rows of each bucket out by a
Fisher-Yates shuffle in memory. The buckets follow one another, and the shards are equal stretches of that order, so a
bucket's task writes into one shard or its neighbours and the texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftwork.llm.common import Scratch, maybe_broadcast

SHARDS = 40
SEED = 20_26
BUCKET_BYTES = 24 << 20
ROW_BYTES = 16  # counted for each row besides its text
_BUCKET_GROUP = 4096  # buckets whose beginnings are summed up in one task


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("long") + F.lit(ROW_BYTES).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("size"), F.monotonically_increasing_id().alias("number"))
    # Copies of a text lie in different buckets, and so do rows that are equal in every column.
    return rows.select("row", "size", F.xxhash64(F.lit(seed), "row.doc_id", "row.text", "number").alias("hash"))


def _begins(counts: DataFrame) -> DataFrame:
    """How many rows lie before each bucket of ``(bucket, n)``: sums inside groups of buckets, on top of sums over the groups."""
    counts = counts.withColumn("part", F.expr(f"bucket div {_BUCKET_GROUP}"))
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.select("part", "bucket", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("begin"))
    return summed.join(parts, "part").select("bucket", (F.col("base") + F.col("begin")).alias("begin"))


def _by_hash(a: Column, b: Column) -> Column:
    return F.when(a["hash"] < b["hash"], -1).when(a["hash"] > b["hash"], 1).otherwise(0)


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, scratch: Scratch | None = None) -> tuple[DataFrame, str]:
    """Write all rows, in a random order, to shards whose row counts differ by one at most.

    Returns the written table (``row``: all columns of the document; ``size``, ``slot``, ``shard``) and its folder, which has
    a folder ``shard=k`` per shard. ``slot`` counts a shard's rows from 0. A null text has size 16. Rows without id, and rows
    that are equal in id and text, are dealt like any other, to all buckets. Rows are numbered once, when they are first
    written, so tasks that run again deal them as before; the same table read in the same splits gives the same shards for
    the same seed. An empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession, "shards")
    rows = scratch.keep(_sized(docs, seed), "rows", codec="zstd")
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    n_buckets = max(1, -(-(total or 0) // bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(n_buckets).cast("long")))
    begins = scratch.keep(_begins(rows.groupBy("bucket").agg(F.count("*").alias("n"))), "begins")
    held = rows.repartition(n_buckets, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("hash", "row", "size")).alias("held"))
    # Put in order first: rows reach a bucket, and buckets a task, in any order, and a task draws its random numbers in turn.
    held = held.sortWithinPartitions("bucket")
    laid = held.select("bucket", F.posexplode(F.shuffle(F.array_sort("held", _by_hash), F.expr(f"{seed}L"))).alias("at", "doc"))
    placed = laid.join(maybe_broadcast(begins, n_buckets), "bucket").select("doc.row", "doc.size", (F.col("begin") + F.col("at")).alias("place"))
    n = max(count, 1)
    # Shard s begins at place s * n div shards.
    placed = placed.withColumn("shard", F.expr(f"cast(((place + 1) * {shards}L - 1) div {n}L as int)"))
    placed = placed.withColumn("slot", F.expr(f"place - (shard * {n}L) div {shards}L")).drop("place")
    written = scratch.keep(placed, "shards", by=["shard"], codec="zstd")
    scratch.drop("rows", "begins")
    return written, scratch.path("shards")
