"""Mixing sources to target weights by temperature, on Spark operations only.

Each source's share of the tokens is raised to an exponent in [0, 1] and normalised. The exponent is bisected until the
weights reach a target entropy, or until the smallest source is repeated no more than a limit, whichever comes first. The
weights become token budgets: every document is used once at least, and a source is read in passes, each a seeded
permutation of its blocks, until its budget is used up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftwork.llm.common import Scratch, maybe_broadcast

ENTROPY = 0.9  # of the logarithm of the number of sources
REPEATS = 4.0  # passes over any source
BLOCK_TOKENS = 200_000
MOST_BLOCKS = 200_000  # blocks grow beyond BLOCK_TOKENS rather than become more than this, besides one per source
SEED = 20_26
# Each step of the search tries so many exponents in one job over the sources' totals.
_TRIES, _STEPS = 33, 5


def word_count(text: Column) -> Column:
    """Words of a text: runs of characters other than space and the control characters 9 to 13."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(gaps, " \t\n\x0b\x0c\r", "")).cast("long")


def source_key(source: Column) -> Column:
    """A key under which a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _at(exponents: list[float], shares: DataFrame) -> list:
    """Entropy of the weights and passes over the smallest source at each exponent; one row per exponent."""
    tried = shares.withColumn("exponent", F.explode(F.array(*map(F.lit, exponents))))
    tried = tried.withColumn("x", F.pow("share", "exponent"))
    got = tried.groupBy("exponent").agg(F.sum("x").alias("sum"), F.sum(F.col("x") * F.ln("x")).alias("xlnx"), F.min("share").alias("low"), F.max("share").alias("high"))
    entropy = F.ln("sum") - F.col("xlnx") / F.col("sum")
    return got.select("exponent", entropy.alias("entropy"), F.pow(F.col("low") / F.col("high"), F.col("exponent") - 1).alias("passes")).orderBy("exponent").collect()


def exponent(shares: DataFrame, entropy: float | None, repeats: float | None) -> float:
    """The smallest exponent whose weights have at most the target entropy and at most the allowed passes.

    Entropy and passes both fall as the exponent grows. 1 (the shares as they are) where even that has too much entropy.
    """
    n = shares.count()
    if n < 2:
        return 1.0
    goal = None if entropy is None else entropy * math.log(n)
    low, high = 0.0, 1.0
    for _ in range(_STEPS):
        grid = [low + (high - low) * k / (_TRIES - 1) for k in range(_TRIES)]
        good = [r.exponent for r in _at(grid, shares) if (goal is None or r.entropy <= goal) and (repeats is None or r.passes <= repeats)]
        high = min(good, default=high)
        if high == low:
            break
        low = grid[max(grid.index(high) - 1, 0)]
    return high


def schedule(
    docs: DataFrame,
    entropy: float | None = ENTROPY,
    repeats: float | None = REPEATS,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row for each use of a document: ``row`` (all its columns), ``tokens``, ``share``, ``weight``, ``exponent``,
    ``budget`` (tokens of its source), ``pass`` and ``block`` (from 0), ``place`` (of the block in its pass's permutation).

    The first pass holds every document. Of the last pass of a source, blocks are used in their order until the budget is
    reached; the block in which that happens is cut between documents, so a source overshoots by less than a document. A
    null source is a source; documents without words are used once; an empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    # The row keeps its text; counts and keys are beside it under names of their own.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("tokens"))
    totals = scratch.keep(rows.groupBy("key").agg(F.sum("tokens").alias("of_source")), "totals")
    whole, n_sources = totals.agg(F.sum("of_source"), F.count("*")).first()
    shares = totals.filter("of_source > 0").withColumn("share", F.col("of_source") / F.lit(float(whole or 1)))
    power = exponent(shares, entropy, repeats)

    norm = shares.agg(F.sum(F.pow("share", F.lit(power))), F.max("share")).first()
    size = max(block_tokens, (whole or 0) // MOST_BLOCKS)
    passes = F.pow(F.col("share") / F.lit(norm[1]), F.lit(power - 1))
    shares = shares.select(
        "key",
        "share",
        (F.pow("share", F.lit(power)) / F.lit(norm[0])).alias("weight"),
        F.greatest(F.round(F.col("of_source") * passes), F.col("of_source")).cast("long").alias("budget"),
    )
    sources = scratch.keep(
        totals.join(shares, "key", "left").select(
            "key",
            "of_source",
            F.coalesce("share", F.lit(0.0)).alias("share"),
            F.coalesce("weight", F.lit(0.0)).alias("weight"),
            F.coalesce("budget", F.lit(0)).cast("long").alias("budget"),
            F.greatest(F.ceil(F.col("of_source") / F.lit(size)), F.lit(1)).cast("long").alias("n_blocks"),
        ),
        "sources",
    )
    # A source's documents are dealt to its blocks by a seeded hash, so a large source is many blocks.
    dealt = rows.join(maybe_broadcast(sources.select("key", "n_blocks"), n_sources), "key")
    dealt = dealt.withColumn("order", F.xxhash64(F.lit(seed), "row.doc_id", "row.text"))
    dealt = dealt.withColumn("block", F.pmod("order", "n_blocks")).drop("n_blocks")
    blocks = scratch.keep(dealt.groupBy("key", "block").agg(F.sum("tokens").alias("in_block")), "blocks")

    # Windows over blocks, not documents: their number is bounded above.
    blocks = blocks.join(maybe_broadcast(sources, n_sources), "key")
    last = F.when(F.col("of_source") > 0, F.floor(F.col("budget") / F.col("of_source"))).otherwise(F.lit(0))
    used = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    by_pass = Window.partitionBy("key", "pass").orderBy(F.xxhash64(F.lit(seed), "pass", "block"), "block")
    used = used.withColumn("place", F.row_number().over(by_pass) - 1)
    before = F.coalesce(F.sum("in_block").over(by_pass.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # What is left of the budget when the block begins; the first pass is whole.
    used = used.withColumn("left", F.col("budget") - F.col("pass") * F.col("of_source") - before)
    used = used.filter((F.col("pass") == 0) | (F.col("left") > 0))
    used = used.withColumn("cut", (F.col("pass") > 0) & (F.col("left") < F.col("in_block")))
    used = scratch.keep(used.select("key", "block", "pass", "place", "left", "cut", "share", "weight", "budget"), "used")
    n_used = used.count()

    out = dealt.join(maybe_broadcast(used, n_used), ["key", "block"])
    whole_blocks = out.filter(~F.col("cut"))
    # One block per source at most is cut; its documents are taken in the order of their hash.
    running = Window.partitionBy("key", "block").orderBy("order", "row.doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("tokens").over(running), F.lit(0))
    part = out.filter("cut").withColumn("ahead", ahead).filter(F.col("ahead") < F.col("left")).drop("ahead")
    return whole_blocks.unionByName(part).select("row", "tokens", "share", "weight", F.lit(power).alias("exponent"), "budget", "pass", "block", "place")
