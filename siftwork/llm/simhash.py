"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

The terms of a text are its words and pairs of neighbouring words; each term's hash votes, with the term's weight, for the
signs of 128 bits. The radius is that of edited copies, so blocks that must agree are short: of ``radius + AGREE`` blocks of
bits, fingerprints within ``radius`` bits of one another agree in ``AGREE`` at least. A table for each of the first
``radius + 1`` blocks, keyed by it, brings together every such pair; inside a key, pairs are found by further blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftwork.llm.common import BLOCK_BYTES, Scratch, Texts, map_runs, maybe_broadcast, mix, text_session

BITS = 128
RADIUS = 3
# Three words changed in 200 differ by 9.5 bits in the mean, with a deviation of about 3.
COPY_RADIUS = 16
AGREE = 3
PAIR_WEIGHT, WORD_WEIGHT = 1.0, 0.5
BLOCK = 8192  # fingerprints of one table key that a task compares
DEEPER = (512, 16384)  # a key with more fingerprints is searched by one further block, or by two
PAIRS = 1 << 18  # pairs that are compared at a time
# Documents are sorted in stretches of about so many rows.
STRETCH_ROWS = 5000


def fingerprints(column: pa.Array) -> np.ndarray:
    """16 bytes per text, as two 64-bit numbers; a text without words has all bits 0."""
    t = Texts(column, lower=True)
    n = len(t.offsets) - 1
    h = t.hashes()
    pairs, first = t.windows(h, 2)
    owner = np.concatenate([np.repeat(np.arange(n), np.diff(t.first)), np.repeat(np.arange(n), np.diff(first))])
    terms = np.concatenate([h, mix(pairs + np.uint64(1))])
    weight = np.concatenate([np.full(len(h), WORD_WEIGHT), np.full(len(pairs), PAIR_WEIGHT)])
    with np.errstate(over="ignore"):
        key = mix(terms ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, at, times = np.unique(key, return_index=True, return_counts=True)
    by_text = np.argsort(owner[at], kind="stable")
    at, times = at[by_text], times[by_text]
    # Whole numbers add up to the same votes in any order, so equal texts get equal fingerprints.
    terms, weight = terms[at], np.rint(1024 * weight[at] * (1 + np.log(times)))
    halves = np.stack([mix(terms), mix(terms ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
    begin = np.searchsorted(owner[at], np.arange(n + 1))
    out = np.zeros((n, 2), np.uint64)
    for i in range(n):
        a, b = begin[i], begin[i + 1]
        if a == b:
            continue
        votes = np.zeros(BITS, np.float64)
        for k in range(a, b, 8192):
            w = weight[k : min(k + 8192, b)]
            bits = np.unpackbits(halves[k : k + len(w)].view(np.uint8), axis=1).reshape(len(w), BITS)
            votes += 2 * (w @ bits.astype(np.float64)) - w.sum()
        out[i] = np.packbits(votes > 0).view(np.uint64)
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine that the share of unequal bits estimates, 0 at least."""
    return np.clip(np.cos(np.pi * distance(a, b) / BITS), 0, 1)



def with_next(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (stretch, ahead, doc_id, tie, text), to be sorted so: stretches of the documents in the order of their ids.

    The first document of each stretch comes again, ``ahead``, at the end of the stretch before it (the first of all at the
    end of the last). Rows without id come first; rows of one id are ordered by a hash of their text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = rows.select("doc_id").filter("doc_id is not null")
    count = rows.count()
    parts = max(1, -(-count // STRETCH_ROWS))
    # Cuts between stretches: at most one number for every few thousand documents.
    cuts = sorted({int(x) for x in known.approxQuantile("doc_id", [k / parts for k in range(1, parts)], min(0.01, 0.2 / parts))}) if parts > 1 else []
    at = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_place(F.col("doc_id"), cuts))
    firsts = rows.select("doc_id", at.alias("s")).groupBy("s").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("id")).orderBy("s").collect()
    before = {r.id: firsts[k - 1].s for k, r in enumerate(firsts)}
    spark = docs.sparkSession
    heads = spark.createDataFrame([(i, s) for i, s in before.items()], "head long, back int")
    rows = rows.withColumn("s", at).withColumn("tie", F.xxhash64("text"))
    rows = rows.join(maybe_broadcast(heads, len(before)), F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("head"), "left")
    own = F.struct(F.col("s").alias("stretch"), F.lit(0).alias("ahead"))
    twice = F.array(own, F.struct(F.col("back").alias("stretch"), F.lit(1).alias("ahead")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("head").isNull(), F.array(own)).otherwise(twice)))
    return rows.select("at.stretch", "at.ahead", "doc_id", "tie", "text")


def _place(value: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below the value, by halving."""
    if not cuts:
        return F.lit(0)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < cuts[mid], search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(cuts))


def printed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp and edited_fp (two numbers each), near_edited, near_next for each row.

    The edited text is the text with its last quarter of characters replaced by the first as many of the next document's.
    """

    def edit(text: str, following: str) -> str:
        k = len(text) // 4
        return text[: len(text) - k] + following[:k]

    def work(rows: list[tuple], following: str) -> pa.RecordBatch:
        texts = [r[1] for r in rows] + [following]
        edited = [edit(a, b) for a, b in zip(texts, texts[1:])]
        prints = fingerprints(pa.array(texts, pa.large_string()))
        changed = fingerprints(pa.array(edited, pa.large_string()))
        own = prints[:-1]
        cols = [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            *(pa.array(x[:, k].view(np.int64)) for x in (own, changed) for k in (0, 1)),
            pa.array(likeness(own, changed)),
            pa.array(likeness(own, prints[1:])),
        ]
        return pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_chars", "edited_sha256", "a", "b", "ea", "eb", "near_edited", "near_next"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, stretch, closed = 0, None, False
        for batch in batches:
            for s, ahead, i, text in zip(*(batch.column(c).to_pylist() for c in ("stretch", "ahead", "doc_id", "text"))):
                text = text or ""
                if s != stretch:
                    held, size, stretch, closed = [], 0, s, False
                if closed:
                    continue
                if held and (ahead or size > BLOCK_BYTES):
                    yield work(held, text)
                    held, size = [], 0
                closed = bool(ahead)
                held.append((i, text))
                size += len(text)

    rows = with_next(docs, scratch)
    parts = rows.repartition("stretch").sortWithinPartitions("stretch", "ahead", F.col("doc_id").asc_nulls_first(), "tie")
    schema = "doc_id long, n_chars long, edited_sha256 string, a long, b long, ea long, eb long, near_edited double, near_next double"
    return parts.mapInArrow(apply, schema)


def _masks(radius: int) -> list[np.ndarray]:
    """The bits of each block; prints within the radius agree in ``AGREE`` blocks at least."""
    cuts = [k * BITS // (radius + AGREE) for k in range(radius + AGREE + 1)]
    ones = [((1 << (high - low)) - 1) << low for low, high in zip(cuts, cuts[1:])]
    return [np.array([x & ((1 << 64) - 1), x >> 64], np.uint64) for x in ones]


def _alike(p: np.ndarray, masks: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose prints agree in all of the masks, in pieces of a bounded size."""
    mask = np.bitwise_or.reduce(masks) if masks else np.zeros(2, np.uint64)
    key = mix((p[:, 0] & mask[0]) ^ mix((p[:, 1] & mask[1]) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    end = np.searchsorted(key[order], key[order], "right")
    count = end - np.arange(len(p)) - 1
    total = np.cumsum(count)
    at = 0
    while at < len(p):
        after = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = count[at:after]
        left = np.repeat(np.arange(at, after), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        if len(left):
            yield order[left], order[right]
        at = after


def near_pairs(p: np.ndarray, t: int, radius: int, side: np.ndarray | None = None) -> np.ndarray:
    """Of distinct prints that agree in block ``t``: how many others each has within the radius whose first equal block is t.

    With ``side`` only pairs of unequal sides count. Large groups are searched by further blocks, smaller ones by fewer. A
    pair counts for its first equal blocks alone, so once.
    """
    masks = _masks(radius)
    deeper = int(np.searchsorted(DEEPER, len(p))) if len(p) else 0
    found = np.zeros(len(p), np.int64)
    for more in combinations(range(t + 1, len(masks)), min(deeper, AGREE - 1)):
        use = (t, *more)
        for left, right in _alike(p, [masks[k] for k in use]):
            x = p[left, 0] ^ p[right, 0], p[left, 1] ^ p[right, 1]
            near = np.flatnonzero(np.bitwise_count(x[0]) + np.bitwise_count(x[1]) <= radius)
            x = np.stack([x[0][near], x[1][near]], axis=1)
            ok = np.ones(len(near), bool)
            for k in range(use[-1] + 1):
                ok &= (x & masks[k]).any(axis=1) != (k in use)
            if side is not None:
                ok &= side[left[near]] != side[right[near]]
            near = near[ok]
            found += np.bincount(left[near], minlength=len(p)) + np.bincount(right[near], minlength=len(p))
    return found


def neighbours(prints: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(a, b, n_near): for each distinct fingerprint, how many other ones lie within the radius.

    There are ``radius + AGREE`` blocks, so two such prints have one of the first ``radius + 1`` in common, and ``AGREE`` in
    all. A table per block brings them together, and a pair counts in the first whose block it agrees in. Keys that very many
    fingerprints share are compared part against part, each pair once.
    """
    distinct = scratch.keep(prints.select("a", "b").distinct(), "distinct")
    signed = [[int(x) for x in m.view(np.int64)] for m in _masks(radius)[: radius + 1]]
    key = [F.xxhash64(F.lit(k), F.col("a").bitwiseAND(F.lit(m[0])), F.col("b").bitwiseAND(F.lit(m[1]))) for k, m in enumerate(signed)]
    table = distinct.select("a", "b", F.posexplode(F.array(*key)).alias("t", "key"))
    hot = scratch.keep(table.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK), "hot")
    n_hot = hot.count()
    if n_hot:
        table = table.join(maybe_broadcast(hot, n_hot), ["t", "key"], "left")
        n = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int")
        table = table.withColumn("own", F.pmod(F.xxhash64("a", "b", F.lit("block")), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        table = table.select("a", "b", "t", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    else:
        table = table.withColumns({"own": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)})

    def count(run: pa.Table) -> pa.Table | None:
        p = np.stack([run.column(c).to_numpy().view(np.uint64) for c in ("a", "b")], axis=1)
        t, lo, hi = (run.column(c)[0].as_py() for c in ("t", "lo", "hi"))
        found = near_pairs(p, t, radius, None if lo == hi else run.column("own").to_numpy())
        some = found > 0
        return pa.table({"a": p[some, 0].view(np.int64), "b": p[some, 1].view(np.int64), "n": found[some]}) if some.any() else None

    pairs = map_runs(table, ["t", "key", "lo", "hi"], count, "a long, b long, n long", least=2)
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n_near"))


def _as_text(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def fingerprinted(docs: DataFrame, radius: int = COPY_RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near for each row.

    ``n_near`` counts the other distinct fingerprints of the table within the radius. A null text counts as empty; a text
    without words has fingerprint 0. After the last document comes the first; a single document follows itself.
    """
    spark = text_session(docs.sparkSession)
    scratch = Scratch(spark, "simhash")
    rows = scratch.keep(printed(docs, scratch), "prints")
    near = neighbours(rows, scratch, radius)
    rows = rows.join(near, ["a", "b"], "left")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _as_text(F.col("a"), F.col("b")).alias("fingerprint"),
        _as_text(F.col("ea"), F.col("eb")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
