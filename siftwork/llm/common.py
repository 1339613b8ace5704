"""What the corpus operators share: the scratch folder, runs of sorted rows, vectorised words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siftwork.plans.session import shared_folder

# Arrow batches of whole texts stay small: so many rows and bytes at most go to Python at once.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
# Texts are worked on in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
# A side of at most so many bytes may be broadcast; a row of a hash table costs its fixed-width columns and about so much more.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 40


def text_session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches; results do not depend on these settings."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for the time of a block; they are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables of one call in the shared folder that the cluster names; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, by: list[str] | None = None, codec: str | None = None) -> DataFrame:
        """Write a table, compressed by ``codec`` where one is named, and read it again."""
        self.paths[name] = self.path(name)
        writer = df.write.mode("overwrite")
        if codec:
            writer = writer.option("compression", codec)
        (writer.partitionBy(*by) if by else writer).parquet(self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            if self.paths.pop(name, None):
                at = jvm.org.apache.hadoop.fs.Path(self.path(name))
                at.getFileSystem(conf).delete(at, True)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose rows were counted, where all of its columns are numbers and its bytes are few; else leave the
    choice to Spark."""
    fixed = all(isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in df.schema)
    return F.broadcast(df) if fixed and rows * (ROW_BYTES + 8 * len(df.columns)) <= BROADCAST_BYTES else df


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches put together until they hold about ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.column(text).nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.column(text).nbytes
    if held:
        yield pa.concat_batches(held)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Tables of neighbouring rows that are equal in all (integer) keys; runs of fewer than ``least`` rows are left out.

    The rows must come sorted by the keys. Memory is that of the longest run and a batch.
    """
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if carry:
            last = carry[-1]
            new[0] = any(last.column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
        cuts = np.flatnonzero(new)
        if not len(cuts):
            carry.append(batch)
            continue
        if cuts[0] or carry:
            whole = pa.Table.from_batches([*carry, batch.slice(0, cuts[0])])
            if whole.num_rows >= least:
                yield whole
        ends = np.append(cuts[1:], batch.num_rows)
        for a, b in zip(cuts[:-1][ends[:-1] - cuts[:-1] >= least], ends[:-1][ends[:-1] - cuts[:-1] >= least]):
            yield pa.Table.from_batches([batch.slice(a, b - a)])
        carry = [batch.slice(cuts[-1])]
    if carry:
        whole = pa.Table.from_batches(carry)
        if whole.num_rows >= least:
            yield whole


def map_runs(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str, least: int = 1) -> DataFrame:
    """``fn`` on the rows of each group, one group in memory at a time; the caller bounds the groups' sizes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for run in runs(batches, keys, least):
            made = fn(run)
            if made is not None and made.num_rows:
                out.append(made)
                n += made.num_rows
                if n >= 20_000:
                    yield from pa.concat_tables(out).combine_chunks().to_batches()
                    out, n = [], 0
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(apply, schema)


# --- words ------------------------------------------------------------------------------------------------------------

# A word is a run of characters other than space and the five control characters 9 to 13.
GAPS = b"\x20\x09\x0a\x0b\x0c\x0d"
_GAP = np.zeros(256, bool)
_GAP[list(GAPS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
_MASK = (1 << 64) - 1


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        n = 1 << (n - 1).bit_length()
        back = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS, _INVERSES = (np.cumprod(np.array([1] + [b] * (n - 1), np.uint64)) for b in (_BASE, back))
    return _POWERS, _INVERSES


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


class Texts:
    """A column of texts as bytes, with the place of every word.

    ``data``: the bytes (A-Z lower-cased if asked); ``offsets``: where each text begins; ``starts``, ``ends``: of the words;
    ``first``: number of the first word of each text, with the total at the end. A null counts as empty.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        col = pc.fill_null(column.cast(pa.large_binary()), b"")
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]] if len(col) else np.zeros(0, np.uint8)
        self.offsets = offs - offs[0]
        self.data = _LOWER[data] if lower else data
        n = len(data)
        word = ~_GAP[data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~word[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~word[1:]
        self.word_bytes = word
        self.starts = np.flatnonzero(word & (before | edge[:-1]))
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.starts, self.ends)

    def windows(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n neighbouring words, and the number of the first window of each text (the total at the end)."""
        count = np.maximum(np.diff(self.first) - (n - 1), 0)
        first = np.concatenate([[0], np.cumsum(count)])
        if not first[-1]:
            return np.zeros(0, np.uint64), first
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], count)
        return chain(h, at, n), first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; the spans come in order and do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            end = max(at + 1, int(np.searchsorted(ends, low + (1 << 19), "right")))
            high = ends[end - 1]
            up, down = _tables(int(high - low) + 1)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
            s, e = starts[at:end] - low, ends[at:end] - low
            out[at:end] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            at = end
    return mix(out)


def chain(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n values that begin at each place, in order."""
    with np.errstate(over="ignore"):
        out = np.full(len(at), n, np.uint64)
        for k in range(n):
            out = (out + h[at + k]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
    return mix(out)


# --- connected components ---------------------------------------------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (u, v) reaches, by alternating stars.

    Each round is two aggregations and two joins over the edges that are left; the edges end as stars.
    """
    now = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), f"{label}-0")
    mark, turn = None, 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not seen[0] or tuple(seen) == mark:
            break
        mark, turn = tuple(seen), turn + 1
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}")
        now = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
