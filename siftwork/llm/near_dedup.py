"""Near-duplicate documents by b-bit MinHash.

Each document's set of distinct five-word shingles gives minima under many hash functions. Bands of minima bring candidates
together; of each minimum only the low bits are kept, packed, and the similarity of candidates is estimated by counting
equal cells and correcting for chance. Candidates above a loose cut form clusters, and inside the clusters every pair is
settled on the full sets, so the estimate never decides a link.

No pair is ever written out: a bucket yields one edge per member, a cluster one link per member. Buckets and clusters that
are too large for a task are cut into blocks, and each two blocks meet in a task, so none of their pairs is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from siftwork.llm.common import Scratch, Texts, blocks, chain, components, map_runs, maybe_broadcast, text_session

WORDS = 5
SHARE = 85  # percent of the union that the intersection must reach
# 24 bands of 6 minima miss a pair at the limit once in 85,000; the estimate's standard error there is 0.035,
# so the cut lies more than five of them below.
BANDS, ROWS, BITS = 24, 6, 2
CUT = 0.66
BLOCK = 2048  # members of a bucket that one task compares
CLUSTER_SHINGLES = 1_500_000  # shingles of a cluster that one task holds

_K = BANDS * ROWS
_RNG = np.random.default_rng(20_24)
_A = (_RNG.integers(0, 1 << 32, _K, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, _K, dtype=np.uint32)[:, None]
_CELLS = 64 // BITS
_WORDS64 = -(-_K // _CELLS)
_LOW = np.uint64(sum(1 << (BITS * i) for i in range(_CELLS)))


def shingle_sets(texts: Texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of one to four words has one, an empty text none."""
    h = texts.hashes()
    windows, first = texts.windows(h, WORDS)
    out = []
    for i, n in enumerate(np.diff(texts.first)):
        if n >= WORDS:
            out.append(np.unique(windows[first[i] : first[i + 1]]))
        elif n:
            out.append(chain(h, texts.first[i : i + 1], int(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    h = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(_K, 0xFFFFFFFF, np.uint32)
    for a in range(0, h.shape[1], 2048):
        np.minimum(out, (_A * h[:, a : a + 2048] + _B).min(axis=1), out=out)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of spread minima, packed into words of 64 bits."""
    cells = (low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    full = np.zeros(_WORDS64 * _CELLS, np.uint64)
    full[:_K] = cells
    shift = (np.arange(_CELLS) * BITS).astype(np.uint64)
    return np.bitwise_or.reduce(full.reshape(_WORDS64, _CELLS) << shift, axis=1)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of a packed signature to others, corrected for cells that are equal by chance."""
    x = many ^ one
    for _ in range(BITS.bit_length() - 1):
        x = x | (x >> np.uint64(1))
    differ = np.bitwise_count(x & _LOW).sum(axis=1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return ((1 - differ / _K) - chance) / (1 - chance)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp (hash of the whole set), keys (a key per band), sig (packed low bits)."""

    def apply(batches):
        for b in blocks(batches, "text"):
            ids, n, fp, keys, sig = b.column("doc_id"), [], [], [], []
            for s in shingle_sets(Texts(b.column("text"), lower=True)):
                n.append(len(s))
                if not len(s):
                    fp.append(None), keys.append(None), sig.append(None)
                    continue
                m = minima(s)
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                rows = np.ascontiguousarray(m.reshape(BANDS, ROWS))
                keys.append(np.array([xxhash.xxh3_64_intdigest(r.tobytes(), seed=k) for k, r in enumerate(rows)], np.uint64).view(np.int64))
                sig.append(packed(m).tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "fp", "keys", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, "doc_id long, n_shingles long, fp binary, keys array<long>, sig binary")


def _stars(nodes: np.ndarray, linked) -> pa.Table | None:
    """Edges from each member of a component to its smallest member; ``linked(i, rest)`` marks what i is linked with."""
    rest = np.arange(1, len(nodes))
    group, u, v = [0], [], []
    while True:
        k = 0
        while k < len(group) and len(rest):
            hit = linked(group[k], rest)
            group.extend(rest[hit])
            rest = rest[~hit]
            k += 1
        if len(group) > 1:
            members = nodes[group]
            u.append(members)
            v.append(np.full(len(members), members.min()))
        if not len(rest):
            break
        group, rest = [rest[0]], rest[1:]
    if not u:
        return None
    return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})


def _alike(run: pa.Table) -> pa.Table | None:
    """Members of a bucket that seem similar."""
    nodes = run.column("rep").to_numpy()
    sig = np.frombuffer(b"".join(run.column("sig").to_pylist()), np.uint64).reshape(-1, _WORDS64)
    return _stars(nodes, lambda i, rest: estimates(sig[i], sig[rest]) >= CUT)


def _settled(run: pa.Table) -> pa.Table | None:
    """Members of a cluster that are linked on their full sets."""
    nodes = run.column("rep").to_numpy()
    sets = [s for b in run.to_batches() for s in shingle_sets(Texts(b.column("text"), lower=True))]
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    has = np.zeros(int(flat.max()) + 1 if len(flat) else 1, np.int32)

    def linked(i: int, rest: np.ndarray) -> np.ndarray:
        mine = flat[begin[i] : begin[i + 1]]
        low, high = np.minimum(size[i], size[rest]), np.maximum(size[i], size[rest])
        out = (low > 0) & (100 * low >= SHARE * high)
        near = rest[out]
        if len(near):
            has[mine] = 1
            spots = np.concatenate([flat[begin[j] : begin[j + 1]] for j in near])
            both = np.add.reduceat(has[spots], np.concatenate([[0], np.cumsum(size[near])[:-1]]))
            has[mine] = 0
            out[out] = 100 * both >= SHARE * (size[i] + size[near] - both)
        return out

    return _stars(nodes, linked)


def _in_blocks(df: DataFrame, count: str, limit: int) -> DataFrame:
    """Rows with ``lo`` and ``hi``: a group of up to ``limit`` is one block; of a larger one, each two blocks meet."""
    n = F.ceil(F.col(count) / limit).cast("int")
    mine = F.when(n <= 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), n).cast("int"))
    out = df.withColumn("_n", n).withColumn("_b", mine)
    # Two blocks form a pair; a group of two blocks or more needs no task for a block alone.
    other = F.when(F.col("_n") <= 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("_n") - 1), F.col("_b")))
    out = out.withColumn("_o", F.explode(other))
    return out.withColumn("lo", F.least("_b", "_o")).withColumn("hi", F.greatest("_b", "_o")).drop("_n", "_b", "_o", count)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text; other columns are not read).

    A document without words, or a null text, has no shingle and is linked with nothing. Rows of one doc_id are one
    document: they are in one component. A row without doc_id takes no part: its component is null and it is kept.
    """
    spark = text_session(docs.sparkSession)
    scratch = Scratch(spark, "near")
    sig = scratch.keep(signatures(docs), "sig")
    known = sig.filter("doc_id is not null and fp is not null")
    # Equal sets are one representative: the smallest id stands for all.
    reps = scratch.keep(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "reps")

    bands = reps.select("rep", "sig", F.explode("keys").alias("bucket"))
    large = scratch.keep(bands.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK), "large")
    n_large = large.count()
    if n_large:
        bands = bands.join(maybe_broadcast(large, n_large), "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        bands = _in_blocks(bands, "n", BLOCK)
    else:
        bands = bands.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    edges = map_runs(bands.select("bucket", "lo", "hi", "rep", "sig"), ["bucket", "lo", "hi"], _alike, "u long, v long", least=2)
    cluster = scratch.keep(components(edges, scratch, "edges"), "cluster")

    # The texts of clusters only come together by cluster.
    members = cluster.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"))
    mass = members.join(known.select("doc_id", "n_shingles").distinct(), "doc_id").groupBy("cluster").agg(F.sum("n_shingles").alias("n"))
    members = scratch.keep(members.join(mass, "cluster"), "members")
    n_members, many = members.agg(F.count("*"), F.max("n")).first()
    if not n_members:
        links = None
    else:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        texts = texts.join(maybe_broadcast(members, n_members), "doc_id").withColumnRenamed("doc_id", "rep").filter(F.length("text") > 0)
        texts = _in_blocks(texts, "n", CLUSTER_SHINGLES).select("cluster", "lo", "hi", "rep", "text")
        links = scratch.keep(map_runs(texts, ["cluster", "lo", "hi"], _settled, "u long, v long", least=2), "links")
        if many > CLUSTER_SHINGLES:
            links = scratch.keep(components(links, scratch, "parts"), "roots").select(F.col("node").alias("u"), F.col("root").alias("v"))
    out = sig.select("doc_id", "n_shingles", "fp").join(reps.select("fp", "rep"), "fp", "left")
    # An id with several texts links the representatives of all its sets.
    several = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").select("doc_id")
    several = scratch.keep(out.filter("rep is not null").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct(), "several")
    if several.head():
        links = several if links is None else links.select("u", "v").union(several)
        links = scratch.keep(components(links, scratch, "ids"), "linked").select(F.col("node").alias("u"), F.col("root").alias("v"))
    if links is None:
        out = out.withColumn("v", F.lit(None).cast("long"))
    else:
        out = out.join(links.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("v")), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("v", "rep", "doc_id"))
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
