"""URL verdicts from a sorted digest array.

The list's entries are hashed with 64-bit xxhash, sorted, and written in shards to the shared folder: digests, offsets and
full strings in one file each. A task maps the shards it needs into memory, probes them by a vectorised binary search, and
confirms every hit against the stored string, so a collision of digests never decides.

An entry is a host and the beginning of a path, as one string: ``example.com/shop/`` fits that host and its subdomains
where the path begins with ``/shop/``; ``example.com`` fits every path.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwork.llm.common import Scratch, text_session

# The rules, as (entry, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Hosts that have one of these words between dots and hyphens go on the list.
BLOCKED_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "track", "viagra", "xxx")
SHARD_ENTRIES = 4_000_000


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_hosts(hosts: DataFrame, words: tuple[str, ...] = BLOCKED_WORDS) -> DataFrame:
    """Entries that block the hosts (column ``host``) that hold a listed word."""
    pattern = rf"(^|[.-])({'|'.join(words)})([.-]|$)"
    return hosts.select("host").distinct().filter(F.col("host").rlike(pattern)).select(F.col("host").alias("entry"), F.lit("block").alias("verdict"))


@dataclass
class UrlList:
    """Where the shards of a list are, and the smallest digest of each."""

    paths: list[str]
    lows: list[int]
    path_lengths: list[int]
    open: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"paths": self.paths, "lows": self.lows, "path_lengths": self.path_lengths, "open": {}}

    def shard(self, k: int):
        if k not in self.open:
            fs, at = pyarrow.fs.FileSystem.from_uri(self.paths[k])
            if isinstance(fs, pyarrow.fs.LocalFileSystem):
                data = np.memmap(at, np.uint8, "r")
            else:
                with fs.open_input_file(at) as f:
                    data = np.frombuffer(f.readall(), np.uint8)
            n = int(data[:8].view(np.uint64)[0])
            digests = data[8 : 8 + 8 * n].view(np.uint64)
            offsets = data[8 + 8 * n : 16 + 16 * n].view(np.uint64)
            self.open[k] = digests, offsets, data[16 + 16 * n :]
        return self.open[k]

    def find(self, keys: list[bytes]) -> list[bytes | None]:
        """The stored value (kind and verdict) of each key, or None."""
        out: list[bytes | None] = [None] * len(keys)
        if not self.paths or not keys:
            return out
        digest = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        at = np.searchsorted(np.array(self.lows, np.uint64), digest, "right") - 1
        for k in np.unique(at[at >= 0]):
            digests, offsets, strings = self.shard(int(k))
            mine = np.flatnonzero(at == k)
            place = np.searchsorted(digests, digest[mine])
            hit = place < len(digests)
            hit[hit] = digests[place[hit]] == digest[mine[hit]]
            for i, p in zip(mine[hit], place[hit]):
                while p < len(digests) and digests[p] == digest[i]:
                    stored = strings[int(offsets[p]) : int(offsets[p + 1])].tobytes()
                    if stored[2:] == keys[i]:
                        out[i] = stored[:2]
                        break
                    p += 1
        return out


def build(spark: SparkSession, rules: DataFrame, listed: DataFrame, scratch: Scratch, shard_entries: int = SHARD_ENTRIES) -> UrlList:
    """Sort and write the list. Both tables have ``entry`` and ``verdict``; a rule wins over listed entries.

    Null and empty entries are left out; of entries that occur with both verdicts, block counts.
    """
    kinds = rules.select("entry", "verdict", F.lit("r").alias("kind")).union(listed.select("entry", "verdict", F.lit("l").alias("kind")))
    kinds = kinds.filter("entry is not null and entry != ''")
    kinds = kinds.groupBy("entry", "kind").agg(F.max((F.col("verdict") == "block").cast("int")).alias("block"))
    # A rule and a listed entry of the same string: the rule.
    kinds = scratch.keep(kinds.groupBy("entry").agg(F.max(F.struct("kind", "block")).alias("v")).select("entry", "v.kind", "v.block"), "entries")
    lengths = [r[0] for r in kinds.select(F.length(F.regexp_extract("entry", "(?s)(/.*)?$", 0)).alias("n")).distinct().collect()]
    count = kinds.count()
    root = scratch.path("shards")

    def hashed(batches):
        for b in batches:
            keys = [k.encode() for k in b.column("entry").to_pylist()]
            digest = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
            value = [f"{k}{'b' if x else 'a'}".encode() for k, x in zip(b.column("kind").to_pylist(), b.column("block").to_pylist())]
            # Sorting signed numbers with the top bit turned sorts the digests.
            yield pa.RecordBatch.from_arrays([pa.array((digest ^ np.uint64(1 << 63)).view(np.int64)), pa.array([v + k for v, k in zip(value, keys)], pa.binary())], ["digest", "stored"])

    def write(batches):
        from pyspark import TaskContext

        digests, stored = [], []
        for b in batches:
            digests.append(b.column("digest").to_numpy())
            stored += b.column("stored").to_pylist()
        if not stored:
            return
        task = TaskContext.get()
        to = f"{root}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        fs, at = pyarrow.fs.FileSystem.from_uri(to)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        digest = np.concatenate(digests).view(np.uint64) ^ np.uint64(1 << 63)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in stored])]).astype(np.uint64)
        with fs.open_output_stream(at) as f:
            f.write(struct.pack("<Q", len(stored)) + digest.tobytes() + offsets.tobytes())
            f.write(b"".join(stored))
        yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([str(int(digest[0]))])], ["path", "low"])

    sorted_keys = kinds.mapInArrow(hashed, "digest long, stored binary")
    sorted_keys = sorted_keys.repartitionByRange(max(1, -(-count // shard_entries)), "digest").sortWithinPartitions("digest", "stored")
    # One row per shard; only the files that this table names belong to the list.
    shards = scratch.keep(sorted_keys.mapInArrow(write, "path string, low string"), "manifest").collect()
    shards = sorted((int(r.low), r.path) for r in shards)
    return UrlList([p for _, p in shards], [low for low, _ in shards], sorted(lengths))


def judge(pages: DataFrame, urls: UrlList, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row (page_id, url; other columns are not read).

    The longest fitting rule decides; without one, the longest fitting listed entry; without one, ``default``. A null url,
    or one without ``://``, has an empty host and path and fits nothing.
    """
    words = {ord("a"): "allow", ord("b"): "block"}

    def apply(batches):
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            keys, owner = [], []
            for i, (host, path) in enumerate(zip(hosts, paths)):
                labels = host.split(".") if host else []
                for k in range(len(labels)):
                    suffix = ".".join(labels[k:])
                    for n in urls.path_lengths:
                        if n <= len(path):
                            keys.append((suffix + path[:n]).encode())
                            owner.append(i)
            best: dict[int, tuple] = {}
            for i, key, value in zip(owner, keys, urls.find(keys)):
                if value is not None:
                    best[i] = max(best.get(i, (False, -1, "", "")), (value[0] == ord("r"), len(key.decode()), words[value[1]], key.decode()))
            rule = [best[i][3] if i in best and best[i][0] else None for i in range(len(hosts))]
            verdict = [best[i][2] if i in best else default for i in range(len(hosts))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    kind = parts.schema["page_id"].dataType.simpleString()
    return parts.mapInArrow(apply, f"page_id {kind}, host string, path string, rule string, verdict string")


def judge_pages(pages: DataFrame, rules=RULES, words: tuple[str, ...] = BLOCKED_WORDS) -> DataFrame:
    """Build the list from the rules and the pages' own hosts, then judge every page."""
    spark = text_session(pages.sparkSession)
    scratch = Scratch(spark, "urls")
    rule_rows = spark.createDataFrame(list(rules), "entry string, verdict string")
    listed = listed_hosts(pages.select(host_of(F.col("url")).alias("host")), words)
    return judge(pages, build(spark, rule_rows, listed, scratch))
