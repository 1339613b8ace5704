"""Operators with state of their own shape: accepted fix requests, and runs that wait for their end.

They run on ``transformWithState``, so the state lies in Spark's state store (RocksDB), a batch reads and writes the keys
that it meets only, and entries expire by themselves. Start such queries inside ``state_settings``.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Builds of one input partition whose first ids are held at once; more are passed on early, which costs rows, not correctness.
HELD_BUILDS = 100_000


@contextmanager
def state_settings(spark: SparkSession, empty_batches: bool = True) -> Iterator[None]:
    """What queries with such state need when they start; the session's own settings come back after.

    Without ``empty_batches`` a query waits for rows: state that expires by the clock would else keep it running for ever
    under a trigger that ends when the input ends.
    """
    own = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower(),
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Accepted(StatefulProcessor):
    """The first ``limit`` distinct ids of a build, over all batches."""

    def __init__(self, limit: int, keep_ms: int):
        self.limit, self.keep_ms = limit, keep_ms

    def init(self, handle) -> None:
        self.taken = handle.getMapState("accepted", "finding_id string", "first_seq long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        first: dict[str, int] = {}
        for batch in rows:
            for name, seq in zip(batch["finding_id"], batch["first_seq"]):
                first[name] = min(seq, first.get(name, seq))
        known = {k[0]: v[0] for k, v in self.taken.iterator()}
        for name in sorted(first.keys() - known.keys(), key=first.get):
            if len(known) >= self.limit:
                break
            known[name] = int(first[name])
            self.taken.updateValue((name,), (known[name],))
        yield pd.DataFrame({"build_id": [key[0]] * len(known), "finding_id": list(known), "first_seq": list(known.values())})

    def close(self) -> None:
        pass


def accepted_ids(requests: DataFrame, limit: int, keep_days: int = 30) -> DataFrame:
    """(build_id, finding_id, first_seq): the accepted ids of every build that a batch asks about.

    Before the shuffle each input partition is cut down to the first ids of each build: twice the limit, as some of them may
    be accepted already. So a build with most of the requests sends a few rows per partition to its task. An accepted id is
    forgotten ``keep_days`` after its acceptance.
    """

    def first_ids(batches):
        held: dict[str, dict[str, int]] = {}

        def out():
            rows = [(b, f, s) for b, ids in held.items() for f, s in sorted(ids.items(), key=lambda x: x[1])[: 2 * limit]]
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["build_id", "finding_id", "first_seq"])

        for batch in batches:
            for b, f, s in zip(*(batch.column(c).to_pylist() for c in ("build_id", "finding_id", "seq"))):
                if b is None or f is None or s is None:
                    continue
                ids = held.setdefault(b, {})
                ids[f] = min(s, ids.get(f, s))
                if len(ids) > 4 * limit:
                    held[b] = dict(sorted(ids.items(), key=lambda x: x[1])[: 2 * limit])
            if len(held) > HELD_BUILDS:
                yield out()
                held.clear()
        if held:
            yield out()

    schema = "build_id string, finding_id string, first_seq long"
    few = requests.select(F.col("build_id").cast("string").alias("build_id"), F.col("finding_id").cast("string").alias("finding_id"), F.col("seq").cast("long").alias("seq")).mapInArrow(first_ids, schema)
    return few.groupBy("build_id").transformWithStateInPandas(_Accepted(limit, keep_days * 86_400_000), schema, "Append", "ProcessingTime")


class _Ends(StatefulProcessor):
    """Triggers of a run that wait for an end, and ends that a late trigger may still ask for."""

    def __init__(self, wait_us: int):
        self.wait = wait_us

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "started_us long")
        self.ends = handle.getListState("ends", "ended_us long, status string")

    def _due(self, started: int) -> int:
        """The first millisecond past the limit."""
        return (started + self.wait) // 1000 + 1

    def _store(self, started: list[int], ends: list[tuple[int, str]], watermark_ms: int) -> None:
        ends = [e for e in ends if e[0] // 1000 >= watermark_ms]
        for state, rows in ((self.open, [(s,) for s in started]), (self.ends, ends)):
            state.put(rows) if rows else state.clear()
        for at in {self._due(s) for s in started} | {e[0] // 1000 + 1 for e in ends}:
            self.handle.registerTimer(max(at, watermark_ms + 1))

    @staticmethod
    def _out(key, rows: list[tuple]) -> pd.DataFrame:
        cols = list(zip(*rows)) or [(), (), ()]
        made = {"started_us": pd.array(cols[0], "Int64"), "ended_us": pd.array(cols[1], "Int64"), "status": pd.array(cols[2], "object")}
        return pd.DataFrame({"run_id": [key[0]] * len(rows), **made})

    def handleInputRows(self, key, rows, timerValues):
        started = [r[0] for r in self.open.get()] if self.open.exists() else []
        ends = [(r[0], r[1]) for r in self.ends.get()] if self.ends.exists() else []
        for batch in rows:
            for at, status, start in zip(batch["at_us"], batch["status"], batch["start"]):
                started.append(int(at)) if start else ends.append((int(at), status))
        started.sort()
        ends.sort()
        out, left = [], []
        for s in started:
            k = bisect.bisect_left(ends, (s,))
            if k < len(ends) and ends[k][0] <= s + self.wait:
                out.append((s, *ends[k]))
            else:
                left.append(s)
        self._store(left, ends, timerValues.getCurrentWatermarkInMs())
        if out:
            yield self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        started = [r[0] for r in self.open.get()] if self.open.exists() else []
        ends = [(r[0], r[1]) for r in self.ends.get()] if self.ends.exists() else []
        late = [s for s in started if self._due(s) <= now]
        if late:
            yield self._out(key, [(s, None, None) for s in late])
        left = [s for s in started if self._due(s) > now]
        ends = [e for e in ends if e[0] // 1000 >= now]
        for state, rows in ((self.open, [(s,) for s in left]), (self.ends, ends)):
            state.put(rows) if rows else state.clear()

    def close(self) -> None:
        pass


def followed_runs(events: DataFrame, wait_seconds: int, delay: str) -> DataFrame:
    """(run_id, started_us, ended_us, status) of triggers and ends in one stream of (run_id, at, status, start)."""
    rows = events.select("run_id", "at", F.unix_micros("at").alias("at_us"), "status", "start").withWatermark("at", delay)
    schema = "run_id string, started_us long, ended_us long, status string"
    return rows.groupBy("run_id").transformWithStateInPandas(_Ends(wait_seconds * 1_000_000), schema, "Append", "EventTime")
