"""The event-ordered operators on streams. All state is Spark's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQueryListener

from siftwork.operators import fixes, gates, quota
from siftwork.plans.session import remove
from siftwork.streaming import stateful


def severity_windows(findings: DataFrame, delay: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Severity counts per run and event-time window; a window is final once the watermark passes it.

    Rows that come after that are dropped; ``LateRows`` counts them.
    """
    w = F.window("ts", width)
    return (
        findings.withWatermark("ts", delay)
        .groupBy(w.alias("w"), "run_id")
        .agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("P0", "P1", "P2", "P3")])
        .select(F.col("w.start").alias("window_start"), "run_id", "p0", "p1", "p2", "p3")
    )


class LateRows(StreamingQueryListener):
    """Counts the rows that stateful operators drop as too late, per query name, over a query's whole life.

    ``spark.streams.addListener(LateRows())`` before the query starts.
    """

    def __init__(self) -> None:
        self.dropped: dict[str | None, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(event.name, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped[p.name] = self.dropped.get(p.name, 0) + sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def unique_findings(findings: DataFrame, delay: str = "1 day", spread: int = 16) -> DataFrame:
    """First arrival per run and fingerprint.

    Arrival decides; where the backend's copy must win whenever it comes, use ``merged_findings``. A repeat later than
    ``delay`` after the first passes again.

    Copies of one finding may be a large share of a micro-batch, so they are first dropped within
    ``spread`` slices of each fingerprint, and only what is left of the slices meets in one task.
    """
    rest = [c for c in findings.columns if c not in ("run_id", "fingerprint")]
    sliced = findings.withWatermark("ts", delay).withColumn("_slice", F.pmod(F.xxhash64(*rest), F.lit(spread)))
    thinned = sliced.dropDuplicatesWithinWatermark(["run_id", "fingerprint", "_slice"]).drop("_slice")
    return thinned.dropDuplicatesWithinWatermark(["run_id", "fingerprint"])


def merged_findings(findings: DataFrame) -> DataFrame:
    """One row per run and fingerprint of ``(run_id, fingerprint, feed_rank, seq, ...)``: the copy of the foremost feed, its
    first by ``seq``, whatever order the copies arrive in. Run in update mode: a row comes again when a copy arrives.

    The state is one row per fingerprint, and copies are combined before the shuffle, so a hot fingerprint sends one row per
    input partition. ``merged_state`` reads the whole result out of the state.
    """
    order, row = _merge_order(findings.columns), F.struct(*[c for c in findings.columns if c not in ("run_id", "fingerprint")])
    best = findings.groupBy("run_id", "fingerprint").agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return best.select("run_id", "fingerprint", "_row.*")


def _merge_order(columns: list[str]) -> list[str]:
    """The order in which the batch merge prefers copies."""
    return ["feed_rank", "seq", *sorted(c for c in ("file", "line", "title") if c in columns)]


def _state(spark: SparkSession, checkpoint: str, value: str) -> DataFrame:
    """The keys of an aggregation's state and its buffers as one struct of type ``value``, after the last finished batch."""
    rows = spark.read.format("statestore").load(checkpoint)
    return rows.select("key.*", F.col("value").cast(value).alias("_v"))


def merged_state(spark: SparkSession, checkpoint: str, schema: T.StructType) -> DataFrame:
    """The merged findings of a ``merged_findings`` query, of the input's ``schema``, one row per run and fingerprint."""
    own = [f for f in schema if f.name not in ("run_id", "fingerprint")]
    row = T.StructType(own)
    order = T.StructType([schema[c] for c in _merge_order(schema.names)])
    value = T.StructType([T.StructField("row", row), T.StructField("at", order)])
    return _state(spark, checkpoint, value.simpleString()).select("run_id", "fingerprint", "_v.row.*")


def quota_state(events: DataFrame) -> DataFrame:
    """Current state per stream: last-value aggregates, so state is one row per stream and a hot
    stream is combined before the shuffle. Run in update or complete mode."""
    return quota.latest_quota(quota.quota_events(events))


def quota_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Current state per stream, read out of the state of a ``quota_state`` query: one row per stream, no history.

    The buffers are those of ``latest_quota``'s aggregates in their order, each last value with its ``seq``.
    """
    value = "struct<seq:bigint,state:string,s1:bigint,reason:string,s2:bigint,resets_at:bigint,s3:bigint,using_overage:boolean,s4:bigint>"
    return _state(spark, checkpoint, value).select(
        "stream_key", "_v.seq", "_v.state", "_v.reason", "_v.resets_at", F.coalesce("_v.using_overage", F.lit(False)).alias("using_overage")
    )


def run_ends(triggers: DataFrame, samples: DataFrame, wait_seconds: int = 900, delay: str = "10 minutes") -> DataFrame:
    """Triggered runs with their first terminal status, or with none once the wait limit has passed.

    An end comes out in the micro-batch in which it arrives, a time-out when the watermark passes the limit and the
    trigger's timer fires. One row per trigger. An end that arrives before its trigger is kept until the watermark passes
    it. Of several ends that have arrived the earliest counts; one that arrives after a later end is ignored.
    """
    starts = triggers.select("run_id", F.col("started_at").alias("at"), F.lit(None).cast("string").alias("status"), F.lit(True).alias("start"))
    ends = samples.filter(gates.is_terminal(F.col("status"))).select("run_id", F.col("ts").alias("at"), "status", F.lit(False).alias("start"))
    out = stateful.followed_runs(starts.unionByName(ends), wait_seconds, delay)
    return out.select(
        "run_id",
        F.timestamp_micros("started_us").alias("started_at"),
        F.timestamp_micros("ended_us").alias("ended_at"),
        "status",
        F.col("ended_us").isNull().alias("timed_out"),
    )


def with_accepted(requests: DataFrame, limit: int = fixes.FIX_LIMIT, keep_days: int = 30) -> DataFrame:
    """The requests of each micro-batch and, as rows of their own, the accepted ids of the builds they ask about.

    ``decide_batch`` makes decisions of them. Accepted ids, at most ``limit`` per build, are Spark state, so a batch costs what
    its own requests cost, however long the history, and a restart goes on where the query stopped.
    """
    accepted = stateful.accepted_ids(requests, limit, keep_days).select(F.struct("build_id", "finding_id", "first_seq").alias("accepted"))
    return requests.select(F.struct(*requests.columns).alias("request")).unionByName(accepted, allowMissingColumns=True)


def decide_batch(folder: str, limit: int = fixes.FIX_LIMIT) -> Callable[[DataFrame, int], None]:
    """Micro-batch function that writes the decisions on a batch of ``with_accepted`` rows, by batch number.

    A batch that is run again overwrites its own decisions only. Requests are ordered by ``seq`` inside a batch, and those
    of later batches must have larger ones.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Requests and accepted ids come out of one run of the batch.
        at = f"{folder}/staged/batch={batch_id}"
        batch.write.mode("overwrite").parquet(at)
        rows = spark.read.schema(batch.schema).parquet(at)
        requests = rows.filter("request is not null").select("request.*")
        winners = rows.filter("accepted is not null").select("accepted.*")
        fixes.decided(requests, winners, limit).write.mode("overwrite").parquet(f"{folder}/decisions/batch={batch_id}")
        remove(spark, at)

    return run


def read_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/decisions").parquet(f"{folder}/decisions")
