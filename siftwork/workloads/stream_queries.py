"""Streaming operators driven to completion over the event table, results read back from files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwork.plans.session import remove, shared_folder
from siftwork.streaming import queries as S
from siftwork.streaming.stateful import state_settings
from siftwork.workloads import fix_queries, quota_queries
from siftwork.workloads.inputs import EVENTS_SQL, by_kind, events, table
from siftwork.workloads.registry import query


class _Streaming:
    """Reads the event table as a stream where a query would read it as a batch."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        schema = table(spark, sf_dir, "events").schema
        # The bracket makes the path a glob, which a stream accepts for a single file too.
        path = f"{sf_dir}/events.parque[t]"
        self.read = self
        self._rows = spark.readStream.schema(schema).parquet(path)

    def parquet(self, path: str) -> DataFrame:
        return self._rows


def streamed(spark: SparkSession, sf_dir: str):
    """A stand-in for the session that makes an input builder give a stream."""
    return _Streaming(spark, sf_dir)


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def run_to_files(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Append-mode run over all input; the rows that came out."""
    at = folder(spark)
    q = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{at}/checkpoint")
        .option("path", f"{at}/rows")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    remove(spark, f"{at}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def run_batches(spark: SparkSession, stream: DataFrame, make) -> str:
    """Run with a micro-batch function made for a fresh folder; that folder. The checkpoint goes when the input has ended."""
    at = folder(spark)
    writer = stream.writeStream.foreachBatch(make(f"{at}/out")).option("checkpointLocation", f"{at}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    remove(spark, f"{at}/checkpoint")
    return f"{at}/out"


def run_state(spark: SparkSession, stream: DataFrame) -> str:
    """Run an aggregation in update mode for its state alone; the checkpoint that holds it."""
    at = f"{folder(spark)}/checkpoint"
    stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return at


_SEVERITY = ("P2", "P0", "P1", "P3", "P1")
_SEVERITY_SQL = "CASE kind WHEN 'click' THEN 'P2' WHEN 'error' THEN 'P0' WHEN 'signup' THEN 'P3' ELSE 'P1' END"


@query(
    "stream_counts",
    f"""SELECT epoch_us(d) // 1000000 AS window_start, run_id, count(*) FILTER (s = 'P0') AS p0, count(*) FILTER (s = 'P1') AS p1,
          count(*) FILTER (s = 'P2') AS p2, count(*) FILTER (s = 'P3') AS p3
        FROM (SELECT date_trunc('day', ts) AS d, run_id, {_SEVERITY_SQL} AS s FROM ({EVENTS_SQL}))
        WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY d, run_id""",
)
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(streamed(spark, sf_dir), sf_dir)
    out = S.severity_windows(e.withColumn("severity", by_kind(*[F.lit(s) for s in _SEVERITY])))
    rows = run_to_files(spark, out)
    return rows.withColumn("window_start", F.unix_seconds("window_start"))


@query("stream_dedup", f"SELECT DISTINCT run_id, kind || ':' || k AS fingerprint FROM ({EVENTS_SQL})")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(streamed(spark, sf_dir), sf_dir)
    rows = e.select("run_id", F.concat_ws(":", "kind", F.col("k").cast("string")).alias("fingerprint"), "event_id", "ts")
    # The table covers thirty days; the delay keeps all of its fingerprints.
    return run_to_files(spark, S.unique_findings(rows, "60 days")).select("run_id", "fingerprint")


@query(
    "stream_merge",
    f"""SELECT run_id, fingerprint, feed_rank, event_id FROM (
          SELECT run_id, kind || ':' || k AS fingerprint, CAST(CASE WHEN value >= 60 THEN 0 ELSE 1 END AS INTEGER) AS feed_rank, event_id,
            row_number() OVER (PARTITION BY run_id, kind, k ORDER BY CASE WHEN value >= 60 THEN 0 ELSE 1 END, event_id) AS n
          FROM ({EVENTS_SQL})) WHERE n = 1""",
)
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of high value as the backend's feed, the others as the local one."""
    e = events(streamed(spark, sf_dir), sf_dir)
    rank = F.when(F.col("value") >= 60, 0).otherwise(1)
    rows = e.select("run_id", F.concat_ws(":", "kind", F.col("k").cast("string")).alias("fingerprint"), rank.alias("feed_rank"), F.col("event_id").alias("seq"))
    return S.merged_state(spark, run_state(spark, S.merged_findings(rows)), rows.schema).withColumnRenamed("seq", "event_id")


@query("stream_quota", quota_queries.LATEST_SQL)
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = quota_queries.quota_log(streamed(spark, sf_dir), sf_dir)
    out = S.quota_now(spark, run_state(spark, S.quota_state(log)))
    return out.withColumn("reason", F.substring_index("reason", ": util", 1))


@query(
    "stream_fixes",
    f"SELECT build_id, seq, finding_id, accepted, already_attempted, rate_limited FROM ({fix_queries.ADMISSION_SQL})",
)
def stream_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fix_queries.commands(streamed(spark, sf_dir), sf_dir).drop("body")
    with state_settings(spark, empty_batches=False):
        at = run_batches(spark, S.with_accepted(asked), S.decide_batch)
    return S.read_decisions(spark, at).select(
        "build_id", "seq", "finding_id", "accepted", "already_attempted", "rate_limited"
    )


# An end comes out when it arrives; a time-out once the watermark, ten minutes behind the newest row, has passed the limit.
_ENDS_SQL = f"""
    SELECT t.run_id, t.event_id, t.ts + INTERVAL 7200 SECOND < (SELECT max(ts) - INTERVAL 10 MINUTE
        FROM ({EVENTS_SQL}) WHERE kind IN ('signup', 'error', 'purchase')) AS closed, count(s.event_id) AS n
    FROM ({EVENTS_SQL}) t LEFT JOIN ({EVENTS_SQL}) s
      ON s.run_id = t.run_id AND s.kind IN ('error', 'purchase') AND s.ts BETWEEN t.ts AND t.ts + INTERVAL 7200 SECOND
    WHERE t.kind = 'signup' GROUP BY t.run_id, t.event_id, t.ts"""


@query(
    "stream_run_ends",
    f"""SELECT run_id, count(*) FILTER (n = 0) AS timed_out, count(*) FILTER (n > 0) AS ended
        FROM ({_ENDS_SQL}) WHERE closed OR n > 0 GROUP BY run_id""",
)
def stream_run_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups trigger runs; errors and purchases of the same user end them if within two hours."""
    e = events(streamed(spark, sf_dir), sf_dir)
    triggers = e.filter(F.col("kind") == "signup").select("run_id", F.col("ts").alias("started_at"))
    status = by_kind(*[F.lit(s) for s in ("running", "failed", "completed", "queued", "queued")])
    samples = e.select("run_id", "ts", status.alias("status"))
    with state_settings(spark):
        out = run_to_files(spark, S.run_ends(triggers, samples, wait_seconds=7200))
    return out.groupBy("run_id").agg(
        F.count_if("timed_out").alias("timed_out"), F.count("ended_at").alias("ended")
    )
