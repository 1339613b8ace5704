"""Quota timeline, latest state, call admission, run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwork.functions.headers import has_quota_facts, with_quota_facts
from siftwork.functions.severity import normal_counts
from siftwork.operators import gates, quota
from siftwork.plans.pin import pinned
from siftwork.workloads.inputs import EVENTS_SQL, by_kind, events
from siftwork.workloads.registry import query


def quota_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses: errors are 429, the rest 200; headers follow kind, ``k`` and value."""
    e = events(spark, sf_dir)
    k, now = F.col("k"), F.floor(F.unix_micros("ts") / 1_000_000)

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))

    limited = (
        F.when(k < 30, F.array(pair("Retry-After", F.lit("15.9"))))
        .when(k < 50, F.array(pair("RateLimit-Overage-Status", F.lit("Allowed")), pair("x-ratelimit-reset", now + 60)))
        .when(k < 70, F.array(pair("X-RateLimit-Reset", now + k), pair("retry-after", F.lit("0"))))
        .otherwise(F.array(pair("retry-after", F.lit("soon"))))
    )
    five = F.array(
        pair("RateLimit-Unified-5h-Utilization", F.col("value") / 100),
        pair("ratelimit-unified-reset", now + k * 180),
        pair("ratelimit-unified-status", F.lit(" ")),
    )
    seven = F.array(
        pair("anthropic-ratelimit-unified-7d-utilization", F.col("value") / 100),
        pair("Anthropic-RateLimit-Unified-Reset", now + k * 6000),
    )
    plain = F.array(
        pair("ratelimit-unified-status", F.when(k < 20, "Rejected").otherwise("allowed")),
        pair("ratelimit-unified-reset", F.when(k < 60, F.lit("bad")).otherwise((now + 5).cast("string"))),
    )
    none = F.array(pair("content-type", F.lit("text/plain")), pair("ratelimit-unified-reset", now))
    headers = F.map_from_entries(by_kind(seven, limited, plain, none, five))
    return pinned(e, headers=headers).select(
        F.col("run_id").alias("stream_key"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(F.col("kind") == "error", 429).otherwise(200).alias("http_status"),
        "headers",
        ((F.col("kind") == "signup") & (k < 3)).alias("manual_reset"),
    )


FACTS_SQL = f"""
    SELECT run_id AS stream_key, event_id AS seq, kind, k, now, epoch_us(ts) / 1000000.0 AS clock, kind = 'signup' AND k < 3 AS manual,
      CASE WHEN kind = 'purchase' THEN CASE WHEN k < 20 THEN 'rejected' ELSE 'allowed' END END AS status,
      CASE WHEN kind = 'view' THEN value / 100 END AS u5, CASE WHEN kind = 'click' THEN value / 100 END AS u7,
      CASE kind WHEN 'click' THEN now + k * 6000 WHEN 'view' THEN now + k * 180 WHEN 'signup' THEN now
        WHEN 'purchase' THEN CASE WHEN k >= 60 THEN now + 5 END
        WHEN 'error' THEN CASE WHEN k BETWEEN 30 AND 49 THEN now + 60 WHEN k BETWEEN 50 AND 69 THEN now + k END END AS reset
    FROM (SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS now FROM ({EVENTS_SQL}))"""

STEPS_SQL = f"""
    SELECT stream_key, seq, CASE WHEN manual THEN 'normal'
        WHEN kind = 'error' THEN CASE WHEN k < 30 THEN 'throttled' WHEN k < 50 THEN 'using_overage' ELSE 'exhausted' END
        WHEN status = 'rejected' THEN 'throttled'
        WHEN u5 >= 0.9 AND p5 <= 0.72 THEN 'warning'
        WHEN (u7 >= 0.75 AND p7 <= 0.6) OR (u7 >= 0.5 AND p7 <= 0.35) OR (u7 >= 0.25 AND p7 <= 0.15) THEN 'warning'
        ELSE 'normal' END AS state,
      CASE WHEN manual THEN 'manual reset' WHEN kind = 'error' THEN CASE WHEN k < 30 THEN '429 received; retry_after=15s'
          WHEN k < 50 THEN '429 but overage allowed' ELSE '429 received' END
        WHEN status = 'rejected' THEN 'status=rejected'
        WHEN u5 >= 0.9 AND p5 <= 0.72 THEN 'early_warning[5h]'
        WHEN (u7 >= 0.75 AND p7 <= 0.6) OR (u7 >= 0.5 AND p7 <= 0.35) OR (u7 >= 0.25 AND p7 <= 0.15) THEN 'early_warning[7d]'
        ELSE 'status=allowed' END AS reason,
      CASE WHEN NOT manual AND NOT (kind = 'error' AND k BETWEEN 30 AND 49) THEN reset END AS mark,
      CASE WHEN kind = 'error' AND k BETWEEN 30 AND 49 THEN true WHEN manual THEN false END AS over
    FROM (SELECT *, greatest(0.0, least(1.0, (clock - (reset - 18000)) / 18000)) AS p5,
                 greatest(0.0, least(1.0, (clock - (reset - 604800)) / 604800)) AS p7 FROM ({FACTS_SQL}))
    WHERE kind <> 'signup' OR manual"""

TIMELINE_SQL = f"""
    SELECT stream_key, seq, state, reason,
      last_value(mark IGNORE NULLS) OVER w AS resets_at, coalesce(last_value(over IGNORE NULLS) OVER w, false) AS using_overage
    FROM ({STEPS_SQL}) WINDOW w AS (PARTITION BY stream_key ORDER BY seq ROWS UNBOUNDED PRECEDING)"""

LATEST_SQL = f"""
    SELECT stream_key, seq, state, reason, resets_at, using_overage FROM (
      SELECT *, row_number() OVER (PARTITION BY stream_key ORDER BY seq DESC) AS n FROM ({TIMELINE_SQL})) WHERE n = 1"""


def _reason_head(df: DataFrame, name: str = "reason") -> DataFrame:
    """Without the two-digit numbers of a warning, which round by platform."""
    return df.withColumn(name, F.substring_index(name, ": util", 1))


@query("quota_timeline", TIMELINE_SQL)
def quota_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reason_head(quota.quota_timeline(quota_log(spark, sf_dir), span=1000).drop("ts"))


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.latest_quota(quota.quota_events(quota_log(spark, sf_dir)))


@query("quota_latest", LATEST_SQL)
def quota_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reason_head(latest(spark, sf_dir))


@query(
    "call_admission",
    f"""SELECT e.event_id, stream_key, state, CAST(floor(value * 100) AS BIGINT) AS tokens,
          NOT (state = 'exhausted' OR (state = 'throttled' AND floor(value * 100) > 4000)) AS allow,
          state IN ('using_overage', 'warning') OR (state = 'throttled' AND floor(value * 100) <= 4000) AS warn,
          CASE state WHEN 'exhausted' THEN 'quota exhausted' WHEN 'normal' THEN 'normal' WHEN 'using_overage' THEN 'using overage credits'
            WHEN 'throttled' THEN CASE WHEN floor(value * 100) > 4000 THEN 'throttled: estimate ' || CAST(floor(value * 100) AS BIGINT) || ' > cap 4000'
              ELSE 'throttled: call allowed under throttle cap' END
            ELSE CASE WHEN floor(value * 100) > 16000 THEN 'warning: estimate ' || CAST(floor(value * 100) AS BIGINT) || ' > cap 16000; caller may defer'
              ELSE 'warning: call allowed' END END AS call_reason
        FROM ({EVENTS_SQL}) e JOIN ({LATEST_SQL}) l ON l.stream_key = e.run_id""",
)
def call_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = events(spark, sf_dir).select(
        "event_id", F.col("run_id").alias("stream_key"), F.floor(F.col("value") * 100).alias("tokens")
    )
    return quota.admit_calls(requests, latest(spark, sf_dir))


@query(
    "quota_outputs",
    f"""SELECT stream_key, state AS quota_state, CASE WHEN state = 'exhausted' THEN 'false' ELSE 'true' END AS quota_allow,
          CASE WHEN state IN ('warning', 'throttled', 'using_overage') THEN 'true' ELSE 'false' END AS quota_warn,
          reason AS quota_reason, coalesce(CAST(resets_at AS VARCHAR), '') AS quota_resets_at,
          CASE WHEN using_overage THEN 'true' ELSE 'false' END AS quota_using_overage FROM ({LATEST_SQL})""",
)
def quota_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reason_head(quota.quota_outputs(latest(spark, sf_dir)), "quota_reason")


@query(
    "quota_headers",
    f"""SELECT stream_key, seq, status, u5 AS util_5h, u7 AS util_7d, reset AS resets_at,
          CASE WHEN kind = 'error' AND k BETWEEN 30 AND 49 THEN 'allowed' END AS overage,
          CAST(CASE WHEN kind = 'error' THEN CASE WHEN k < 30 THEN 15 WHEN k BETWEEN 50 AND 69 THEN 0 END END AS BIGINT) AS retry_after_s,
          kind IN ('click', 'purchase', 'view') AS has_quota FROM ({FACTS_SQL})""",
)
def quota_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = with_quota_facts(quota_log(spark, sf_dir))
    has = has_quota_facts(F.col("status"), F.col("util_5h"), F.col("util_7d"), F.col("resets_at"))
    return facts.select(
        "stream_key", "seq", F.lower("status").alias("status"), "util_5h", "util_7d", "resets_at",
        F.lower("overage_status").alias("overage"), "retry_after_s", has.alias("has_quota"),
    )


def status_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    status = by_kind(*[F.lit(s) for s in (" Running ", "failed", "COMPLETED", "queued", "")])
    counts = F.when(
        F.col("kind") == "purchase",
        F.create_map(F.lit("P0"), F.col("k").cast("string"), F.lit("P1"), F.lit("-3"), F.lit("P2"), F.lit("many")),
    )
    return e.select(
        "run_id", F.col("event_id").alias("seq"), "ts", status.alias("status"),
        F.when(F.col("k") < 50, F.concat(F.lit(" step "), F.col("k").cast("string"))).otherwise(" ").alias("progress"),
        counts.alias("counts"),
    )


_STATUS_SQL = """CASE kind WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed'
    ELSE 'queued' END"""


@query(
    "run_latest",
    f"""SELECT run_id, status, CASE WHEN k < 50 THEN 'step ' || k ELSE status END AS progress, p0, p1, p2, p3, status IN ('failed', 'completed') AS terminal
        FROM (SELECT run_id, k, {_STATUS_SQL} AS status,
                coalesce(last_value(CASE WHEN kind = 'purchase' THEN CAST(k AS BIGINT) END IGNORE NULLS) OVER w, 0) AS p0,
                CAST(0 AS BIGINT) AS p1, CAST(0 AS BIGINT) AS p2,
                CASE WHEN bool_or(kind = 'purchase') OVER w THEN CAST(0 AS BIGINT) ELSE CAST(7 AS BIGINT) END AS p3,
                row_number() OVER (PARTITION BY run_id ORDER BY event_id DESC) AS n FROM ({EVENTS_SQL})
              WINDOW w AS (PARTITION BY run_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
        WHERE n = 1""",
)
def run_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last status and counts of a run; a run that never reported counts has a fallback."""
    last = gates.latest_status(status_samples(spark, sf_dir))
    counts = normal_counts(F.col("counts"), F.create_map(F.lit("P0"), F.lit("x"), F.lit("P3"), F.lit("7")))
    return last.select(
        "run_id", "status", "progress", *[c.alias(s.lower()) for s, c in counts.items()],
        gates.is_terminal(F.col("status")).alias("terminal"),
    )


@query(
    "run_timeout",
    f"""SELECT t.run_id, epoch_us(t.ts) AS started, coalesce(min(s.ts) > t.ts + INTERVAL 7200 SECOND, true) AS timed_out
        FROM ({EVENTS_SQL}) t LEFT JOIN ({EVENTS_SQL}) s
          ON s.run_id = t.run_id AND s.kind IN ('error', 'purchase') AND s.ts >= t.ts
        WHERE t.kind = 'signup' GROUP BY t.run_id, t.event_id, t.ts""",
)
def run_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sign-up triggers; ends before it do not count."""
    triggers = events(spark, sf_dir).filter("kind = 'signup'").select("run_id", F.col("ts").alias("started_at"))
    out = gates.run_timeouts(triggers, status_samples(spark, sf_dir), 7200)
    return out.select("run_id", F.unix_micros("started_at").alias("started"), "timed_out")


@query(
    "bridge_verdict",
    f"""SELECT run_id, status, p0, p1, p2, p3, blocking,
          CASE WHEN blocking > 0 THEN 'blocked' WHEN status = 'failed' THEN 'error' ELSE 'passed' END AS verdict
        FROM (SELECT run_id || ':' || kind AS run_id, {_STATUS_SQL} AS status,
                count(*) FILTER (kind IN ('error', 'click', 'purchase') AND k = 1 AND value >= 50) AS blocking,
                count(*) FILTER (kind = 'error' AND k < 2) AS p0, count(*) FILTER (kind = 'click' AND k < 2) AS p1,
                count(*) FILTER (kind = 'purchase' AND k < 2) AS p2,
                count(*) FILTER (NOT (kind IN ('error', 'click', 'purchase') AND k < 2)) AS p3
              FROM ({EVENTS_SQL}) GROUP BY run_id, kind)""",
)
def bridge_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user and kind of event; every event is a finding, some of which only ask."""
    e = events(spark, sf_dir).withColumn("run_id", F.concat_ws(":", "run_id", "kind"))
    low = F.lit("P3")
    severity = by_kind(*[F.when(F.col("k") < 2, s).otherwise(low) for s in ("P1", "P0", "P2", "P3", "P3")])
    status = by_kind(*[F.lit(s) for s in ("running", "failed", "completed", "queued", "queued")])
    runs = e.select("run_id", status.alias("status")).distinct().withColumn("waited", F.lit(True))
    decision = F.when(F.col("k") == 0, "ask").when(F.col("value") < 50, "allow").when(F.col("k") == 1, "deny")
    return gates.bridge_verdicts(e.select("run_id", severity.alias("severity"), decision.alias("decision")), runs, "P2").drop("waited")
