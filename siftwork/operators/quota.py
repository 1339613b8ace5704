"""Quota timeline: state after each response, carried reset time, call admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siftwork.functions.headers import has_quota_facts, with_quota_facts
from siftwork.plans.carry import carry_forward
from siftwork.plans.lookup import lookup

# Warn when utilisation >= first and window progress <= second, first match wins.
EARLY_WARNING = (
    ("5h", "util_5h", 5 * 3600, ((0.90, 0.72),)),
    ("7d", "util_7d", 7 * 86_400, ((0.75, 0.60), (0.50, 0.35), (0.25, 0.15))),
)
THROTTLE_TOKENS = 4_000
WARNING_TOKENS = 16_000


def _early_warning(now: Column) -> Column:
    """Reason of the first crossed threshold, or null."""
    reasons = []
    for label, util, seconds, steps in EARLY_WARNING:
        used, reset = F.col(util), F.col("_reset")
        progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (now - (reset - seconds)) / seconds))
        for least_used, latest in steps:
            text = F.concat(
                F.lit(f"early_warning[{label}]: util="), F.format_string("%.2f", used),
                F.lit(f" >= {least_used}, time_progress="), F.format_string("%.2f", progress), F.lit(f" <= {latest}"),
            )
            reasons.append(F.when((used >= least_used) & ~F.isnan(used) & (progress <= latest), text))
    return F.coalesce(*reasons)


def quota_events(events: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """State after each event of ``(stream_key, seq, ts, http_status, headers)``.

    The state follows from the event alone, so this is a narrow projection. A 200 without quota
    headers and any status but 200 and 429 say nothing and are dropped. ``reset_mark`` and
    ``overage_mark`` are null where the event leaves the carried value as it was. An optional
    boolean ``manual_reset`` puts the stream back to normal.
    """
    df = events
    if "manual_reset" not in df.columns:
        df = df.withColumn("manual_reset", F.lit(False))
    df = with_quota_facts(df).withColumnRenamed("resets_at", "_reset")

    manual = F.coalesce(F.col("manual_reset"), F.lit(False))
    limited = F.col("http_status") == 429
    fine = F.col("http_status") == 200
    overage = limited & F.coalesce(F.lower("overage_status") == "allowed", F.lit(False))
    retry = F.coalesce(F.col("retry_after_s"), F.lit(0))
    known = has_quota_facts(F.col("status"), F.col("util_5h"), F.col("util_7d"), F.col("_reset"))
    df = df.filter(F.coalesce(manual | limited | (fine & known), F.lit(False)))
    df = df.withColumn("_warning", _early_warning(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6))

    def to(state: str, reason: Column) -> Column:
        return F.struct(F.lit(state).alias("state"), reason.alias("reason"))

    after_429 = F.when(
        retry != 0, F.concat(F.lit("429 received; retry_after="), retry.cast("string"), F.lit("s"))
    ).otherwise("429 received")
    step = (
        F.when(manual, to("normal", F.lit("manual reset")))
        .when(overage, to("using_overage", F.lit("429 but overage allowed")))
        .when(limited & (retry > 0), to("throttled", after_429))
        .when(limited, to("exhausted", after_429))
        .when(F.lower("status") == "rejected", to("throttled", F.lit("status=rejected")))
        .when(F.col("_warning").isNotNull(), to("warning", F.col("_warning")))
        .otherwise(to("normal", F.lit("status=allowed")))
    )
    return df.withColumn("_step", step).select(
        "stream_key",
        "seq",
        "ts",
        *extra,
        F.col("_step.state").alias("state"),
        F.col("_step.reason").alias("reason"),
        F.when(~manual & ~overage, F.col("_reset")).alias("reset_mark"),
        F.when(manual, F.lit(False)).when(overage, F.lit(True)).alias("overage_mark"),
    )


def quota_timeline(events: DataFrame, span: int = 1_000_000) -> DataFrame:
    """Each event with its state, the reset time known by then and the overage flag."""
    steps = quota_events(events)
    carried = carry_forward(
        steps,
        "stream_key",
        "seq",
        {"resets_at": F.col("reset_mark"), "using_overage": F.col("overage_mark")},
        span,
    )
    return carried.withColumn("using_overage", F.coalesce("using_overage", F.lit(False))).drop(
        "reset_mark", "overage_mark"
    )


def _last(value: str) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col("seq")))


def latest_quota(steps: DataFrame) -> DataFrame:
    """State per stream from ``quota_events`` rows: last-value aggregates, combined before the shuffle.

    The same plan serves a batch and a streaming aggregation.
    """
    return steps.groupBy("stream_key").agg(
        F.max("seq").alias("seq"),
        _last("state").alias("state"),
        _last("reason").alias("reason"),
        _last("reset_mark").alias("resets_at"),
        F.coalesce(_last("overage_mark"), F.lit(False)).alias("using_overage"),
    )


def admission(state: Column, tokens: Column, throttle: int = THROTTLE_TOKENS, warning: int = WARNING_TOKENS) -> Column:
    """Whether a call of ``tokens`` may go out: ``struct(allow, warn, call_reason)``."""

    def answer(allow: bool, warn: bool, *reason: Column) -> Column:
        return F.struct(F.lit(allow).alias("allow"), F.lit(warn).alias("warn"), F.concat(*reason).alias("call_reason"))

    t = tokens.cast("string")
    return (
        F.when(state == "exhausted", answer(False, False, F.lit("quota exhausted")))
        .when(
            (state == "throttled") & (tokens > throttle),
            answer(False, False, F.lit("throttled: estimate "), t, F.lit(f" > cap {throttle}")),
        )
        .when(state == "throttled", answer(True, True, F.lit("throttled: call allowed under throttle cap")))
        .when(
            (state == "warning") & (tokens > warning),
            answer(True, True, F.lit("warning: estimate "), t, F.lit(f" > cap {warning}; caller may defer")),
        )
        .when(state == "warning", answer(True, True, F.lit("warning: call allowed")))
        .when(state == "using_overage", answer(True, True, F.lit("using overage credits")))
        .otherwise(answer(True, False, F.lit("normal")))
    )


def admit_calls(requests: DataFrame, latest: DataFrame) -> DataFrame:
    """Requests ``(stream_key, tokens, ...)`` against the latest state; an unknown stream is normal."""
    known = latest.select("stream_key", "state")
    out = lookup(requests, known, ["stream_key"]).withColumn("state", F.coalesce("state", F.lit("normal")))
    return out.withColumn("_a", admission(F.col("state"), F.col("tokens"))).select("*", "_a.*").drop("_a")


def quota_outputs(latest: DataFrame) -> DataFrame:
    """The six output fields of a stream, as text."""

    def yes_no(c: Column) -> Column:
        return F.when(c, "true").otherwise("false")

    a = admission(F.col("state"), F.lit(0))
    warns = a["warn"] | F.col("state").isin("warning", "throttled", "using_overage")
    return latest.select(
        "stream_key",
        F.col("state").alias("quota_state"),
        yes_no(a["allow"]).alias("quota_allow"),
        yes_no(warns).alias("quota_warn"),
        F.coalesce(F.nullif(F.col("reason"), F.lit("")), a["call_reason"], F.col("state")).alias("quota_reason"),
        # A reset time of zero reads as none.
        F.coalesce(F.nullif(F.col("resets_at"), F.lit(0)).cast("string"), F.lit("")).alias("quota_resets_at"),
        yes_no(F.col("using_overage")).alias("quota_using_overage"),
    )
