"""Is a run's only blocking finding a provider outage?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siftwork.functions import variants as V
from siftwork.functions.text import first_text, strip

# All of the first list, and one of the second, must be in the message.
FAILURE_MARKERS = (
    "blocking merge per fail-closed policy",
    "fallback failed",
    "llm analysis failed",
    "primary failed",
)
CAPACITY_MARKERS = (
    "429", "capacity", "consumer_suspended", "insufficient_quota", "permission_denied", "provider unavailable",
    "quota", "rate limit", "suspended",
)


def message_text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def classify_outages(findings: DataFrame) -> DataFrame:
    """Reason per run of ``(run_id, severity, category, source, path, message)``.

    Each finding is reduced to flags first, so one hash aggregate per run carries only numbers and
    booleans. ``source``, ``path`` and ``message`` come from their fallbacks by the caller.
    """
    severity = F.upper(F.coalesce(F.col("severity"), F.lit("")))
    message = F.lower(F.coalesce(F.col("message"), F.lit("")))
    is_p0 = severity == "P0"
    system = (
        (F.coalesce(F.col("category"), F.lit("")) == "LLM Failure")
        & (strip(F.coalesce(F.col("source"), F.lit(""))) == "system")
        & (strip(F.coalesce(F.col("path"), F.lit(""))) == "<system>")
    )
    failed = reduce(lambda a, b: a & b, [message.contains(m) for m in FAILURE_MARKERS])
    capacity = reduce(lambda a, b: a | b, [message.contains(m) for m in CAPACITY_MARKERS])
    per_run = findings.groupBy("run_id").agg(
        *[F.count_if(severity == s).alias(f"{s.lower()}_count") for s in ("P0", "P1", "P2")],
        F.coalesce(F.bool_or(is_p0 & system), F.lit(False)).alias("_system"),
        F.coalesce(F.bool_or(is_p0 & failed), F.lit(False)).alias("_failed"),
        F.coalesce(F.bool_or(is_p0 & capacity), F.lit(False)).alias("_capacity"),
    )
    p0, p1, p2 = F.col("p0_count"), F.col("p1_count"), F.col("p2_count")
    reason = (
        F.when((p1 > 0) | (p2 > 0), "blocking_non_p0_findings_present")
        .when(p0 != 1, "expected_exactly_one_p0_llm_failure")
        .when(~F.col("_system"), "p0_is_not_system_llm_failure")
        .when(~F.col("_failed"), "llm_failure_message_missing_fail_closed_markers")
        .when(~F.col("_capacity"), "llm_failure_not_provider_capacity_class")
        .otherwise("single_system_llm_provider_outage")
    )
    out = per_run.withColumn("reason", reason)
    return out.select(
        "run_id",
        "reason",
        (F.col("reason") == "single_system_llm_provider_outage").alias("break_glass"),
        (p0 + p1 + p2).alias("blocking_count"),
        "p0_count",
        "p1_count",
        "p2_count",
    )


def outage_fields(raw: DataFrame) -> DataFrame:
    """Fields the classifier needs, from external findings ``(run_id, raw VARIANT)``."""
    def at(name: str) -> Column:
        return V.text_at(F.col("raw"), f"$.{name}")

    return raw.select(
        "run_id",
        at("severity").alias("severity"),
        at("category").alias("category"),
        first_text(at("source"), at("provenance")).alias("source"),
        first_text(at("file_path"), at("path"), at("scope.path")).alias("path"),
        message_text(at("message"), at("impact"), at("title"), at("remediation_guidance")).alias("message"),
    )
