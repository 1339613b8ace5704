"""Provider outages per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwork.functions import variants as V
from siftwork.operators import outage
from siftwork.plans.pin import pinned
from siftwork.workloads.inputs import EVENTS_SQL, events
from siftwork.workloads.registry import query


def external_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as external findings; a run is one user's day, so many runs have a single finding."""
    e = events(spark, sf_dir)
    k = F.col("k")
    text = F.concat(
        F.when(k < 60, "LLM analysis FAILED: primary failed and fallback failed; ").otherwise("Primary failed. "),
        F.when(k < 80, "Blocking merge per fail-closed policy. ").otherwise(""),
        F.when(k < 40, "HTTP 429").when(k < 50, "Quota exhausted").otherwise("unknown cause"),
    )
    on_system = F.when(F.col("value") < 60, "system").otherwise("deterministic")
    fields = F.struct(
        F.when(F.col("kind") == "error", "p0").when((F.col("kind") == "click") & (k < 20), "P2").otherwise("P3").alias("severity"),
        F.when(k < 70, "LLM Failure").otherwise("security").alias("category"),
        F.when(k < 30, on_system).alias("source"),
        F.when(k >= 30, on_system).alias("provenance"),
        F.when(k < 20, "<system>").alias("file_path"),
        F.when(k >= 20, F.struct(F.when(k < 75, "<system>").otherwise("src/a.py").alias("path"))).alias("scope"),
        F.when(k < 35, text).alias("message"),
        F.when(k >= 35, text).alias("impact"),
    )
    run = F.concat_ws(":", "run_id", F.date_format("ts", "yyyy-MM-dd"))
    return pinned(e, raw=V.parse(F.to_json(fields))).select(run.alias("run_id"), "raw")


@query(
    "outage_class",
    f"""SELECT run_id, reason, reason = 'single_system_llm_provider_outage' AS break_glass, p0 + p2 AS blocking_count, p0 AS p0_count,
          CAST(0 AS BIGINT) AS p1_count, p2 AS p2_count FROM (SELECT *, CASE WHEN p2 > 0 THEN 'blocking_non_p0_findings_present'
            WHEN p0 <> 1 THEN 'expected_exactly_one_p0_llm_failure' WHEN NOT (k < 70 AND value < 60) THEN 'p0_is_not_system_llm_failure'
            WHEN NOT k < 60 THEN 'llm_failure_message_missing_fail_closed_markers'
            WHEN NOT k < 50 THEN 'llm_failure_not_provider_capacity_class' ELSE 'single_system_llm_provider_outage' END AS reason
          FROM (SELECT run_id || ':' || strftime(ts, '%Y-%m-%d') AS run_id, count(*) FILTER (kind = 'error') AS p0,
                  count(*) FILTER (kind = 'click' AND k < 20) AS p2, max(k) FILTER (kind = 'error') AS k, max(value) FILTER (kind = 'error') AS value
                FROM ({EVENTS_SQL}) GROUP BY 1))""",
)
def outage_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outage.classify_outages(outage.outage_fields(external_findings(spark, sf_dir)))
