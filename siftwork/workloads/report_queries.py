"""Tool reports, persona reports and sandbox logs to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwork.operators import gates, judge, normalize
from siftwork.workloads.inputs import EVENTS_SQL, by_kind, events, report_rows_sql, reports, text
from siftwork.workloads.judge_queries import categories, phrases
from siftwork.workloads.registry import query

_COLUMNS = ("run_id", "tool", "severity", "file", "line", "title", "rule_id")


def _shown(findings: DataFrame) -> DataFrame:
    return findings.withColumn("line", F.col("line").cast("long")).select(*_COLUMNS)


def _register(tool: str) -> None:
    @query("norm_" + tool.replace("-scanner", ""), report_rows_sql(tool))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(normalize.normalize_tool(reports(spark, sf_dir, tool), tool))


for _tool in normalize.TOOLS:
    _register(_tool)


@query("norm_all", " UNION ALL ".join(report_rows_sql(t) for t in normalize.TOOLS))
def norm_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tools' reports in one pass over one mixed table."""
    return _shown(normalize.normalize_reports(reports(spark, sf_dir, *normalize.TOOLS)))


_GATE_SQL = "CASE WHEN tool IN ('tsc', 'eslint', 'prettier') THEN 'static' ELSE 'security' END"
_ALL_ROWS_SQL = " UNION ALL ".join(report_rows_sql(t) for t in normalize.TOOLS)


@query(
    "gate_results",
    f"""WITH n AS (SELECT run_id, {_GATE_SQL} AS gate_id, count(*) AS finding_count FROM ({_ALL_ROWS_SQL}) GROUP BY ALL),
          r AS (SELECT run_id, gate_id, bool_or(kind = 'signup') AS bad
                FROM ({EVENTS_SQL}), (VALUES ('static'), ('security')) AS g(gate_id) GROUP BY ALL)
        SELECT run_id, gate_id, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status,
          coalesce(finding_count, 0) AS finding_count,
          CASE WHEN bad THEN 'unreadable report: ' || CASE gate_id WHEN 'static' THEN 'eslint' ELSE 'checkov' END END
            AS error_message
        FROM r LEFT JOIN n USING (run_id, gate_id)""",
)
def gate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = reports(spark, sf_dir, *normalize.TOOLS)
    return gates.gate_results(raw)


@query(
    "tool_meta",
    f"""WITH n AS (SELECT run_id, tool, count(*) AS n FROM ({_ALL_ROWS_SQL}) GROUP BY ALL),
          s AS (SELECT run_id, tool, enabled, bool_or(kind = 'signup') AS signup FROM ({EVENTS_SQL}),
                  (VALUES ('eslint', true), ('semgrep', true), ('tsc', true), ('trivy', true), ('osv-scanner', false)) AS t(tool, enabled)
                GROUP BY ALL)
        SELECT run_id, tool, enabled AND tool <> 'trivy' AS invoked,
          CASE WHEN NOT enabled THEN 'disabled' WHEN tool = 'trivy' THEN 'no-report'
               WHEN signup AND tool IN ('eslint', 'semgrep') THEN 'parse-error' END AS reason,
          CASE WHEN enabled AND tool <> 'trivy' THEN coalesce(n, 0) ELSE 0 END AS finding_count
        FROM s LEFT JOIN n USING (run_id, tool)""",
)
def tool_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = reports(spark, sf_dir, "eslint", "semgrep", "tsc", "osv-scanner")
    tools = [("eslint", True), ("semgrep", True), ("tsc", True), ("trivy", True), ("osv-scanner", False)]
    rows = F.array(*[F.struct(F.lit(t).alias("tool"), F.lit(on).alias("enabled")) for t, on in tools])
    switches = events(spark, sf_dir).select("run_id").distinct().select("run_id", F.inline(rows))
    return gates.tool_meta(raw, None, switches)


def _sandbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    log = by_kind(
        F.concat(F.lit("start\nbwrap: open failed: Operation not permitted: '/etc/f"), F.col("k").cast("string"), F.lit("'.\nend")),
        F.concat(F.lit("connect: NETWORK is unreachable: host"), F.col("k").cast("string"), F.lit(":")),
        F.concat(F.lit("cat: Permission denied: "), "file", F.lit(" \r\n\r\nsocket: Address family not supported")),
        text(""),
        text("nothing to see\npermission denied"),
    )
    return e.select("run_id", log.alias("payload"))


@query(
    "sandbox_violations",
    f"""SELECT run_id, line, kind, target FROM (
          SELECT run_id, CAST(2 AS BIGINT) AS line, 'fs_write' AS kind, '/etc/f' || k AS target FROM ({EVENTS_SQL}) WHERE kind = 'click'
          UNION ALL SELECT run_id, CAST(1 AS BIGINT), 'network', 'connect: NETWORK is unreachable: host' || k || ':' FROM ({EVENTS_SQL}) WHERE kind = 'error'
          UNION ALL SELECT run_id, CAST(1 AS BIGINT), 'fs_read', file FROM ({EVENTS_SQL}) WHERE kind = 'purchase'
          UNION ALL SELECT run_id, CAST(3 AS BIGINT), 'network', 'Address family not supported' FROM ({EVENTS_SQL}) WHERE kind = 'purchase'
          UNION ALL SELECT run_id, CAST(2 AS BIGINT), 'fs_read', 'permission denied' FROM ({EVENTS_SQL}) WHERE kind = 'view')""",
)
def sandbox_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.sandbox_violations(_sandbox(spark, sf_dir))
    return out.select("run_id", F.col("line").cast("long").alias("line"), "kind", "target")


def _persona_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    item = F.to_json(
        F.struct(
            by_kind(text("p0"), text(None), text("P2"), text("high"), text("P1")).alias("severity"),
            F.when(F.col("k") >= 5, F.concat(F.lit(" lib\\"), "kind", F.lit(" "))).alias("file"),
            F.col("line"),
            F.when(F.col("kind") == "click", F.lit("")).otherwise("Title").alias("title"),
            F.concat(F.lit("Message "), F.col("event_id").cast("string")).alias("message"),
            F.lit("").alias("rootCause"),
            F.lit(" cause ").alias("description"),
            F.col("kind"),
            F.round(F.lit(1.0) - F.col("k") / 200, 3).alias("confidence"),
            F.lit("do this").alias("recommended_fix"),
        )
    )
    body = F.when(F.col("k") < 50, F.concat(F.lit("["), item, F.lit(",1]"))).otherwise(
        F.concat(F.lit('{"Findings":["x",'), item, F.lit("]}"))
    )
    return e.select(F.col("event_id").cast("string").alias("run_id"), F.lit("backend").alias("tool"), body.alias("payload"))


@query(
    "persona_findings",
    f"""SELECT CAST(event_id AS VARCHAR) AS run_id, 'backend' AS tool, severity, 'lib/' || kind AS file,
          CAST(line AS BIGINT) AS line, CASE kind WHEN 'click' THEN 'Message ' || event_id ELSE 'Title' END AS title,
          'cause' AS description, kind AS rule_id, confidence, 'do this' AS recommended_fix
        FROM (SELECT *, CASE kind WHEN 'click' THEN 'P0' WHEN 'view' THEN 'P1' ELSE 'P2' END AS severity,
                round(1.0 - k / 200, 3) AS confidence FROM ({EVENTS_SQL}))
        WHERE kind <> 'signup' AND k >= 5 AND confidence >= CASE severity WHEN 'P2' THEN 0.85 ELSE 0.8 END""",
)
def persona_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.persona_candidates(_persona_reports(spark, sf_dir))
    judged = judge.judge(rows, categories(spark, sf_dir), phrases(spark, sf_dir), gate_id="persona_dispatch")
    return judge.accepted(judged).select(
        "run_id", "tool", "severity", "file", F.col("line").cast("long").alias("line"), "title", "description",
        "rule_id", "confidence", "recommended_fix",
    )

