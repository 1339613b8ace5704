"""Ownership routing and fix requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwork.operators import fixes, routing
from siftwork.schemas import as_findings
from siftwork.workloads.inputs import EVENTS_SQL, by_kind, events, text
from siftwork.workloads.registry import query


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a finding of its user's run."""
    e = events(spark, sf_dir)
    severity = by_kind(*[F.lit(s) for s in ("P2", "P0", "P1", "P3", "P1")])
    return as_findings(
        e,
        seq=F.col("event_id"),
        gate_id=F.lit("static"),
        tool=F.when(F.col("k") < 10, "Security ").otherwise("eslint"),
        severity=severity,
        file=F.when(F.col("k") < 2, " ").otherwise(F.replace("file", F.lit("/f"), F.lit("\\f"))),
        title=F.concat(F.lit("Finding "), F.col("event_id").cast("string")),
        description=F.when(F.col("k") < 50, "about").otherwise(""),
        rule_id=F.when(F.col("kind") == "purchase", F.concat(F.lit("rule-"), F.col("k").cast("string"))),
        evidence=F.when(F.col("k") >= 50, "seen"),
    )


def _owner(k: Column) -> Column:
    return F.when(k < 40, " Backend").when(k < 60, "frontend").when(k < 70, "nobody")


def ownership(spark: SparkSession, sf_dir: str, key: str = "run_id") -> DataFrame:
    """Owners by file number, one row per run and file; some files have none, some an unknown one."""
    e = events(spark, sf_dir).filter(F.col("k") < 70)
    return e.select(F.col("run_id").alias(key), "file", _owner(F.col("k")).alias("persona")).distinct()


ROUTES_SQL = f"""
    SELECT DISTINCT run_id, file, CASE WHEN k < 40 THEN 'backend' WHEN k < 60 THEN 'frontend' END AS persona
    FROM ({EVENTS_SQL}) WHERE kind IN ('error', 'purchase', 'view') AND k >= 2"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(event_findings(spark, sf_dir), ownership(spark, sf_dir))


@query(
    "route_personas",
    f"""SELECT run_id, persona, string_agg(file, ',' ORDER BY file) AS files, count(*) AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id, persona ORDER BY file) AS p FROM ({ROUTES_SQL}) WHERE persona IS NOT NULL)
        WHERE p <= 10 GROUP BY run_id, persona""",
)
def route_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets with a cap of ten files, small enough to bite here."""
    b = routing.persona_buckets(routes(spark, sf_dir), per_persona=10)
    return b.select("run_id", "persona", F.array_join("files", ",").alias("files"), F.size("files").cast("long").alias("n"))


@query(
    "remaining_files",
    f"""SELECT run_id, persona, file FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id, persona ORDER BY file) AS p FROM ({ROUTES_SQL}) WHERE persona IS NOT NULL) WHERE p > 10""",
)
def remaining_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the buckets leave for a later round."""
    return routing.remaining_files(routes(spark, sf_dir), per_persona=10)


@query("unrouted", f"SELECT run_id, file FROM ({ROUTES_SQL}) WHERE persona IS NULL")
def unrouted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.unrouted_files(routes(spark, sf_dir))


@query(
    "dispatch_summary",
    f"""SELECT run_id, string_agg(DISTINCT persona, ',' ORDER BY persona) AS personas, count(*) FILTER (persona IS NULL) AS unrouted,
          greatest(count(*) FILTER (persona = 'backend') - 10, 0) + greatest(count(*) FILTER (persona = 'frontend') - 10, 0) AS remaining,
          CASE WHEN r.run_id LIKE '%1' THEN 'backend' ELSE '' END AS failed_personas,
          (SELECT count(*) FROM ({EVENTS_SQL}) e WHERE e.run_id = r.run_id) AS persona_findings
        FROM ({ROUTES_SQL}) r GROUP BY run_id""",
)
def dispatch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routes(spark, sf_dir)
    failures = found.filter(F.col("run_id").endswith("1")).select("run_id", F.lit("backend").alias("persona"))
    out = routing.dispatch_summary(found, event_findings(spark, sf_dir), failures, per_persona=10)
    out = out.withColumn("failed_personas", F.array_join("failed_personas", ","))
    return out.withColumn("personas", F.nullif(F.array_join("personas", ","), F.lit("")))


def _ownership_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    pattern = by_kind(
        F.concat(F.lit('"./'), "file", F.lit('"')),
        F.concat(F.lit(" './.github/"), F.col("k").cast("string"), F.lit("' ")),
        F.concat(F.lit("src/*/"), F.col("k").cast("string")),
        F.col("file"),
        F.concat(F.lit("src/view/["), F.col("k").cast("string"), F.lit("]")),
    )
    return e.select(
        F.col("run_id").alias("repo"), F.col("event_id").alias("seq"), pattern.alias("pattern"),
        F.concat(F.lit("'p"), F.floor("value").cast("string"), F.lit("'")).alias("persona"),
    )


def _ownership_sql(file_of_error: str) -> str:
    return f"""SELECT repo, file, arg_max(persona, event_id) AS persona FROM (
          SELECT run_id AS repo, event_id, 'p' || line AS persona,
            CASE kind WHEN 'error' THEN {file_of_error} ELSE file END AS file
          FROM ({EVENTS_SQL}) WHERE kind IN ('click', 'error', 'signup')) GROUP BY repo, file"""


@query("ownership_rules", _ownership_sql("'.github/' || k"))
def ownership_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.read_ownership(_ownership_rules(spark, sf_dir))


@query("ownership_rules_parity", _ownership_sql("'github/' || k"))
def ownership_rules_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.read_ownership(_ownership_rules(spark, sf_dir), parity=True)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    k = F.col("k").cast("string")
    body = by_kind(
        F.concat(F.lit("/gate fix static:src-error\\f"), k, F.lit(":"), F.col("line").cast("string"), F.lit(" --persona nobody")),
        F.concat(F.lit("Please\n/gate  fix rule-"), k, F.lit(" --persona Security --reason  needs a retry budget \nthanks")),
        F.concat(F.lit("/gate fix rule-"), k),
        text("/gate fix"),
        F.concat(F.lit("ship it, see x/gate fix rule-"), k),
    )
    return e.select(F.col("run_id").alias("build_id"), F.col("event_id").alias("seq"), body.alias("body"))


COMMANDS_SQL = f"""
    SELECT run_id AS build_id, event_id AS seq, CASE kind WHEN 'click' THEN 'static:src-error' ELSE 'rule-' || k END AS finding_id,
      CASE kind WHEN 'error' THEN 'security' END AS persona_override,
      CASE kind WHEN 'error' THEN 'needs a retry budget' END AS reason
    FROM ({EVENTS_SQL}) WHERE kind IN ('click', 'error', 'purchase')"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes.parse_commands(comments(spark, sf_dir), "/gate")


@query("fix_commands", COMMANDS_SQL)
def fix_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands(spark, sf_dir).drop("body")


# Sequential reading of the admission rule: running count of first requests.
ADMISSION_SQL = f"""
    SELECT *, bool_or(accepted) OVER (PARTITION BY build_id, finding_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AND NOT accepted AS already_attempted,
      NOT bool_or(accepted) OVER (PARTITION BY build_id, finding_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS rate_limited
    FROM (SELECT *, first AND sum(CAST(first AS INTEGER)) OVER (PARTITION BY build_id ORDER BY seq) <= 3 AS accepted
      FROM (SELECT *, row_number() OVER (PARTITION BY build_id, finding_id ORDER BY seq) = 1 AS first FROM ({COMMANDS_SQL})))"""


@query(
    "fix_admission",
    f"""SELECT build_id, seq, finding_id, accepted, already_attempted, rate_limited, CASE WHEN accepted THEN 'accepted fix ' || finding_id
          WHEN already_attempted THEN 'finding ' || finding_id || ' already attempted in this build'
          ELSE 'per-build fix limit (3) reached' END AS decision_reason FROM ({ADMISSION_SQL})""",
)
def fix_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes.admit_fixes(commands(spark, sf_dir)).select(
        "build_id", "seq", "finding_id", "accepted", "already_attempted", "rate_limited", "decision_reason"
    )


def _index_sql() -> str:
    return f"""SELECT build_id, id, arg_min(struct_pack(k := k, kind := kind, line := line, event_id := event_id), (r, event_id)) AS f FROM (
          SELECT run_id AS build_id, *, 0 AS r, 'rule-' || k AS id FROM ({EVENTS_SQL}) WHERE kind = 'purchase'
          UNION ALL
          SELECT run_id AS build_id, *, 1 AS r, 'static:' || CASE WHEN k < 2 THEN ' ' ELSE 'src-' || kind || '\\f' || k || '.ts' END || ':' || line AS id
          FROM ({EVENTS_SQL})) GROUP BY build_id, id"""


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_findings(spark, sf_dir).withColumnRenamed("run_id", "build_id")
    return fixes.match_findings(fixes.admit_fixes(commands(spark, sf_dir)), found)


@query(
    "fix_match",
    f"""SELECT c.build_id, c.seq, c.finding_id, f.event_id IS NOT NULL AS found, 'Finding ' || f.event_id AS title
        FROM ({COMMANDS_SQL}) c LEFT JOIN ({_index_sql()}) i ON i.build_id = c.build_id AND i.id = c.finding_id""",
)
def fix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir).select("build_id", "seq", "finding_id", "found", "title")


@query(
    "fix_plan",
    f"""SELECT build_id, seq, finding_id, status, CASE status WHEN 'planned' THEN persona END AS persona,
          CASE status WHEN 'planned' THEN finding_id END AS plan_finding_id,
          CASE status WHEN 'planned' THEN CASE WHEN f.k < 2 THEN '' ELSE 'src/purchase/f' || f.k || '.ts' END END AS files,
          CASE status WHEN 'planned' THEN trim('FINDING: Finding ' || f.event_id || chr(10) || 'FILE: '
            || CASE WHEN f.k < 2 THEN ' ' ELSE 'src/purchase\\f' || f.k || '.ts' END || ':' || f.line || chr(10) || 'SEVERITY: P1' || chr(10)
            || 'GATE: static / ' || CASE WHEN f.k < 10 THEN 'Security ' ELSE 'eslint' END || chr(10)
            || CASE WHEN f.k < 50 THEN 'DESCRIPTION: about' ELSE '' END || chr(10) || CASE WHEN f.k >= 50 THEN 'EVIDENCE: seen' ELSE '' END
            || chr(10), chr(10) || ' ') END AS prompt_context,
          CASE status WHEN 'planned' THEN 'fix/' || persona || '/rule-' || f.k END AS branch_name
        FROM (SELECT *, CASE WHEN NOT accepted THEN 'rejected' WHEN f.event_id IS NULL THEN 'not_found' WHEN persona IS NULL THEN 'no_owner'
                ELSE 'planned' END AS status
              FROM (SELECT a.*, f, coalesce(persona_override, CASE WHEN f.k BETWEEN 2 AND 39 THEN 'backend' WHEN f.k BETWEEN 40 AND 59 THEN 'frontend' END,
                      CASE WHEN f.k < 10 THEN 'security' END) AS persona
                    FROM ({ADMISSION_SQL}) a LEFT JOIN ({_index_sql()}) i ON i.build_id = a.build_id AND i.id = a.finding_id))""",
)
def fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = fixes.plan_fixes(matched(spark, sf_dir), ownership(spark, sf_dir, "build_id"))
    return plan.select(
        "build_id", "seq", "finding_id", "status", "persona", "plan_finding_id",
        F.array_join("files", ",").alias("files"), "prompt_context", "branch_name",
    )
