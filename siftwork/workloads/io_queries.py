"""Findings and summaries written as JSON to the shared folder and read back."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwork.functions import variants as V
from siftwork.operators import gates, normalize, routing, scan
from siftwork.plans.pin import exploded, pinned
from siftwork.plans.ranking import first_per_group
from siftwork.plans.session import shared_folder
from siftwork.schemas import as_findings
from siftwork.sources import findings as source, sinks
from siftwork.sources.committed import committed_files
from siftwork.sources.files import scan_files
from siftwork.sources.reports import read_reports
from siftwork.workloads.fix_queries import ROUTES_SQL, routes
from siftwork.workloads.inputs import (
    CHAT_HITS_SQL, DOC_FILE_SQL, DOC_HITS_SQL, EVENTS_SQL, RULES, WS_SQL, by_kind, events, report_rows_sql, reports, table,
)
from siftwork.workloads.registry import query
from siftwork.workloads.scan_queries import chat_findings, doc_findings


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


_WRITTEN_SQL = f"""SELECT run_id, 'policy' AS gate_id, severity, file, line, title, 'policy:forbid-pattern:' || rule_no AS rule_id,
  left(trim(t, {WS_SQL}), 240) AS evidence, decision, CAST(1 AS DOUBLE) AS confidence FROM ({DOC_HITS_SQL})"""


@query("findings_written", _WRITTEN_SQL)
def findings_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan findings after a round trip through JSON lines, one folder per run."""
    folder = fresh_folder(spark)
    sinks.write_findings(doc_findings(spark, sf_dir), folder)
    back = source.read_findings(spark, f"{folder}/*", mode="strict")
    return back.select(
        "run_id", "gate_id", "severity", "file", F.col("line").cast("long").alias("line"), "title", "rule_id", "evidence",
        "decision", "confidence",
    )


@query("findings_committed", _WRITTEN_SQL)
def findings_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan findings after a round trip through a manifest, in two commits."""
    folder = fresh_folder(spark)
    found = doc_findings(spark, sf_dir)
    sinks.commit_findings(found.filter("severity = 'P0'"), folder)
    sinks.commit_findings(found.filter("severity != 'P0'"), folder, "append")
    back = source.read_findings(spark, committed_files(folder), mode="strict")
    return back.select(
        "run_id", "gate_id", "severity", "file", F.col("line").cast("long").alias("line"), "title", "rule_id", "evidence",
        "decision", "confidence",
    )


@query(
    "lenient_read",
    f"""SELECT severity, file, CAST(line AS BIGINT) AS line, 'Event ' || event_id AS title, 'R' || event_id AS rule_id,
          'fix ' || event_id AS recommended_fix FROM (
          SELECT event_id, file, line, CASE kind WHEN 'error' THEN 'P0' ELSE 'P2' END AS severity
          FROM (SELECT event_id, event_type AS kind, CAST(floor(value) AS INTEGER) AS line,
                  'src/' || event_type || '/f' || CAST(props->>'$.k' AS INTEGER) || '.ts' AS file FROM events)
          WHERE kind IN ('click', 'error', 'purchase'))""",
)
def lenient_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed lines: camelCase, snake_case, cut-off JSON, non-objects and blanks."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int").cast("string")
    file = F.concat(F.lit("src/"), "event_type", F.lit("/f"), k, F.lit(".ts"))
    row = F.to_json(
        F.struct(
            F.when(F.col("event_type") == "error", "P0").alias("severity"),
            file.alias("file"),
            F.floor("value").cast("string").alias("line"),
            F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("title"),
            # One style of keys or the other, and never both.
            *[
                F.when(F.col("event_type") == "error" if camel else F.col("event_type") != "error", F.concat(F.lit(lead), F.col("event_id").cast("string"))).alias(key)
                for key, lead, camel in (("ruleId", "R", True), ("rule_id", "R", False), ("recommendedFix", "fix ", True), ("recommended_fix", "fix ", False))
            ],
        )
    )
    line = (
        F.when(F.col("event_type") == "signup", F.concat(row, F.lit(",")))
        .when(F.col("event_type") == "view", F.concat(F.lit("["), row, F.lit("]\n  \n7")))
        .otherwise(F.concat(F.lit(" "), row, F.lit("\n")))
    )
    folder = fresh_folder(spark)
    e.select(line.alias("value")).write.text(folder)
    back = source.read_findings(spark, folder)
    return back.select("severity", "file", F.col("line").cast("long").alias("line"), "title", "rule_id", "recommended_fix")


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as external findings with the path and line under one of several names."""
    e = events(spark, sf_dir)
    n = F.col("line")
    doc = by_kind(
        F.to_json(F.struct(F.struct(F.concat(F.lit(" "), "file").alias("path"), n.alias("line_start")).alias("scope"), F.lit("x").alias("file"))),
        F.to_json(F.struct(F.struct(F.lit("").alias("path"), F.col("file").alias("file"), n.cast("string").alias("lineStart")).alias("scope"))),
        F.to_json(F.struct(F.lit(5).alias("scope"), F.col("file").alias("path"), (-n).alias("line"))),
        F.to_json(F.struct(F.lit(" ").alias("filename"), F.lit("7th").alias("line"))),
        F.to_json(F.struct(F.col("file").alias("filename"), F.lit(0).alias("line"), n.alias("line_start"), F.lit("id").alias("finding_id"))),
    )
    return pinned(e, raw=V.parse(doc)).select("run_id", F.col("event_id").alias("seq"), "raw")


@query(
    "finding_locator",
    f"""SELECT event_id AS seq, CASE kind WHEN 'signup' THEN 'repo' ELSE file END AS file,
          CAST(CASE kind WHEN 'purchase' THEN 0 WHEN 'signup' THEN 0 ELSE line END AS BIGINT) AS line,
          CASE kind WHEN 'view' THEN 'id' WHEN 'signup' THEN '||repo|0|' WHEN 'purchase' THEN '||' || file || '|0|' ELSE '||' || file || '|' || line || '|' END AS fingerprint
        FROM ({EVENTS_SQL})""",
)
def finding_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gates.loose_findings(_loose(spark, sf_dir))
    fp = gates.fingerprint(*[F.col(c) for c in ("given", "severity", "kind", "file", "line", "title")])
    return out.select("seq", "file", F.col("line").cast("long").alias("line"), fp.alias("fingerprint"))


@query(
    "judge_json",
    f"""SELECT severity, title, n FROM (SELECT CASE kind WHEN 'error' THEN 'P0' ELSE 'P3' END AS severity, 'Event ' || event_id AS title,
          CAST(unnest(CASE kind WHEN 'view' THEN [0, 1] ELSE [0] END) AS BIGINT) AS n FROM ({EVENTS_SQL}) WHERE kind IN ('click', 'error', 'view'))""",
)
def judge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of judge documents: lists, objects with findings, and text that holds neither."""
    e = events(spark, sf_dir)
    item = F.to_json(
        F.struct(
            F.when(F.col("kind") == "error", "P0").otherwise("P3").alias("severity"),
            F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("title"),
        )
    )
    doc = by_kind(
        F.concat(F.lit("["), item, F.lit("]")), F.concat(F.lit('{"findings":['), item, F.lit("]}")), F.lit('{"findings":3}'), F.lit("[{]"),
        F.concat(F.lit('{"Findings":['), item, F.lit(","), item, F.lit("]}")),
    )
    rows = exploded(e, [], V.json_list(V.parse(doc)), "n", "raw")
    return rows.select(V.text_at(F.col("raw"), "$.severity").alias("severity"), V.text_at(F.col("raw"), "$.title").alias("title"), F.col("n").cast("long").alias("n"))


@query(
    "merged_written",
    f"""SELECT DISTINCT run_id, '{{"impact":"rule ' || rule_no || '","scope":{{"line_start":' || line || ',"path":"' || file || '"}},"severity":"' || severity ||
          '","title":"' || title || '","zone":null}}' AS value
        FROM (SELECT run_id, rule_no, severity, title, file, line FROM ({CHAT_HITS_SQL}) UNION ALL
              SELECT run_id, rule_no, severity, title, file, line FROM ({DOC_HITS_SQL}))""",
)
def merged_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both feeds, loose JSON rows with keys of their own, merged by fingerprint, written and read back whole."""

    def loose(findings: DataFrame) -> DataFrame:
        body = F.struct(
            F.lit(None).cast("string").alias("zone"), "severity", "title", F.concat(F.lit("rule "), F.col("seq").cast("string")).alias("impact"),
            F.struct(F.col("file").alias("path"), F.col("line").alias("line_start")).alias("scope"),
        )
        raw = V.parse(F.to_json(body, {"ignoreNullFields": "false"}))
        rows = gates.loose_findings(findings.select("run_id", "seq", raw.alias("raw")))
        fp = gates.fingerprint(*[F.col(c) for c in ("given", "severity", "kind", "file", "line", "title")])
        return rows.withColumn("fingerprint", fp)

    folder = fresh_folder(spark)
    feed = doc_findings(spark, sf_dir)
    merged = gates.merge_feeds(loose(chat_findings(spark, sf_dir)), loose(feed.unionByName(feed)))
    sinks.write_merged(merged, folder)
    return spark.read.schema("value string, run_id string").text(folder).select("run_id", "value")


@query(
    "loose_report",
    f"""SELECT run_id, file || ':' || line AS locator, coalesce(nullif(severity, ''), 'P3') AS severity, category, impact, fix FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE severity WHEN 'P0' THEN 0 WHEN '' THEN 9 ELSE 1 END, file, line, event_id) AS r FROM (
            SELECT event_id, run_id, file, line, CASE kind WHEN 'error' THEN 'P0' ELSE '' END AS severity,
              CASE kind WHEN 'view' THEN 'tool' ELSE 'cat' END AS category, 'impact of ' || event_id AS impact,
              CASE kind WHEN 'view' THEN 'guide ' || event_id ELSE 'fix ' || event_id END AS fix
            FROM ({EVENTS_SQL}) WHERE kind IN ('error', 'view') AND line > 0)) WHERE r <= 10""",
)
def loose_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report columns of external findings: impact, category before the tool, guidance before the fix, no severity as P3."""
    e = events(spark, sf_dir).filter("kind IN ('error', 'view') AND line > 0")
    view, n = F.col("kind") == "view", F.col("event_id").cast("string")
    body = F.struct(
        F.when(~view, "p0").alias("severity"), "file", "line", F.lit("tool").alias("tool"), F.when(~view, "cat").alias("category"),
        F.concat(F.lit("impact  of "), n).alias("impact"), F.concat(F.lit("fix "), n).alias("recommended_fix"),
        F.when(view, F.concat(F.lit("guide "), n)).alias("remediation_guidance"),
    )
    rows = pinned(e, raw=V.parse(F.to_json(body))).select("run_id", F.col("event_id").alias("seq"), "raw")
    top = gates.top_findings(gates.loose_findings(rows))
    return gates.report_rows(top, F.lit("a/b"), F.lit("")).select("run_id", "locator", "severity", "category", "impact", "fix")


@query(
    "feed_order",
    f"""SELECT run_id, first(line ORDER BY event_id) AS line, first(title ORDER BY event_id) AS title FROM (
          SELECT event_id, run_id, CAST(line AS BIGINT) AS line, 'Event ' || event_id AS title FROM ({EVENTS_SQL})) GROUP BY run_id""",
)
def feed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-first over a feed gives the same rows after a round trip through files as before it."""
    rows = events(spark, sf_dir).select("run_id", F.col("event_id").alias("seq"), "line", F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("title"))
    folder = fresh_folder(spark)
    sinks.write_findings(as_findings(rows), folder, by_run=False)
    back = source.read_findings(spark, folder)
    return first_per_group(back, ["run_id"], [F.col("seq")]).select("run_id", F.col("line").cast("long").alias("line"), "title")


@query(
    "run_summaries",
    f"""SELECT run_id, p0, p1, p2, p3, p0 + p1 > 0 AS blocking, CASE WHEN p0 + p1 > 0 THEN 'blocked' WHEN bad THEN 'error' ELSE 'passed' END AS verdict,
          'security:' || CASE WHEN bad THEN 'error' ELSE 'ok' END || ':' || n AS gates FROM (
          SELECT run_id, count(*) FILTER (severity = 'P0') AS p0, count(*) FILTER (severity = 'P1') AS p1, count(*) FILTER (severity = 'P2') AS p2,
            count(*) FILTER (severity = 'P3') AS p3, count(severity) AS n, bool_or(severity IS NULL) AS bad FROM (
            SELECT run_id, severity FROM ({report_rows_sql('tflint')}) UNION ALL
            SELECT 'u' || user_id, NULL FROM events WHERE event_type = 'signup') GROUP BY run_id)""",
)
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run summaries of one scanner, written as JSON and read back; unreadable reports make an error."""
    raw = reports(spark, sf_dir, "tflint")
    found = normalize.normalize_reports(raw)
    results = gates.gate_results(raw)
    verdicts = gates.run_verdicts(raw, found, "P1", errors=results.filter(F.col("status") == "error"))
    folder = fresh_folder(spark)
    summaries = sinks.run_summaries(verdicts, results, "P1")
    sinks.write_summaries(summaries, folder)
    back = spark.read.schema(summaries.schema).json(folder)
    shown = F.transform("gates", lambda g: F.concat_ws(":", g["gate_id"], g["status"], g["finding_count"].cast("string")))
    return back.select(
        "run_id", *[F.col(f"counts.{s}").alias(s.lower()) for s in ("P0", "P1", "P2", "P3")], "blocking", "verdict",
        F.array_join(shown, ",").alias("gates"),
    )


@query(
    "run_summary_blocks",
    f"""WITH s AS (
          SELECT run_id, CASE WHEN count(*) FILTER (severity IN ('P0', 'P1')) > 0 THEN 'blocked' WHEN bool_or(severity IS NULL) THEN 'error' ELSE 'passed' END AS verdict
          FROM (SELECT run_id, severity FROM ({report_rows_sql('tflint')}) UNION ALL SELECT 'u' || user_id, NULL FROM events WHERE event_type = 'signup') GROUP BY run_id),
        p AS (SELECT run_id, CASE WHEN bool_or(kind = 'error') THEN 'invalid' ELSE 'loaded' END AS policy_status, count(*) AS policy_rules FROM ({EVENTS_SQL}) GROUP BY run_id),
        d AS (SELECT run_id, string_agg(DISTINCT persona, ',' ORDER BY persona) AS personas, count(*) FILTER (persona IS NULL) AS unrouted,
          greatest(count(*) FILTER (persona = 'backend') - 10, 0) + greatest(count(*) FILTER (persona = 'frontend') - 10, 0) AS remaining FROM ({ROUTES_SQL}) GROUP BY run_id)
        SELECT run_id, verdict, policy_status, policy_rules, coalesce(personas, '') AS personas, unrouted, remaining
        FROM s LEFT JOIN p USING (run_id) LEFT JOIN d USING (run_id)""",
)
def run_summary_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run summaries with what they tell of the policy and of the personas' files, written as JSON and read back."""
    raw = reports(spark, sf_dir, "tflint")
    results = gates.gate_results(raw)
    verdicts = gates.run_verdicts(raw, normalize.normalize_reports(raw), "P1", errors=results.filter(F.col("status") == "error"))
    policies = events(spark, sf_dir).groupBy("run_id").agg(
        F.when(F.bool_or(F.col("kind") == "error"), "invalid").otherwise("loaded").alias("status"), F.count(F.lit(1)).alias("rules")
    )
    dispatch = routing.dispatch_summary(routes(spark, sf_dir), per_persona=10)
    folder = fresh_folder(spark)
    summaries = sinks.run_summaries(verdicts, results, "P1", policies, dispatch)
    sinks.write_summaries(summaries, folder)
    back = spark.read.schema(summaries.schema).json(folder)
    personas = F.coalesce(F.array_join("persona_dispatch.personas", ","), F.lit(""))
    return back.select(
        "run_id", "verdict", F.col("policy.status").alias("policy_status"), F.col("policy.rules").alias("policy_rules"),
        personas.alias("personas"), "persona_dispatch.unrouted", "persona_dispatch.remaining",
    )


def _files(rows: DataFrame, folder: str) -> DataFrame:
    """Write each row's ``payload`` to the file ``name`` below the folder, from the tasks; the names that were written."""

    def write(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = batch.column("name").to_pylist()
            for name, payload in zip(names, batch.column("payload").to_pylist()):
                fs.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                    f.write(payload.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names)], ["name"])

    return rows.select("name", "payload").mapInArrow(write, "name string")


@query(
    "reports_read",
    f"""SELECT run_id, tool, severity, file, line, title FROM ({report_rows_sql('tflint')}) WHERE run_id || tool || title IN (
          SELECT first(run_id || 'tflint' || 'Event ' || event_id ORDER BY event_id) FROM ({EVENTS_SQL}) WHERE kind <> 'signup' GROUP BY run_id)
        UNION ALL SELECT run_id, tool, severity, file, line, title FROM ({report_rows_sql('tsc')}) WHERE run_id || tool || title IN (
          SELECT first(run_id || 'tsc' || 'Event ' || event_id ORDER BY event_id) FROM ({EVENTS_SQL}) WHERE kind <> 'signup' GROUP BY run_id)""",
)
def reports_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first readable report of two tools of each run, as files of a folder per run, read back and normalised."""
    raw = reports(spark, sf_dir, "tflint", "tsc").join(events(spark, sf_dir).filter("kind <> 'signup'").select("event_id"), "event_id")
    first = first_per_group(raw, ["run_id", "tool"], [F.col("event_id")])
    ending = F.when(F.col("tool") == "tsc", ".txt").otherwise(".json")
    folder = fresh_folder(spark)
    _files(first.withColumn("name", F.concat("run_id", F.lit("/"), "tool", ending)), folder).count()
    found = normalize.normalize_reports(read_reports(spark, folder))
    return found.select("run_id", "tool", "severity", "file", F.col("line").cast("long").alias("line"), "title")


@query(
    "tree_scan",
    f"""SELECT run_id, file, line, rule_no, CAST(NULL AS VARCHAR) AS skipped FROM (SELECT 'tree' AS run_id, file, line, CAST(rule_no AS BIGINT) AS rule_no FROM ({DOC_HITS_SQL})
          WHERE file IN (SELECT {DOC_FILE_SQL} FROM documents WHERE lang <> 'fr' AND strlen(text) <= 2000))
        UNION ALL SELECT 'tree', {DOC_FILE_SQL}, 0, 0, 'File was not scanned: too large' FROM documents WHERE lang <> 'fr' AND strlen(text) > 2000""",
)
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a source tree, some in an excluded folder; files past the size limit come out as findings."""
    d = table(spark, sf_dir, "documents")
    file = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    name = F.when(F.col("lang") == "fr", F.concat(F.lit("node_modules/"), file)).otherwise(file)
    folder = fresh_folder(spark)
    _files(d.select(name.alias("name"), F.col("text").alias("payload")), folder).count()
    files = scan_files(spark, folder, "tree", max_bytes=2000)
    found = scan.scan_rules(files, RULES).unionByName(scan.skipped_findings(files))
    return found.select("run_id", "file", F.col("line").cast("long").alias("line"), F.col("seq").alias("rule_no"), F.when(F.col("rule_id") == "policy:not-scanned", F.col("description")).alias("skipped"))


@query(
    "judge_files",
    f"""SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY event_id) - 1 AS BIGINT) AS n, 'Event ' || event_id AS title FROM ({EVENTS_SQL})""",
)
def judge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One judge file per run, a list or an object with findings, read by the reader."""
    item = F.to_json(F.struct(F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("title")))
    # A run's file is one JSON text by its format.
    listed = events(spark, sf_dir).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("event_id", item.alias("item")))).alias("items"))
    body = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ",\n"), F.lit("]"))
    body = F.when(F.length("run_id") % 2 == 0, F.concat(F.lit('{"findings":'), body, F.lit("}"))).otherwise(body)
    folder = fresh_folder(spark)
    _files(listed.select(F.concat("run_id", F.lit(".json")).alias("name"), body.alias("payload")), folder).count()
    back = source.read_judge_json(spark, folder)
    run = F.regexp_extract("file_name", r"([^/]+)\.json$", 1)
    return back.select(run.alias("run_id"), F.col("seq").cast("long").alias("n"), V.text_at(F.col("raw"), "$.title").alias("title"))


@query(
    "custom_gate",
    f"""SELECT run_id, gate_id, count(*) AS n FROM (SELECT run_id, 'slow' AS gate_id FROM ({EVENTS_SQL}) WHERE value > 300
          UNION ALL SELECT run_id, 'policy' FROM ({DOC_HITS_SQL})) GROUP BY run_id, gate_id""",
)
def custom_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's gate, held to the schema, beside the scan."""

    def gate(e: DataFrame) -> DataFrame:
        slow = e.filter(F.col("value") > 300)
        return slow.select("run_id", F.lit("slow").alias("gate_id"), F.lit("timer").alias("tool"), F.lit("P2").alias("severity"), "file", F.lit("Slow").alias("title"))

    found = gates.combine(gates.run_custom_gate(events(spark, sf_dir), gate), doc_findings(spark, sf_dir))
    return found.groupBy("run_id", "gate_id").agg(F.count(F.lit(1)).alias("n"))
