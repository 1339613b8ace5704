"""Corpus scan, counts, verdicts, ranked and merged reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwork.functions import severity as S
from siftwork.functions.text import explode_lines
from siftwork.operators import gates, scan
from siftwork.operators.normalize import normalize_tool
from siftwork.operators.scan import Rule
from siftwork.schemas import SEVERITIES
from siftwork.workloads.inputs import (
    CHAT_HITS_SQL, DOC_FILE_SQL, DOC_HITS_SQL, RULES, WS_SQL, chats, files, lines_sql, report_rows_sql, reports, table,
)
from siftwork.workloads.registry import query


def doc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_rules(files(spark, sf_dir), RULES)


def chat_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_rules(chats(spark, sf_dir), RULES)


def long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


EVIDENCE_SQL = f"left(trim(t, {WS_SQL}), 240)"


@query(
    "scan_findings",
    f"""SELECT run_id, file, line, severity, title, 'policy:forbid-pattern:' || rule_no AS rule_id,
        {EVIDENCE_SQL} AS evidence, decision FROM ({DOC_HITS_SQL})""",
)
def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_findings(spark, sf_dir).select(
        "run_id", "file", long("line"), "severity", "title", "rule_id", "evidence", "decision"
    )


@query(
    "text_lines",
    f"""SELECT run_id, count(*) AS lines, CAST(sum(length(t)) AS BIGINT) AS chars, max(line) AS last_line
        FROM (SELECT *, max(line) OVER (PARTITION BY run_id, file) AS n FROM ({lines_sql('source', DOC_FILE_SQL, 'documents')}))
        WHERE NOT (line = n AND t = '') GROUP BY run_id""",
)
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = explode_lines(files(spark, sf_dir), "text", "run_id")
    return lines.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.length("line_text")).alias("chars"),
        F.max(F.col("line").cast("long")).alias("last_line"),
    )


_SCOPED = [r._replace(in_glob=g) for r, g in zip(RULES, ("*.en", "de/*", "[!f]*", "?[!n]/*"))]


@query(
    "glob_scope",
    f"""SELECT run_id, file, line, rule_no FROM (
          SELECT run_id, file, line, CAST(rule_no AS BIGINT) AS rule_no, split_part(file, '/', 2) AS base FROM ({DOC_HITS_SQL}))
        WHERE CASE rule_no WHEN 1 THEN file LIKE '%.en' WHEN 2 THEN file LIKE 'de/%'
                           WHEN 3 THEN file NOT LIKE 'f%' OR base NOT LIKE 'f%'
                           ELSE file LIKE '_s/%' OR file LIKE '_r/%' OR file LIKE '_e/%' END""",
)
def glob_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan.scan_rules(files(spark, sf_dir), _SCOPED)
    return out.select("run_id", "file", long("line"), F.col("seq").alias("rule_no"))


def _run_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source has the four patterns, numbered and scoped by its own name."""
    runs = table(spark, sf_dir, "documents").select(F.col("source").alias("run_id")).distinct()
    late = F.length("run_id") > 4
    rows = [
        F.struct(
            F.lit(i).alias("rule_no"),
            F.lit(r.pattern).alias("pattern"),
            F.when(late, " p1 ").otherwise(r.severity).alias("severity"),
            F.concat(F.lit("Rule of "), F.col("run_id")).alias("message"),
            F.when(late, "*.en").alias("in_glob"),
            F.lit(r.behavior).alias("behavior"),
        )
        for i, r in enumerate(RULES, 1)
    ]
    bad = F.struct(
        F.lit(9).alias("rule_no"), F.concat(F.lit("("), F.col("run_id"), F.lit("+)+$")).alias("pattern"),
        F.lit("P3").alias("severity"), F.lit("").alias("message"), F.lit(None).cast("string").alias("in_glob"),
        F.lit("allow").alias("behavior"),
    )
    return runs.select("run_id", F.inline(F.array(*rows, bad)))


@query(
    "run_rule_scan",
    f"""SELECT run_id, file, line, CASE WHEN length(run_id) > 4 THEN 'P1' ELSE severity END AS severity,
          'Rule of ' || run_id AS title, 'policy:forbid-pattern:' || rule_no AS rule_id, decision
        FROM ({DOC_HITS_SQL}) WHERE length(run_id) <= 4 OR file LIKE '%.en'
        UNION ALL
        SELECT DISTINCT source, 'policy.yaml', CAST(0 AS BIGINT), 'P1', 'Unsafe policy forbid pattern',
          'policy:forbid-pattern:9:unsafe-regex', 'deny' FROM documents""",
)
def run_rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan.scan_run_rules(files(spark, sf_dir), _run_rules(spark, sf_dir))
    return out.select("run_id", "file", long("line"), "severity", "title", "rule_id", "decision")


# Rules with literal braces, a group name that only Python's syntax allows, and a glob with a reversed range.
_ODD_RULES = [
    Rule("License"),
    Rule("License{x}|{License}", "P0"),
    Rule(r"\${[A-Z]+}", "P0"),
    Rule("(?P<the_name>License)", "P0"),
    Rule("License", "P1", in_glob="[z-a]*"),
    Rule("L{1}icense{,0}d?", "P3"),
]


@query(
    "odd_rules",
    f"""SELECT run_id, n AS rule_no, count(*) AS hits FROM ({DOC_HITS_SQL}), (VALUES (CAST(1 AS BIGINT))) AS r(n)
        WHERE rule_no = 4 GROUP BY run_id, n
        UNION ALL SELECT source, CAST(4 AS BIGINT), CAST(1 AS BIGINT) FROM documents GROUP BY source
        UNION ALL SELECT source, CAST(6 AS BIGINT), n FROM (
          SELECT run_id AS source, count(*) AS n FROM ({lines_sql('source', DOC_FILE_SQL, 'documents')})
          WHERE contains(t, 'Licens') GROUP BY run_id)""",
)
def odd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that the scan cannot use is a finding of its own; all others work."""
    out = scan.scan_rules(files(spark, sf_dir), _ODD_RULES)
    return out.groupBy("run_id", F.col("seq").alias("rule_no")).agg(F.count(F.lit(1)).alias("hits"))


@query("many_rules", f"SELECT run_id, file, line, CAST(rule_no + 996 AS BIGINT) AS rule_no FROM ({DOC_HITS_SQL})")
def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand rules, most of which match nothing."""
    idle = [Rule(rf"\bnever{k}here\b", "P0") for k in range(996)]
    out = scan.scan_rules(files(spark, sf_dir), idle + RULES)
    return out.select("run_id", "file", long("line"), F.col("seq").alias("rule_no"))


# Rules of which hundreds match: secrets by their first two digits, addresses by their first number, mail by its number.
_FINE_RULES = [(f'token = "{k:02x}', f'token = "{k:02x}[0-9a-f]{{14,}}') for k in range(256)]
_FINE_RULES += [(f"{k}.", rf"\b{k}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\b") for k in range(1, 256)]
_FINE_RULES += [(f".{k}@", rf"[a-z]+\.{k}@[a-z0-9.-]+") for k in range(100)]
_FINE_RULES += [(f"never{k}here", rf"\bnever{k}here\b") for k in range(389)]
_FINE_SQL = r"""
    SELECT *, CAST('0x' || unnest(list_distinct(regexp_extract_all(t, 'token = "([0-9a-f]{2})[0-9a-f]{14}', 1))) AS BIGINT) + 1 AS rule_no FROM l
    UNION ALL SELECT * FROM (SELECT *, 256 + CAST(unnest(list_distinct(regexp_extract_all(t, '\b([1-9][0-9]{0,2})\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', 1))) AS BIGINT) AS rule_no FROM l) WHERE rule_no < 512
    UNION ALL SELECT *, 512 + CAST(unnest(list_distinct(regexp_extract_all(t, '[a-z]\.(0|[1-9][0-9]?)@[a-z0-9.-]', 1))) AS BIGINT) AS rule_no FROM l"""


@query(
    "many_matching_rules",
    f"""WITH l AS ({lines_sql("source", DOC_FILE_SQL, "documents")}) SELECT run_id, file, CAST(line AS BIGINT) AS line, rule_no FROM ({_FINE_SQL})""",
)
def many_matching_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand rules with texts of their own, found through their index."""
    out = scan.scan_rules(files(spark, sf_dir), [Rule(p, "P1") for _, p in _FINE_RULES])
    return out.select("run_id", "file", long("line"), F.col("seq").alias("rule_no"))


_COUNTS_SQL = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in SEVERITIES)


@query("severity_counts", f"SELECT run_id, {_COUNTS_SQL} FROM ({DOC_HITS_SQL}) GROUP BY run_id")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.severity_counts(doc_findings(spark, sf_dir))


_ZERO_COUNTS_SQL = ", ".join(f"coalesce({s.lower()}, 0) AS {s.lower()}" for s in SEVERITIES)


@query(
    "gate_verdict",
    f"""SELECT run_id, {_ZERO_COUNTS_SQL}, coalesce(ask_count, 0) AS ask_count,
          coalesce(blocking, false) AS blocking, CASE WHEN blocking THEN 'blocked' ELSE 'passed' END AS verdict
        FROM (SELECT DISTINCT source AS run_id FROM documents)
        LEFT JOIN (SELECT run_id, {_COUNTS_SQL}, count(*) FILTER (decision = 'ask') AS ask_count,
                     bool_or(severity IN ('P0','P1') AND decision = 'deny') AS blocking
                   FROM ({DOC_HITS_SQL}) GROUP BY run_id) USING (run_id)""",
)
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").select(F.col("source").alias("run_id"))
    return gates.run_verdicts(runs, doc_findings(spark, sf_dir), "P1")


@query(
    "labelled_verdict",
    f"""SELECT run_id, bool_or(blocking) AS blocking, count(*) FILTER (d = 'ask') AS ask_count FROM (
          SELECT h.run_id, d, severity IN ('P0','P1','P2') AND coalesce(d, 'deny') = 'deny' AS blocking FROM ({DOC_HITS_SQL}) h
          LEFT JOIN (SELECT {DOC_FILE_SQL.replace('doc_id', 'documents.doc_id')} AS file,
              CASE WHEN toxic = 1 THEN 'deny' WHEN quality = 1 THEN 'allow' ELSE 'ask' END AS d
            FROM labels JOIN documents USING (doc_id)) USING (file)) GROUP BY run_id""",
)
def labelled_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision of a finding from its document's labels; null blocks by severity."""
    decided = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("doc"),
        F.when(F.col("toxic") == 1, "deny").when(F.col("quality") == 1, "allow").otherwise("ask").alias("d"),
    )
    found = doc_findings(spark, sf_dir).withColumn("doc", F.regexp_extract("file", r"/([0-9]+)", 1))
    found = found.join(decided, "doc", "left")
    return found.groupBy("run_id").agg(
        F.bool_or(S.is_blocking(F.col("severity"), F.col("d"), "P2")).alias("blocking"),
        F.count_if(F.col("d") == "ask").alias("ask_count"),
    )


@query(
    "blocking_matrix",
    f"""SELECT run_id, gate, CAST(CASE gate WHEN 'NONE' THEN 0 WHEN 'P0' THEN p0 WHEN 'P2' THEN p0 + p1 + p2
          ELSE p0 + p1 END AS BIGINT) AS blocking
        FROM (SELECT run_id, {_COUNTS_SQL} FROM ({DOC_HITS_SQL}) GROUP BY run_id),
             (VALUES ('NONE'), ('P0'), ('P1'), ('P2'), ('P3')) AS g(gate)""",
)
def blocking_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.blocking_matrix(doc_findings(spark, sf_dir), ["NONE", "P0", "P1", "P2", "P3"])


@query(
    "threshold_counts",
    f"""SELECT run_id, count(*) FILTER (severity = 'P0') AS at_p0, count(*) FILTER (severity IN ('P0','P1')) AS at_p1,
          count(*) FILTER (severity IN ('P0','P1','P2')) AS at_p2, count(*) AS at_p3, CAST(0 AS BIGINT) AS at_never
        FROM ({DOC_HITS_SQL}) GROUP BY run_id""",
)
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that block at each local threshold."""
    severity = F.col("severity")
    return doc_findings(spark, sf_dir).groupBy("run_id").agg(
        *[F.count_if(S.blocks(severity, t)).alias(f"at_{t.lower()}") for t in (*SEVERITIES, "never")]
    )


@query(
    "gate_severity_grouping",
    f"""SELECT run_id, severity, gate_id, CAST(grouping(severity) AS BIGINT) AS by_gate, count(*) AS n
        FROM (SELECT run_id, severity, 'policy' AS gate_id FROM ({DOC_HITS_SQL})
              UNION ALL SELECT run_id, severity, 'policy' FROM ({CHAT_HITS_SQL})
              UNION ALL SELECT run_id, severity, 'security' FROM ({report_rows_sql('semgrep')}))
        GROUP BY GROUPING SETS ((run_id, severity), (run_id, gate_id))""",
)
def gate_severity_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gates.combine(
        doc_findings(spark, sf_dir),
        chat_findings(spark, sf_dir),
        normalize_tool(reports(spark, sf_dir, "semgrep"), "semgrep"),
    )
    return gates.grouped_counts(found).withColumn("by_gate", F.col("by_gate").cast("long"))


_RANK_SQL = "CASE severity WHEN 'P0' THEN 0 WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 ELSE 3 END"


@query(
    "top_findings",
    f"""SELECT run_id, rank, severity, file, line, rule_id FROM (
          SELECT run_id, severity, file, line, 'policy:forbid-pattern:' || rule_no AS rule_id,
            row_number() OVER (PARTITION BY run_id ORDER BY {_RANK_SQL}, file, line, rule_no) AS rank
          FROM ({DOC_HITS_SQL})) WHERE rank <= 10""",
)
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = gates.top_findings(doc_findings(spark, sf_dir))
    return top.select("run_id", long("rank"), "severity", "file", long("line"), "rule_id")


@query(
    "omitted_findings",
    f"""SELECT run_id, count(*) AS n, greatest(count(*) - 10, 0) AS omitted FROM ({DOC_HITS_SQL}) GROUP BY run_id""",
)
def omitted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.omitted_counts(doc_findings(spark, sf_dir))


@query(
    "report_rows",
    f"""SELECT run_id, rank, severity, file || ':' || line AS locator,
          'https://github.com/acme/' || run_id || '/blob/HEAD/' || file || '#L' || line AS link, title,
          'forbid-patterns' AS category FROM (
          SELECT run_id, severity, file, line, title,
            row_number() OVER (PARTITION BY run_id ORDER BY {_RANK_SQL}, file, line, rule_no) AS rank
          FROM ({DOC_HITS_SQL})) WHERE rank <= 10""",
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = gates.top_findings(doc_findings(spark, sf_dir))
    rows = gates.report_rows(top, F.concat(F.lit("acme/"), F.col("run_id")), F.lit(""))
    return rows.select("run_id", long("rank"), "severity", "locator", "link", "title", "category")


def _fingerprinted(findings: DataFrame) -> DataFrame:
    """Findings with the fingerprint of their text, so that copies of a line in one run are one."""
    return findings.withColumn(
        "fingerprint",
        gates.fingerprint(F.lit(None), F.col("severity"), F.col("tool"), F.lit("repo"), F.lit(0), F.col("evidence")),
    )


@query(
    "merge_dedup",
    f"""SELECT run_id, fingerprint, feed_rank, file, line FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id, fingerprint ORDER BY feed_rank, rule_no, file, line) AS n FROM (
            SELECT 'all' AS run_id, severity || '|forbid-patterns|repo|0|' || {EVIDENCE_SQL} AS fingerprint,
              CAST(0 AS BIGINT) AS feed_rank, rule_no, file, line FROM ({CHAT_HITS_SQL})
            UNION ALL
            SELECT 'all', severity || '|forbid-patterns|repo|0|' || {EVIDENCE_SQL}, CAST(1 AS BIGINT), rule_no, file, line
            FROM ({DOC_HITS_SQL}))) WHERE n = 1""",
)
def merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat findings as the backend feed, document findings as the local feed of one run."""
    one = F.lit("all")
    backend = _fingerprinted(chat_findings(spark, sf_dir).withColumn("run_id", one))
    local = _fingerprinted(doc_findings(spark, sf_dir).withColumn("run_id", one))
    return gates.merge_feeds(backend, local).select("run_id", "fingerprint", long("feed_rank"), "file", long("line"))


@query(
    "backend_or_local",
    f"""WITH b AS (SELECT run_id, file, line, rule_no, severity FROM ({DOC_HITS_SQL}) WHERE severity IN ('P0', 'P1'))
        SELECT run_id, 'backend' AS feed, count(*) AS n FROM b GROUP BY run_id
        UNION ALL
        SELECT run_id, 'local', count(*) FROM (
          SELECT source AS run_id FROM documents UNION ALL SELECT role FROM conversations)
        WHERE run_id NOT IN (SELECT run_id FROM b) GROUP BY run_id""",
)
def backend_or_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocking findings of a run as its backend feed; every file of a run as its local feed."""
    backend = doc_findings(spark, sf_dir).filter(S.blocks(F.col("severity"), "P1")).select(
        "run_id", F.lit("backend").alias("feed")
    )
    every = files(spark, sf_dir).select("run_id").unionByName(chats(spark, sf_dir).select("run_id"))
    out = gates.backend_or_local(backend, every.select("run_id", F.lit("local").alias("feed")))
    return out.groupBy("run_id", "feed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "result_lines",
    f"""SELECT run_id, 'Result: ' || CASE WHEN p0 + p1 > 0 THEN 'Blocked' ELSE 'Passed' END || ' (severity_gate=P1): ' ||
          CASE WHEN p0 + p1 > 0 THEN (p0 + p1) || ' blocking finding(s)' ELSE 'no P0/P1 findings' END ||
          '. Counts: P0=' || p0 || ', P1=' || p1 || ', P2=' || p2 || ', P3=' || p3 AS result
        FROM (SELECT run_id, {_COUNTS_SQL} FROM ({DOC_HITS_SQL}) GROUP BY run_id)""",
)
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = gates.severity_counts(doc_findings(spark, sf_dir))
    cols = {s: F.col(s.lower()) for s in SEVERITIES}
    status = S.verdict(S.blocking_total("P1", cols), F.lit(False), F.lit(""))
    return counts.select("run_id", S.result_line(status, F.lit("P1"), cols).alias("result"))
