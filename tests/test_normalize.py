import json

import pytest
from pyspark.sql import functions as F

from siftwork.operators import gates, normalize
from tests.conftest import rows

COLS = ("severity", "file", "line", "title", "rule_id")


def parsed(spark, tool, *payloads, parity=False):
    df = spark.createDataFrame([(str(i), tool, p) for i, p in enumerate(payloads)], "run_id string, tool string, payload string")
    one = rows(normalize.normalize_tool(df, tool, parity), *COLS)
    assert rows(normalize.normalize_reports(df, parity), *COLS) == one
    return one


def test_tsc(spark):
    text = "src/a.ts(12,4): error TS2345: Bad type.\nsrc/b.ts(3,1): warning TS6133: Unused.\n\nFound 2 errors.\nx): error TS1: no place"
    assert parsed(spark, "tsc", text) == [
        ("P1", "src/a.ts", 12, "Bad type.", "tsc:TS2345"),
        ("P2", "src/b.ts", 3, "Unused.", "tsc:TS6133"),
    ]


def test_tsc_path_with_parentheses(spark):
    text = "app/(g)/page.tsx(12,4): error TS1: m"
    assert parsed(spark, "tsc", text) == [("P1", "app/(g)/page.tsx", 12, "m", "tsc:TS1")]
    assert parsed(spark, "tsc", text, parity=True) == []


def test_eslint(spark):
    report = [
        {"filePath": "./a.js", "messages": [
            {"ruleId": "no-eval", "severity": 2, "line": 4, "message": "bad"},
            {"ruleId": None, "severity": 1, "message": "meh"}]},
        "x",
    ]
    assert parsed(spark, "eslint", json.dumps(report), "[]", "{nope", "") == [
        ("P1", "a.js", 4, "bad", "eslint:no-eval"),
        ("P2", "a.js", 0, "meh", "eslint:unknown"),
    ]


def test_prettier(spark):
    text = "Checking formatting...\n[warn] src/a.ts\n[warn] Code style issues found in 1 file.\n[warn]\n"
    assert parsed(spark, "prettier", text, "") == [("P2", "src/a.ts", 0, "Prettier formatting differences", "prettier:unformatted")]


def test_gitleaks(spark):
    recs = [{"Description": "AWS key ", "RuleID": "aws", "File": "a.env", "StartLine": 3}, "s", None, 5, {"File": "b", "StartLine": "x"}]
    assert parsed(spark, "gitleaks", json.dumps(recs), "", "[]", "[{]", "{}") == [
        ("P0", "a.env", 3, "AWS key", "gitleaks:aws"),
        ("P0", "b", 0, "Potential secret", "gitleaks:unknown"),
    ]


def test_semgrep(spark):
    def item(level):
        return {"check_id": f"r.{level}", "path": "p.py", "start": {"line": 2}, "extra": {"severity": level, "message": f"m {level}"}}

    doc = {"results": [item("ERROR"), item("WARNING"), item("INFO"), item("odd"), {"check_id": "bare", "start": 4, "extra": 5}]}
    assert parsed(spark, "semgrep", json.dumps(doc), "{}", "") == [
        ("P1", "p.py", 2, "m ERROR", "semgrep:r.ERROR"),
        ("P2", "", 0, "bare", "semgrep:bare"),
        ("P2", "p.py", 2, "m WARNING", "semgrep:r.WARNING"),
        ("P2", "p.py", 2, "m odd", "semgrep:r.odd"),
        ("P3", "p.py", 2, "m INFO", "semgrep:r.INFO"),
    ]


@pytest.mark.parametrize(
    "severity, band",
    [
        ([{"score": "9.8"}], "P0"), ([{"score": "7.5"}], "P1"), ([{"score": "5.0"}], "P2"), ([{"score": "2.0"}], "P3"),
        ([{"score": "CVSS:3.1/AV:N/AC:L / 9.8"}], "P0"), ([{"score": "2"}, {"score": 8.1}], "P1"), ([], "P2"), (None, "P2"),
        ([{"score": "garbage"}], "P2"), ([{"score": "CVSS:3.1/AV:N"}], "P2"), ([{"score": "42"}], "P0"), ([{"score": "1/nan"}], "P3"),
        (["9.9", 3], "P2"), ([{"score": "0"}], "P2"), ([{"score": "9.8d"}], "P2"),
    ],
)
def test_osv(spark, severity, band):
    doc = {"results": [{"source": {"path": "lock"}, "packages": [{"package": {"name": "p"}, "vulnerabilities": [
        {"id": "V1", "summary": "s", "severity": severity}]}]}]}
    assert parsed(spark, "osv-scanner", json.dumps(doc)) == [(band, "lock", 0, "p: s", "osv:V1")]


def test_actionlint(spark):
    text = (
        ".github/w.yml:12:3: bad expression [expression]\nw.yml:x:3: no number [a]\nw.yml:5\n"
        "w.yml:7:1: plain text\nw.yml:8:1: tag [a] then []\n"
    )
    assert parsed(spark, "actionlint", text) == [
        ("P2", ".github/w.yml", 12, "bad expression", "actionlint:expression"),
        ("P2", "w.yml", 7, "plain text", "actionlint:unknown"),
        ("P2", "w.yml", 8, "tag [a] then", "actionlint:unknown"),
    ]


def test_checkov(spark):
    def check(**kw):
        return {"check_id": "C1", "check_name": "name", "file_path": "/main.tf", "file_line_range": [3, 9], **kw}

    one = {"results": {"failed_checks": [check(severity="CRITICAL"), check(severity=None, file_line_range=["3"]), "x"]}}
    many = [{"results": {"failed_checks": [check(severity="low", file_line_range=[2.5])]}}, 7, {"results": []}]
    assert parsed(spark, "checkov", json.dumps(one), json.dumps(many), "") == [
        ("P0", "main.tf", 3, "name", "checkov:C1"),
        ("P2", "main.tf", 0, "name", "checkov:C1"),
        ("P3", "main.tf", 0, "name", "checkov:C1"),
    ]


def test_tflint(spark):
    def issue(level):
        return {"rule": {"name": "r", "severity": level}, "message": "m", "range": {"filename": "a.tf", "start": {"line": 6}}}

    doc = {"issues": [issue("error"), issue("Warning"), issue("notice"), issue(""), {"message": "only"}]}
    assert parsed(spark, "tflint", json.dumps(doc), '{"issues":[]}', "") == [
        ("P1", "a.tf", 6, "m", "tflint:r"),
        ("P2", "", 0, "only", "tflint:unknown"),
        ("P2", "a.tf", 6, "m", "tflint:r"),
        ("P2", "a.tf", 6, "m", "tflint:r"),
        ("P3", "a.tf", 6, "m", "tflint:r"),
    ]


def test_unreadable_reports_are_errors_and_isolated(spark):
    df = spark.createDataFrame(
        [("r", "eslint", "{bad"), ("r", "gitleaks", "[]"), ("r", "tsc", "a.ts(1,1): error TS1: m"), ("q", "semgrep", '{"results":[]} x'), ("q", "tsc", "")],
        "run_id string, tool string, payload string",
    )
    found = normalize.normalize_reports(df)
    assert rows(gates.gate_results(df, found)) == [
        ("q", "security", "error", 0, "unreadable report: semgrep"),
        ("q", "static", "ok", 0, None),
        ("r", "security", "ok", 0, None),
        ("r", "static", "error", 1, "unreadable report: eslint"),
    ]


def test_outcomes_of_one_parse(spark):
    issue = {"rule": {"name": "r", "severity": "error"}, "message": "m"}
    df = spark.createDataFrame(
        [("r", "eslint", "{}"), ("r", "eslint", " "), ("r", "gitleaks", None), ("r", "tsc", "a.ts(1,1): error TS1: m\nx"), ("q", "semgrep", '{"results":[]} x'),
         ("q", "tflint", json.dumps({"issues": [issue, issue, 5]})), ("q", "tflint", "null"), ("q", "other", "{"), ("q", None, "{"), ("p", "checkov", "")],
        "run_id string, tool string, payload string",
    )
    found = normalize.normalize_reports(df)
    assert rows(gates.gate_results(df)) == rows(gates.gate_results(df, found))
    switches = spark.createDataFrame([(r, t, t != "tsc") for r in "pqr" for t in normalize.TOOLS], "run_id string, tool string, enabled boolean")
    assert rows(gates.tool_meta(df, None, switches)) == rows(gates.tool_meta(df, found, switches))
    got = {(r.run_id, r.tool): (r.reason, r.finding_count) for r in gates.tool_meta(df, None, switches).collect()}
    assert got["q", "tflint"] == (None, 2) and got["q", "semgrep"] == ("parse-error", 0) and got["r", "tsc"] == ("disabled", 0) and got["p", "tsc"] == ("disabled", 0) and got["p", "osv-scanner"] == ("no-report", 0)
    plan = gates.gate_results(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson(") == 1, plan[:4000]


def test_sandbox_log(spark):
    log = "ok\nsh: /etc/x: Operation not permitted\ncat: Permission denied: '/root/.ssh'\nconnect: Network is unreachable"
    df = spark.createDataFrame([("r", log), ("r", "")], "run_id string, payload string")
    assert rows(normalize.sandbox_violations(df), "line", "kind", "target") == [
        (2, "fs_write", "Operation not permitted"),
        (3, "fs_read", "/root/.ssh"),
        (4, "network", "Network is unreachable"),
    ]
    mac = spark.createDataFrame([("r", "sandbox: deny file-write /tmp/x")], "run_id string, payload string")
    assert rows(normalize.sandbox_violations(mac, "macos"), "kind") == [("fs_write",)]


def test_reports_of_one_row_group_are_dealt_over_all_tasks(spark, tmp_path):
    from siftwork.workloads import inputs

    made = spark.range(400).selectExpr("id AS event_id", "id % 7 AS user_id", "'error' AS event_type", "1.5D AS value", "timestamp'2024-01-01' AS ts", "'{\"k\":3}' AS props")
    made.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    out = inputs.reports(spark, str(tmp_path), "tsc", "eslint")
    parts = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in parts) == 800
    assert out.select("event_id", "tool").distinct().count() == 800
