import hashlib
import json
import urllib.parse

import pytest
from pyspark.sql import functions as F

from siftwork.functions import numbers as N, paths as P, severity as S, text as X, variants as V
from siftwork.operators import events, gates, outage, policy, profile
from tests.conftest import rows

SPACED = ["", " ", "a", " a  b\tc \r\n\n d ", "x" * 400, "y " * 200, "\u00a0a\u2003b\u3000", "\x1ca\x1fb\x85", "caf\u00e9 \u0442", "a\r\rb\r\n c \t\n\n"]


def col(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_text_equals_python(spark):
    def shorten(v):
        c = " ".join(v.split())
        return c if len(c) <= 320 else c[:317].rstrip() + "..."

    def normal(v):
        return "\n".join(line.rstrip() for line in v.replace("\r\n", "\n").replace("\r", "\n").split("\n")).strip()

    assert col(spark, SPACED, X.strip) == [v.strip() for v in SPACED]
    assert col(spark, SPACED, X.shorten) == [shorten(v) for v in SPACED]
    assert col(spark, SPACED, X.normal_form) == [normal(v) for v in SPACED]
    lines = ["a\nb", "a\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029k", "a\n\nb\n\n", "x\r"]
    assert col(spark, lines, X.line_array) == [v.splitlines() for v in lines]
    assert col(spark, [json.dumps(v, ensure_ascii=False) for v in SPACED] + ['"\U0001f600"'], X.ascii_json) == [json.dumps(v) for v in SPACED] + ['"\\ud83d\\ude00"']
    assert col(spark, SPACED + ["a/b*~ +%"], X.url_quote) == [urllib.parse.quote(v, safe="/") for v in SPACED + ["a/b*~ +%"]]


def test_slugs(spark):
    assert col(spark, [" run/1: x ", "..", "-a-", "\u00e9" * 3 + "b", "a" * 200], X.file_slug) == ["run-1-x", "manual-trigger", "a", "b", "a" * 160]
    assert col(spark, ["Rule:X_y!", "a" * 70], X.branch_slug) == ["rule-x-y", "a" * 60]
    assert col(spark, ["a  b!!", "--x--", ""], X.artifact_suffix) == ["a-b", "x", ""]
    assert col(spark, [" a, ,b ", "", None], X.csv_items) == [["a", "b"], [], []]
    assert col(spark, ["s f", ""], lambda v: X.artifact_name(F.lit(7), F.lit(1), v)) == ["findings-7-1-s-f", "findings-7-1"]


def test_run_id(spark):
    payload = {"command": "/x \u00e9", "commit_sha": "abc", "pr_number": 7, "repository_full_name": "o/r", "scan_mode": "deep", "source": "deterministic_only"}
    digest = hashlib.sha256(json.dumps(payload, separators=(",", ":"), sort_keys=True).encode()).hexdigest()[:24]
    made = X.deterministic_run_id(F.lit("o/r"), F.lit("abc"), F.lit(7), F.lit("/x \u00e9"), F.lit("deep"))
    assert spark.range(1).select(made).first()[0] == f"ghlocal_o-r_{digest}"


def test_permalink(spark):
    got = X.permalink(F.lit("o/r"), F.lit(" "), F.lit("/a b/c.ts"), F.lit(4))
    assert spark.range(1).select(got).first()[0] == "https://github.com/o/r/blob/HEAD/a%20b/c.ts#L4"


def test_numbers(spark):
    values = ["1", " 2.5 ", "-3e2", "x", "", None, "nan", "-inf", "1.0f", "0x10", "9" * 30, "+7", ".5", "5."]
    got = col(spark, values, N.lenient_double)
    assert [str(g) for g in got] == ["1.0", "2.5", "-300.0", "None", "None", "None", "nan", "-inf", "None", "None", "1e+30", "7.0", "0.5", "5.0"]
    assert col(spark, values, N.lenient_long) == [1, 2, -300, None, None, None, None, None, None, None, None, 7, 0, 5]
    assert col(spark, values, N.whole_long) == [1, None, None, None, None, None, None, None, None, None, None, 7, None, None]


def test_strict_json(spark):
    good = ['{"a":1}', " [1] ", "null", '"x"', '{"a":{"b":[1,2]}}']
    bad = ['{"a":1},', "{} x", "1 2", "1],[2", '1,"<end of text>"],[2', "", " ", "{", "[1}", '{"a":1}{"b":2}']
    assert [v is not None for v in col(spark, good, lambda c: F.to_json(V.parse(c)))] == [True] * len(good)
    kept = [b for b, v in zip(bad, col(spark, bad, lambda c: F.to_json(V.parse(c)))) if v is not None]
    assert [b for b in kept if "<end of text>" not in b] == []


@pytest.mark.parametrize("raw, reason", [
    ("", "empty"), ("  ", "empty"), ("a\x00b", "null_byte"), *[(f"/tmp/x{c}y", "control_character") for c in "\x01\x07\x0b\x0c\x1f\x7f"],
    *[(f"/tmp/x{c}y", None) for c in "\t\n\r"], *[(f"/tmp/{chr(c)}admin", "bidi_override") for c in (0x202A, 0x202E, 0x2066, 0x2069)],
    ("/tmp/\u30d7\u30ed/r\u00e9seau", None), ("/repo/%252e%252e/etc", "double_encoded_percent"), ("/api/%252fadmin", "double_encoded_percent"),
    ("100%/%252e", "double_encoded_percent"), ("%%32%65", "double_encoded_percent"), ("%2%65", "double_encoded_percent"), ("/repo/My%20Project", None),
    ("/a%25", None), ("\\\\evil\\share", "unc_path"), ("//evil/share", "unc_path"), ("~root/.ssh", "tilde_prefix"), ("/~root", "tilde_prefix"),
    ("~+", "tilde_prefix"), ("$HOME/r", "shell_expansion"), ("${HOME}", "shell_expansion"), ("%USERPROFILE%/r", "shell_expansion"), ("=cmd", "shell_expansion"),
    ("C:", "windows_drive_root"), ("C:/", "windows_drive_root"), ("D:\\", "windows_drive_root"), ("C:/Users/me", None), ("./relative", None), ("../parent", None),
])
def test_hygiene(spark, raw, reason):
    assert col(spark, [raw], P.hygiene_reason) == [reason]


def test_double_encoding_equals_decoding(spark):
    import itertools
    import re

    atoms = ["%", "25", "32", "65", "2", "e", "/", "%41"]
    values = ["".join(p) for n in (3, 4) for p in itertools.product(atoms, repeat=n)]
    want = [urllib.parse.unquote(v) != v and bool(re.search("%[0-9A-Fa-f]{2}", urllib.parse.unquote(v))) for v in values]
    assert col(spark, values, lambda c: c.rlike(P.DOUBLE_ENCODED)) == want


@pytest.mark.parametrize("path, base, ok", [
    ("a/b", "/r", True), ("../x", "/r", False), ("a/../../r/x", "/r", True), ("/r2/x", "/r", False), ("/r/./x", "/r/", True), (".", "/r", True), ("/", "/r", False),
])
def test_inside_base(spark, path, base, ok):
    assert spark.range(1).select(P.inside_base(F.lit(path), F.lit(base))).first()[0] is ok


def test_blocking(spark):
    grid = [(s, t) for s in ("P0", "P1", "P2", "P3", "odd") for t in ("P0", "P1", "P2", "P3", "never", "odd")]
    rank = {"P0": 0, "P1": 1, "P2": 2, "P3": 3}
    df = spark.createDataFrame(grid, "s string, t string")
    for r in df.select("s", "t", S.blocks(F.col("s"), F.col("t")).alias("b"), S.blocks_merge(F.col("s"), F.col("t")).alias("m")).collect():
        assert r.b == (r.t != "never" and rank.get(r.s, 99) <= rank.get(r.t, -1))
        assert r.m == (r.s in {"P0": ("P0",), "P2": ("P0", "P1", "P2")}.get(r.t, ("P0", "P1")))
    counts = {s: F.lit(n) for s, n in zip(S.SEVERITIES, (1, 2, 3, 4))}
    assert [spark.range(1).select(S.blocking_total(g, counts)).first()[0] for g in ("NONE", "P0", "P1", "P2", "P3", "")] == [0, 1, 3, 6, 3, 3]
    line = S.result_line(F.lit("passed"), F.lit("NONE"), counts)
    assert spark.range(1).select(line).first()[0] == "Result: Passed (severity_gate=NONE): severity gate disabled. Counts: P0=1, P1=2, P2=3, P3=4"
    d = spark.createDataFrame([("P0", None), ("P0", "ask"), ("P0", "allow"), ("P0", "deny"), ("P3", None)], "s string, d string")
    assert [r[0] for r in d.select(S.is_blocking(F.col("s"), F.col("d"), "P1")).collect()] == [True, False, False, True, False]


def test_merge_keeps_the_backend_row(spark):
    b = spark.createDataFrame([("r", 1, "f", "b1"), ("r", 2, "f", "b2"), ("r", 3, "g", "b3")], "run_id string, seq long, fingerprint string, title string")
    loc = spark.createDataFrame([("r", 0, "f", "l1"), ("r", 1, "h", "l2"), ("q", 1, "f", "l3")], b.schema)
    once = gates.merge_feeds(b, loc)
    assert rows(once, "run_id", "title") == [("q", "l3"), ("r", "b1"), ("r", "b3"), ("r", "l2")]
    again = gates.merge_feeds(once.drop("feed_rank"), once.drop("feed_rank"))
    assert rows(again, "run_id", "title") == rows(once, "run_id", "title")


def test_locator_and_fingerprint(spark):
    docs = [
        {"scope": {"path": " s.ts ", "line_start": 4}, "file": "x", "severity": "P1", "tool": "t", "message": "m"}, {"file": "f", "line": -2},
        {"path": "p", "line_start": "7", "title": "T"}, {"scope": 5}, {"finding_id": "id", "fingerprint": " ", "scope": {"lineStart": 0, "line": 3}},
        {"finding_id": " id", "fingerprint": ""},
    ]
    df = spark.createDataFrame([("r", i, json.dumps(d)) for i, d in enumerate(docs)], "run_id string, seq long, j string")
    out = gates.loose_findings(df.select("run_id", "seq", V.parse(F.col("j")).alias("raw")))
    fp = gates.fingerprint(*[F.col(c) for c in ("given", "severity", "kind", "file", "line", "title")])
    assert rows(out.select("seq", "file", "line", fp)) == [
        (0, "s.ts", 4, "P1|t|s.ts|4|m"), (1, "f", 0, "||f|0|"), (2, "p", 7, "||p|7|T"), (3, "repo", 0, "||repo|0|"), (4, "repo", 3, "||repo|3|"), (5, "repo", 0, "id"),
    ]


def test_policy(spark):
    doc = {"version": 1, "gates": [
        {"id": "static", "enabled": False}, {"id": "security_scan", "hard": False}, {"id": "llm-judge", "enabled": True, "behavior": "ask", "hard": True},
        {"id": "policy", "behavior": "nonsense", "hard": False, "config": {"forbid_patterns": [{"pattern": "a", "in": "*.ts"}, {"pattern": ""}]}}],
        "policy": {"forbid_patterns": [{"pattern": "zzz"}], "coverage_min": 80}, "severity_gate": {"block_on": ["p0"]}}
    data = [("a", json.dumps(doc)), ("b", "{}"), ("c", '{"version": 9}'), ("d", "[]"), ("e", "{"), ("f", '{"version":"1"}'), ("g", '{"version":null}')]
    read = policy.read_policies(spark.createDataFrame(data, "run_id string, payload string"))
    assert [(r.run_id, r.load_error is None) for r in read.orderBy("run_id").collect()] == [
        ("a", True), ("b", True), ("c", False), ("d", False), ("e", False), ("f", True), ("g", False)]
    g = {r.gate_id: (r.enabled, r.behavior) for r in policy.policy_gates(read.filter("run_id = 'a'")).collect()}
    assert g == {"ownership": (False, "deny"), "locks": (False, "deny"), "static_analysis": (False, "deny"), "security": (True, "allow"),
                 "policy": (False, "deny"), "scoped_tests": (False, "deny"), "llm_judge": (True, "ask")} | {"policy": (False, "deny")}
    assert rows(policy.policy_rules(read), "run_id", "rule_no", "pattern", "severity", "in_glob", "behavior") == [("a", 1, "a", "P2", "*.ts", "deny")]
    assert rows(read.filter("run_id = 'a'"), "coverage_min", "block_on", "soft_warn") == [(80.0, ["P0"], ["P2"])]


def test_outage(spark):
    down = {"severity": "P0", "category": "LLM Failure", "provenance": "system", "scope": {"path": "<system>"},
            "impact": "LLM analysis failed: primary failed and fallback failed; blocking merge per fail-closed policy. HTTP 403 - CONSUMER_SUSPENDED"}
    flat = {"severity": "p0", "category": "LLM Failure", "source": "system", "file_path": "<system>", "message": down["impact"].replace("CONSUMER_SUSPENDED", "429 quota")}
    real = {"severity": "P1", "category": "security", "source": "deterministic", "file_path": "src/app.py", "message": "x"}
    runs = {
        "a": [down], "b": [flat], "c": [down, real], "d": [{**real, "severity": "P0"}], "e": [down, flat], "f": [{**down, "impact": "primary failed 429"}],
        "g": [{**down, "impact": down["impact"].replace("CONSUMER_SUSPENDED", "odd")}], "h": [{"severity": "P3"}],
    }
    df = spark.createDataFrame([(k, json.dumps(x)) for k, v in runs.items() for x in v], "run_id string, j string")
    got = outage.classify_outages(outage.outage_fields(df.select("run_id", V.parse(F.col("j")).alias("raw"))))
    assert rows(got, "run_id", "reason") == [
        ("a", "single_system_llm_provider_outage"), ("b", "single_system_llm_provider_outage"), ("c", "blocking_non_p0_findings_present"),
        ("d", "p0_is_not_system_llm_failure"), ("e", "expected_exactly_one_p0_llm_failure"), ("f", "llm_failure_message_missing_fail_closed_markers"),
        ("g", "llm_failure_not_provider_capacity_class"), ("h", "expected_exactly_one_p0_llm_failure"),
    ]


def test_pr_number(spark):
    cases = [
        ({"pull_request": {"number": 5}}, None, 5), ({"pull_request": {"number": 5}}, 9, 9), ({"issue": {"number": 3, "pull_request": {}}}, None, 3), ({"issue": {"number": 3}}, None, None),
        ({"check_run": {"pull_requests": [{"number": 8}]}}, 0, 8), ({"inputs": {"pr_number": " 12 "}}, None, 12), ({"inputs": {"pr_number": "-1"}}, None, None),
        ({"pull_request": {"number": "5"}}, None, None), ({"pull_request": {"number": 0}}, None, None), ([], None, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(d), o) for i, (d, o, _) in enumerate(cases)], "i long, payload string, override long")
    assert [r.pr_number for r in events.resolve_pr_numbers(df).orderBy("i").collect()] == [w for *_, w in cases]


def test_profile(spark):
    files = spark.createDataFrame(
        [("r", "README.md", "\n\n# My Repo #\ntext"), ("r", "package.json", '{"dependencies":{"next":"1","react":"2"}}'), ("r", "apps/web/x.ts", ""), ("r", "apps/api/Dockerfile", ""),
         ("s", "readme.md", "##"), ("s", "README.txt", "Plain"), ("s", "turbo.json", ""), ("t", "a.c", "")],
        "run_id string, path string, text string",
    )
    assert rows(profile.synopsis(files)) == [
        ("r", "README.md: My Repo #. Architecture: apps workspace. Stack: Node.js, Next.js, React, TypeScript, Docker. Entry points: apps/web, apps/api."),
        ("s", "README.txt: Plain. Architecture: monorepo. Stack: unspecified. Entry points: not inferred."),
        ("t", "README: not found. Architecture: single repository. Stack: unspecified. Entry points: not inferred."),
    ]


def test_spec_discovery_and_manifest(spark):
    tree = [("docs/Spec-b.md", 5, "b \r\n"), ("spec.md", 5, " a"), ("x/node_modules/spec.md", 5, "n"), ("x/Design-n.txt", 5, "\n \n"), ("big-spec.md", 600_000, "x"), ("readme.md", 5, "r"), ("requirements.PY", 1, "p")]
    files = spark.createDataFrame([("r", *t) for t in tree], "run_id string, path string, size long, text string")
    found = profile.discover_specs(files.drop("text"))
    assert rows(found, "rank", "path", "score") == [(1, "spec.md", 0), (2, "docs/Spec-b.md", 30), (3, "x/Design-n.txt", 60)]
    entries = [{"path": p, "content_hash": hashlib.sha256(t.encode()).hexdigest()} for p, t in (("docs/Spec-b.md", "b"), ("spec.md", "a"))]
    want = hashlib.sha256(json.dumps(entries, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    lone = spark.createDataFrame([("empty", 1, "no/such.md")], "run_id string, seq int, path string")
    bare = profile.manifest_hash(lone, files.select("run_id", "path", "text"))
    assert rows(bare, "run_id", "files", "manifest_hash") == [("empty", 0, None)]
    got = profile.manifest_hash(found.select("run_id", F.col("rank").alias("seq"), "path"), files.select("run_id", "path", "text"))
    assert rows(got) == [("r", 2, want)]
