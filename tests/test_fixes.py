import random

import pytest

from siftwork.operators import fixes, routing
from siftwork.schemas import FINDING_SCHEMA
from tests.conftest import rows


def commands(spark, *bodies, handle="/gate"):
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(bodies)], "build_id string, seq long, body string")
    return [tuple(r) for r in fixes.parse_commands(df, handle).orderBy("seq").select("finding_id", "persona_override", "reason").collect()]


def test_parse(spark):
    got = commands(
        spark, "Please /gate fix crypto.md5", "/gate fix finding-42 --persona Security", "/gate fix f:a/b-1:3 --persona backend --reason needs retry budget \nmore",
        "ship it", "Please fix this", "/gate fix", "x/gate fix a", "/gate fix f-1 --persona not-a-real-persona", "/gate fix a --reason r --persona backend", None,
    )
    assert got == [
        ("crypto.md5", None, None), ("finding-42", "security", None), ("f:a/b-1:3", "backend", "needs retry budget"), ("f-1", None, None),
        ("a", None, "r --persona backend"),
    ]
    assert commands(spark, "/bot fix a", "/gate fix a", handle="/bot") == [("a", None, None)]


def replay(requests, limit, prior=()):
    seen, out = {}, []
    for b, f in prior:
        seen.setdefault(b, set()).add(f)
    for build, seq, fid in sorted(requests, key=lambda r: r[1]):
        done = seen.setdefault(build, set())
        if fid in done:
            out.append((build, seq, False, True, False))
        elif len(done) >= limit:
            out.append((build, seq, False, False, True))
        else:
            done.add(fid)
            out.append((build, seq, True, False, False))
    return sorted(out)


@pytest.mark.parametrize("prior", [(), (("a", "f1"), ("a", "f9"), ("b", "x"), ("b", "y"), ("b", "z"))])
@pytest.mark.parametrize("limit", [1, 3])
def test_admission_equals_a_replay(spark, limit, prior):
    rnd = random.Random(limit)
    req = [(rnd.choice("aaab"), i, f"f{rnd.randrange(6)}") for i in range(120)]
    df = spark.createDataFrame(req, "build_id string, seq long, finding_id string").repartition(6)
    old = spark.createDataFrame(list(prior), "build_id string, finding_id string") if prior else None
    got = fixes.admit_fixes(df, limit, old).select("build_id", "seq", "accepted", "already_attempted", "rate_limited")
    assert sorted(map(tuple, got.collect())) == replay(req, limit, prior)


def finding(**kw):
    base = {"run_id": "b", "seq": 0, "gate_id": "static", "tool": "eslint", "severity": "P1", "file": "src/a.ts", "line": 3, "title": "T", "description": "",
            "rule_id": None, "confidence": 1.0, "recommended_fix": None, "evidence": None, "decision": None}
    return tuple({**base, **kw}[f.name] for f in FINDING_SCHEMA)


def test_match_and_plan(spark):
    found = spark.createDataFrame(
        [finding(seq=5, rule_id="r1", title="late"), finding(seq=2, rule_id="r1", title="first", description="D", evidence="E"),
         finding(seq=9, title="composite"), finding(seq=1, tool="Security", file="x\\y", line=1, title="by tool"),
         finding(seq=7, rule_id="static:src-a.ts:3", title="rule id wins"), finding(seq=8, file="none.ts", line=4)],
        FINDING_SCHEMA,
    ).withColumnRenamed("run_id", "build_id")
    asks = spark.createDataFrame(
        [("b", 1, "r1", "frontend", True), ("b", 2, "static:src-a.ts:3", None, True), ("b", 3, "static:x\\y:1", None, True),
         ("b", 4, "nope", None, True), ("b", 5, "static:none.ts:4", None, True), ("b", 6, "r1", None, False)],
        "build_id string, seq long, finding_id string, persona_override string, accepted boolean",
    )
    owners = spark.createDataFrame([("b", "src/a.ts", " Backend")], "build_id string, file string, persona string")
    matched = fixes.match_findings(asks, found)
    assert rows(matched, "seq", "title") == [(1, "first"), (2, "rule id wins"), (3, "by tool"), (4, None), (5, "T"), (6, "first")]
    plan = {r.seq: r for r in fixes.plan_fixes(matched, owners, branch_prefix="fix").collect()}
    assert [plan[i].status for i in range(1, 7)] == ["planned", "planned", "planned", "not_found", "no_owner", "rejected"]
    assert [plan[i].persona for i in (1, 2, 3)] == ["frontend", "backend", "security"]
    assert plan[1].branch_name == "fix/frontend/r1" and plan[3].branch_name == "fix/security/static-x-y-1"
    assert plan[3].files == ["x/y"] and plan[5].files is None and plan[1].token_budget_usd == 2.0
    assert plan[1].prompt_context == "FINDING: first\nFILE: src/a.ts:3\nSEVERITY: P1\nGATE: static / eslint\nDESCRIPTION: D\nEVIDENCE: E"


def test_ownership_and_routing(spark):
    rules = spark.createDataFrame(
        [("r", 1, "'./a.ts'", "backend"), ("r", 2, '"a.ts"', "security"), ("r", 3, "src/**/*.ts", "x"), ("r", 4, ".github/w.yml", "release"), ("r", 5, "b[1].ts", "x"), ("r", 6, "c.ts", "''")],
        "repo string, seq long, pattern string, persona string",
    )
    assert rows(routing.read_ownership(rules)) == [("r", ".github/w.yml", "release"), ("r", "a.ts", "security")]
    assert rows(routing.read_ownership(rules, parity=True)) == [("r", "a.ts", "security"), ("r", "github/w.yml", "release")]
    found = spark.createDataFrame(
        [finding(file=f, severity=s) for f, s in [("src\\a.ts", "P0"), ("src/a.ts", "P1"), ("b.ts", "P1"), ("c.ts", "P2"), ("d.ts", "P0"), (" ", "P0"), ("e.ts", "P1")]],
        FINDING_SCHEMA,
    )
    owners = spark.createDataFrame([("b", "src/a.ts", "Backend"), ("b", "e.ts", "backend"), ("b", "d.ts", "nobody")], "run_id string, file string, persona string")
    routes = routing.route(found, owners)
    assert rows(routing.persona_buckets(routes)) == [("b", "backend", ["e.ts", "src/a.ts"])]
    assert rows(routing.persona_buckets(routes, 1)) == [("b", "backend", ["e.ts"])]
    assert rows(routing.unrouted_files(routes), "file") == [("b.ts",), ("d.ts",)]
    assert rows(routing.dispatch_summary(routes)) == [("b", ["backend"], 2, 0, 0)]
    assert rows(routing.remaining_files(routes, 1)) == [("b", "backend", "src/a.ts")]
    lost = spark.createDataFrame([("b", "backend")], "run_id string, persona string")
    assert rows(routing.dispatch_summary(routes, found, lost, 1), "unrouted", "remaining", "failed_personas", "persona_findings") == [(2, 1, ["backend"], 7)]
