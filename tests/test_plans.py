"""Physical plans keep the shapes that matter on large data."""

import pytest

from siftwork.operators import gates, scan
from siftwork.workloads import inputs, load, scan_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()
WRITES = {"findings_written", "findings_committed", "lenient_read", "merged_written", "run_summaries", "run_summary_blocks", "feed_order", "reports_read", "tree_scan", "judge_files"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WRITES and not n.startswith("stream_")])
def test_no_pairing_and_no_row_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas", "Window [collect", "RoundRobinPartitioning"):
        assert bad not in text, bad
    if name not in ("rule_lint", "run_rule_scan"):
        assert "ArrowEvalPython" not in text


def test_scan_is_one_narrow_pass(spark):
    text = plan(scan.scan_rules(inputs.files(spark, SF), inputs.RULES))
    assert text.count("FileScan") == 1 and "Join" not in text and "hashpartitioning" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in text


def test_top_limit_is_applied_before_the_shuffle(spark):
    text = plan(gates.top_findings(scan_queries.doc_findings(spark, SF)))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["spec_rank", "merge_dedup", "fix_admission", "fix_match", "route_personas", "clean_paths"])
def test_keep_first_is_applied_before_the_shuffle(spark, name):
    assert plan(QUERIES[name](spark, SF)).count("WindowGroupLimit") >= 2


def test_counts_combine_before_the_shuffle(spark):
    assert plan(QUERIES["severity_counts"](spark, SF)).count("HashAggregate") == 2


def test_no_broadcast_hint_in_the_library():
    from pathlib import Path

    root = Path(scan.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        body = path.read_text()
        assert "broadcast(" not in body and "localCheckpoint" not in body and "toPandas" not in body, path


def test_plan_size_does_not_grow_with_rules(spark):
    few, many = ([scan.Rule(rf"\bw{k}\b") for k in range(n)] for n in (2, 300))
    lines = [plan(scan.scan_rules(inputs.files(spark, SF), r)).count("\n") for r in (few, many)]
    assert lines[0] == lines[1]
