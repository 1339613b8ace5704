"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores. The given tables are single files of one row group, which Spark
reads in one task each; so the tables that the queries read are first laid out as several files in a folder of the run's
own, as larger tables are. Each query runs once to warm up and once timed, over whole tables, with every result row
produced and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from siftwork.plans.session import local_session  # noqa: E402
from siftwork.workloads import load  # noqa: E402

HEADLINE = (
    "scan_findings glob_scope run_rule_scan severity_counts gate_verdict blocking_matrix top_findings merge_dedup "
    "route_personas norm_eslint norm_semgrep norm_osv norm_checkov norm_all judge_filter rejection_counts phrase_hits "
    "quota_timeline quota_latest call_admission fix_admission fix_plan outage_class content_manifest path_hygiene "
    "policy_gates rule_lint stream_counts stream_quota"
).split()


def laid_out(spark, sf_dir: str, files: int) -> str:
    """The tables of a folder, each as so many files."""
    to = tempfile.mkdtemp(prefix="bench-")
    for path in Path(sf_dir).glob("*.parquet"):
        spark.read.parquet(str(path)).repartition(files).write.parquet(f"{to}/{path.name}")
    return to


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    queries, _ = load()
    spark = local_session(cores, "bench")
    tables = laid_out(spark, sf_dir, int(cores))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split() if n] or HEADLINE
    times = {}
    for name in names:
        for _ in range(2):  # the second run counts
            start = time.perf_counter()
            queries[name](spark, tables).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    line = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": Path(sf_dir).name}
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
