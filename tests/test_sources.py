import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import IsNotNull, IsNull, StringStartsWith

from siftwork.operators import gates, scan
from siftwork.operators.scan import Rule
from siftwork.schemas import FINDING_SCHEMA
from siftwork.sources import findings as source, sinks
from siftwork.sources.files import OPEN_BYTES, _FilteredTreeReader, _TreeReader, scan_files
from siftwork.sources.reports import read_reports
from tests.conftest import rows


def test_source_tree(spark, tmp_path):
    tree = {
        "a.ts": "x\n", ".github/w.yml": "y", "_p/c.ts": "z", "src/.h": "dot", "src/deep/er/f.py": "deep", "node_modules/m.js": "no", "src/.git/config": "no",
        "own/x.py": "no", "crlf.txt": "a\r\nb",
    }
    for name, body in tree.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(body.encode())
    (tmp_path / "bin.dat").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "big.txt").write_text("x" * 1_000_001)
    for i in range(40):
        (tmp_path / f"flat{i}.md").write_text(str(i))
    for parts in (1, 4, 64):
        files = scan_files(spark, str(tmp_path), "run", parts, ("own",))
        got = {r.file: r.text for r in files.filter("skipped IS NULL").collect()}
        want = {k: v for k, v in tree.items() if v != "no"} | {f"flat{i}.md": str(i) for i in range(40)}
        assert got == want
        assert {(r.file, r.skipped, r.text) for r in files.filter("skipped IS NOT NULL").collect()} == {("bin.dat", "not text", None), ("big.txt", "too large", None)}
    found = scan.scan_rules(files, [Rule("x")]).unionByName(scan.skipped_findings(files))
    assert {"big.txt", "bin.dat"} <= {r.file for r in found.filter("decision = 'ask'").collect()}
    assert gates.run_verdicts(files, found).first().ask_count == 2
    assert scan_files(spark, str(tmp_path), "run", max_bytes=1 << 30).filter("skipped IS NOT NULL").count() == 1
    assert scan_files(spark, str(tmp_path), "run").select("run_id").distinct().collect()[0].run_id == "run"


def test_source_tree_by_uri(spark, tmp_path):
    root = tmp_path / "a b"
    for name in ("src/x/1.py", "src/x/2.py", "src/y.py", "srcs/3.py", "docs/4.md", "5.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name * 10)
    (root / "src" / "again").symlink_to(root / "src")
    (root / "src" / "gone.py").symlink_to(root / "nowhere")
    want = {"src/x/1.py", "src/x/2.py", "src/y.py", "srcs/3.py", "docs/4.md", "5.py"}
    # As many files as the driver lists, or the tasks list the rest.
    for listed in (1, 3, 100):
        files = scan_files(spark, root.as_uri(), partitions=3, listed_files=listed)
        got = files.collect()
        assert {(r.file, r.text) for r in got} == {(w, w * 10) for w in want} and len(got) == len(want)
        assert {r.run_id for r in got} == {"a b"}
    assert scan_files(spark, str(tmp_path / "a b")).first().run_id == "a b"


def test_source_tree_reads_only_what_stays(spark, tmp_path):
    for name, n in {"src/a.py": 10, "src/in/b.py": 100, "lib/c.py": 10, "lib/d.md": 1000}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * n)
    files = scan_files(spark, str(tmp_path), max_bytes=500)
    for condition, want in {
        "file LIKE 'src/%'": {"src/a.py", "src/in/b.py"}, "file LIKE '%.py' AND size < 50": {"src/a.py", "lib/c.py"}, "file = 'src/in/b.py'": {"src/in/b.py"},
        "file IN ('lib/d.md', 'src/a.py', 'lib')": {"lib/d.md", "src/a.py"}, "size >= 100 AND skipped IS NULL": {"src/in/b.py"}, "file LIKE '%/in/%'": {"src/in/b.py"},
        "size > 10 AND size <= 1000 AND NOT file LIKE 'src%'": {"lib/d.md"}, "skipped IS NOT NULL": {"lib/d.md"}, "size = 10 OR file = 'lib/d.md'": {"src/a.py", "lib/c.py", "lib/d.md"},
    }.items():
        assert {r.file for r in files.filter(condition).collect()} == want, condition
    reader = _FilteredTreeReader({"path": str(tmp_path), "partitions": "1"})
    assert list(reader.pushFilters([StringStartsWith(("file",), "src/in/"), IsNotNull(("size",)), IsNull(("skipped",))])) == [IsNull(("skipped",))]
    opened = []
    real = reader._folder
    reader._folder = lambda fs, root, below: opened.append(below) or real(fs, root, below)
    assert [p.files for p in reader.partitions()] == [[("src/in/b.py", 100)]]
    assert opened == ["", "src", "src/in"]


def test_source_tree_is_packed_by_bytes(tmp_path):
    for k in range(100):
        (tmp_path / f"f{k:03d}").write_text("x" * (300_000 if k < 10 else 10))
    parts = _TreeReader({"path": str(tmp_path), "partitions": "8"}).partitions()
    cost = [sum(n + OPEN_BYTES for _, n in p.files) for p in parts]
    assert 8 <= len(parts) <= 10 and max(cost) < 1.2 * sum(cost) / 8 and sum(len(p.files) for p in parts) == 100


@pytest.fixture
def findings_file(tmp_path):
    lines = [
        json.dumps({"gateId": "g", "tool": "t", "severity": "P0", "file": "a", "line": "7", "title": "T", "ruleId": "r", "confidence": 0, "decision": "ask"}),
        "", json.dumps({"gate_id": "g2", "recommended_fix": "fix"}), "{broken", "[1]", '{"a":1},',
    ]
    path = tmp_path / "FINDINGS.jsonl"
    path.write_text("\n".join(lines))
    return str(path)


def test_skip_mode(spark, findings_file):
    cols = ("run_id", "gate_id", "severity", "line", "confidence", "rule_id", "recommended_fix", "decision")
    assert rows(source.read_findings(spark, findings_file), *cols) == [
        ("FINDINGS.jsonl", "g", "P0", 7, 0.0, "r", None, "ask"), ("FINDINGS.jsonl", "g2", "P2", 0, 1.0, None, "fix", None),
    ]
    assert rows(source.read_findings(spark, findings_file, parity=True), "confidence", "decision") == [(1.0, None), (1.0, None)]


def test_strict_mode_names_the_line(spark, findings_file):
    with pytest.raises(source.BadFindings, match="line 4 is not JSON"):
        source.read_findings(spark, findings_file, mode="strict")
    assert rows(source.bad_lines(spark, findings_file), "line", "why") == [(4, "not JSON"), (5, "not an object"), (6, "not JSON")]


def test_line_numbers_of_files_in_many_splits(spark, tmp_path):
    rnd = random.Random(3)
    odd = ["{", "[1]", "7", '{"a":1}\x0b{"b":2}', '{"a":1}\x0c[3]\x1d', "", "  ", "\u2028", '{"t":"x\u2028y"}', "\x85{"]
    want, odd_ok = [], {'{"a":1}\x0b{"b":2}': [(0, "not JSON")], '{"a":1}\x0c[3]\x1d': [(1, "not an object")], "\x85{": [(1, "not JSON")], "{": [(0, "not JSON")], "[1]": [(0, "not an object")], "7": [(0, "not an object")]}
    for name in ("a.jsonl", "b.jsonl"):
        lines = [rnd.choice(odd) if rnd.random() < 0.2 else json.dumps({"n": k, "pad": "p" * rnd.randrange(60)}) for k in range(400)]
        (tmp_path / name).write_text("\n".join(lines) + "\n", newline="")
        at = 1
        for text in lines:
            want += [(name, at + k, why) for k, why in odd_ok.get(text, [])]
            at += len((text + ".").splitlines())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = source.bad_lines(spark, str(tmp_path))
        assert source._lines(spark, str(tmp_path)).select("file_name", "split").distinct().count() > 20
        assert rows(got.select(F.substring_index("file_name", "/", -1), "line", "why")) == rows(spark.createDataFrame(want, "f string, l int, w string"))
        assert "wholetext" not in got._jdf.queryExecution().toString().lower()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_judge_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x":1},\n{"x":2}]')
    (tmp_path / "b.json").write_text('{"Findings":[{"x":3}]}')
    (tmp_path / "c.json").write_text('{"findings":')
    got = source.read_judge_json(spark, str(tmp_path)).select("seq", F.try_variant_get("raw", "$.x", "int"))
    assert rows(got) == [(0, 1), (0, 3), (1, 2)]


def test_reports(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "tsc.txt").write_text("a\nb")
    (tmp_path / "run1" / "osv-scanner.json").write_text("{}")
    assert rows(read_reports(spark, str(tmp_path))) == [("run1", "osv-scanner", "{}"), ("run1", "tsc", "a\nb")]


def test_unreadable_file_fails_the_scan(spark, tmp_path):
    (tmp_path / "a.py").symlink_to(tmp_path / "b.py")
    (tmp_path / "b.py").write_text("x")
    assert scan_files(spark, str(tmp_path)).count() == 2
    (tmp_path / "loop").mkdir()
    (tmp_path / "f.py").write_text("x")
    (tmp_path / "f.py").chmod(0)
    if os.access(tmp_path / "f.py", os.R_OK):
        pytest.skip("this user reads everything")
    with pytest.raises(Exception, match="Permission"):
        scan_files(spark, str(tmp_path)).count()


def test_feed_order_survives_files(spark, tmp_path):
    lines = [json.dumps({"gateId": "g", "title": f"t{k}", "file": "f" * (k % 50)}) for k in range(3000)]
    (tmp_path / "feed.jsonl").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        back = source.read_findings(spark, str(tmp_path))
        assert back.rdd.getNumPartitions() > 3
        got = [r.title for r in back.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [f"t{k}" for k in range(3000)]


def test_merged_rows_keep_every_key(spark, tmp_path):
    docs = ['{"title":"T","zeta":{"b":[1,null],"a":""},"impact":"","severity":"P1"}', '{"title":"T","severity":"P1","other":1}', '{"fingerprint":"x","n":1.5}']
    df = spark.createDataFrame([("r", i, d) for i, d in enumerate(docs)], "run_id string, seq long, j string")
    rows_ = gates.loose_findings(df.select("run_id", "seq", F.parse_json("j").alias("raw")))
    fp = gates.fingerprint(*[F.col(c) for c in ("given", "severity", "kind", "file", "line", "title")])
    keyed = rows_.withColumn("fingerprint", fp)
    sinks.write_merged(gates.merge_feeds(keyed, keyed), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").rglob("part-*"))
    assert sorted(text.splitlines()) == ['{"fingerprint":"x","n":1.5}', '{"impact":"","severity":"P1","title":"T","zeta":{"a":"","b":[1,null]}}']


@pytest.mark.parametrize("by_run", [True, False])
def test_round_trip(spark, tmp_path, by_run):
    data = [("r1", 0, "g", "t", "P1", "f", 3, "caf\u00e9 \"q\"", "", None, 0.5, None, "e", "deny"), ("r2", 0, "g", "t", "P3", "f", 0, "T", "d", "id", 1.0, "fix", None, None)]
    df = spark.createDataFrame(data, FINDING_SCHEMA)
    out = str(tmp_path / "out")
    sinks.write_findings(df, out, by_run)
    back = source.read_findings(spark, out + "/*" if by_run else out, mode="strict")
    assert rows(back) == rows(df)
    line = next(p for p in (tmp_path / "out").rglob("*.json") if p.stat().st_size).read_text().splitlines()[0]
    assert {"gateId", "recommendedFix", "decision"} <= set(json.loads(line))


def test_custom_gate(spark):
    df = spark.createDataFrame([("r", "f")], "run_id string, file string")

    def gate(d):
        return d.select("run_id", "file", F.lit("mine").alias("gate_id"), F.lit("t").alias("tool"), F.lit("P1").alias("severity"), F.lit("x").alias("title"))

    assert gates.run_custom_gate(df, gate).schema.names == FINDING_SCHEMA.names
    with pytest.raises(ValueError, match="lacks"):
        gates.run_custom_gate(df, lambda d: d)
    with pytest.raises(ValueError, match="unknown"):
        gates.run_custom_gate(df, lambda d: gate(d).withColumn("z", F.lit(1)))


def test_verdicts_and_summaries(spark):
    base = ("g", "t")
    data = [("a", 0, *base, "P1", "f", 0, "T", "", None, 1.0, None, None, "ask"), ("b", 0, *base, "P1", "f", 0, "T", "", None, 1.0, None, None, None)]
    found = spark.createDataFrame(data, FINDING_SCHEMA)
    runs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "run_id string")
    failed = spark.createDataFrame([("b",), ("d",)], "run_id string")
    got = gates.run_verdicts(runs, found, "P1", failed)
    assert rows(got, "run_id", "p1", "ask_count", "verdict") == [("a", 1, 1, "passed"), ("b", 1, 0, "blocked"), ("c", 0, 0, "passed"), ("d", 0, 0, "error")]
    assert rows(gates.run_verdicts(runs, found, "never"), "verdict") == [("passed",)] * 4
