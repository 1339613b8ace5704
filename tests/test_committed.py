import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwork.operators import gates
from siftwork.schemas import FINDING_SCHEMA
from siftwork.sources import findings as source, sinks
from siftwork.sources.committed import MANIFEST, LinesWriter, NotCommitted, committed_files, read_committed, remove_uncommitted, write_committed
from tests.conftest import rows


def lines(spark, values, runs=("a", "b/c", None)):
    return spark.createDataFrame([(runs[k % len(runs)], v) for k, v in enumerate(values)], "run_id string, value string")


def values(spark, path):
    return sorted(r.value for r in read_committed(spark, path).collect())


def files_of(path):
    return {str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and p.name != MANIFEST and not p.name.startswith(".")}


def test_append_and_overwrite(spark, tmp_path):
    out = tmp_path / "out"
    with pytest.raises(NotCommitted):
        committed_files(str(out))
    write_committed(lines(spark, ["1", "é", "3", ""]), str(out))
    assert values(spark, str(out)) == ["", "1", "3", "é"]
    assert {p.name for p in out.iterdir()} == {MANIFEST, "run_id=a", "run_id=b%2Fc", "run_id=__HIVE_DEFAULT_PARTITION__"}
    write_committed(lines(spark, ["4"]).select("value"), str(out), "append")
    write_committed(lines(spark, []), str(out), "append")
    assert values(spark, str(out)) == ["", "1", "3", "4", "é"]
    write_committed(lines(spark, ["5"], ["r" * 3000]), out.as_uri())
    assert values(spark, str(out)) == values(spark, out.as_uri()) == ["5"] and len(files_of(out)) == 1
    write_committed(lines(spark, []), str(out))
    assert values(spark, str(out)) == [] and len(committed_files(str(out))) == 1
    with pytest.raises(Exception, match="run_id and value"):
        write_committed(lines(spark, ["1"]).withColumn("x", F.lit(1)), str(out))


def test_a_task_that_fails_half_way_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    write_committed(lines(spark, ["old"]), str(out))
    before = files_of(out)
    bad = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3500, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("value"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            write_committed(bad, str(out), mode)
        assert values(spark, str(out)) == ["old"]
    fresh = tmp_path / "fresh"
    with pytest.raises(Exception, match="broken"):
        write_committed(bad, str(fresh))
    with pytest.raises(NotCommitted):
        committed_files(str(fresh))
    # What tasks that were ended left is in no manifest, and can be told from what is.
    for path in (out, fresh):
        remove_uncommitted(str(path))
    assert files_of(out) == before and files_of(fresh) == set() and remove_uncommitted(str(tmp_path / "none")) == 0
    assert values(spark, str(out)) == ["old"]


def test_attempts(tmp_path):
    def batches(*parts, fail=False):
        for p in parts:
            yield pa.RecordBatch.from_pydict({"value": list(p)})
        if fail:
            raise OSError("lost")

    writer = LinesWriter({"path": str(tmp_path), "file_bytes": "5"}, False)
    lost = writer.write(batches(["x", "y"]))  # an attempt whose executor was lost after it wrote
    with pytest.raises(OSError):
        writer.write(batches(["x"], ["y"], fail=True))
    done = writer.write(batches(["x", "y"], ["zz", "w"]))
    writer.commit([done, None, writer.write(batches())])
    got = sorted(line for f in committed_files(str(tmp_path)) for line in open(f).read().splitlines())
    assert got == ["w", "x", "y", "zz"] and len(done.files) == 2 and sum(f[1] for f in done.files) == 4
    assert files_of(tmp_path) == {f[0] for f in done.files + lost.files}
    writer.abort([lost, None])
    assert files_of(tmp_path) == {f[0] for f in done.files}


def test_findings_and_merged_rows(spark, tmp_path):
    data = [("r:1/\u00e9 *", 0, "g", "t", "P1", "f", 3, "caf\u00e9 \"q\"", "", None, 0.5, None, "e\nx", "deny"), ("r2", 7, "g", "t", "P3", "f", 0, "T", "d", "id", 1.0, "fix", None, None)]
    df = spark.createDataFrame(data, FINDING_SCHEMA)
    out = str(tmp_path / "findings")
    sinks.commit_findings(df, out)
    assert rows(source.read_findings(spark, committed_files(out), mode="strict")) == rows(df)
    docs = ['{"title":"T","zeta":{"b":[1,null],"a":""},"severity":"P1"}', '{"title":"T","severity":"P1","other":1}', '{"fingerprint":"x","n":1.5}']
    raw = spark.createDataFrame([("r", i, d) for i, d in enumerate(docs)], "run_id string, seq long, j string").select("run_id", "seq", F.parse_json("j").alias("raw"))
    keyed = gates.loose_findings(raw)
    keyed = keyed.withColumn("fingerprint", gates.fingerprint(*[F.col(c) for c in ("given", "severity", "kind", "file", "line", "title")]))
    sinks.commit_merged(gates.merge_feeds(keyed, keyed), str(tmp_path / "merged"))
    assert values(spark, str(tmp_path / "merged")) == ['{"fingerprint":"x","n":1.5}', '{"severity":"P1","title":"T","zeta":{"a":"","b":[1,null]}}']
