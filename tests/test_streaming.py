"""Streams in several micro-batches give what the batch operators give."""

import random
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwork.operators import fixes, gates, quota
from siftwork.plans.session import shared_folder
from siftwork.streaming import queries as S, stateful
from siftwork.streaming.stateful import state_settings
from siftwork.workloads.stream_queries import folder
from tests.conftest import rows
from tests.test_quota import log, random_log, replay


def stream_of(spark, df, tmp_path, order, files=4):
    """The rows as a stream of ``files`` files, read one per micro-batch in order."""
    n = df.count()
    import time

    for i in range(files):
        part = df.filter((F.col(order) >= i * n // files) & (F.col(order) < (i + 1) * n // files))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(query, at):
    q = query.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.fixture
def two_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_fix_admission_over_many_batches_and_a_restart(spark, tmp_path, two_partitions):
    rnd = random.Random(4)
    req = [(rnd.choice("aaab"), i, f"f{rnd.randrange(9)}") for i in range(190)] + [("late", 190 + i, f"f{i % 4}") for i in range(10)]
    df = spark.createDataFrame(req, "build_id string, seq long, finding_id string")
    at = folder(spark)

    def go():
        with state_settings(spark, empty_batches=False):
            run(S.with_accepted(stream).writeStream.foreachBatch(S.decide_batch(f"{at}/out")), at)

    stream = stream_of(spark, df.filter("seq < 100"), tmp_path, "seq", 10)
    go()
    first = rows(S.read_decisions(spark, f"{at}/out"), "seq", "accepted")
    assert len(first) == 100
    later = df.filter("seq >= 100").withColumn("seq", F.col("seq") - 100)
    for i in range(10):
        later.filter((F.col("seq") >= 10 * i) & (F.col("seq") < 10 * i + 10)).withColumn("seq", F.col("seq") + 100).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    go()  # a new run of the query goes on from the checkpoint
    cols = ("build_id", "seq", "accepted", "already_attempted", "rate_limited", "decision_reason")
    got = S.read_decisions(spark, f"{at}/out")
    assert got.select("batch").distinct().count() == 20
    assert rows(got, *cols) == rows(fixes.admit_fixes(df), *cols)
    # What is left beside the decisions is Spark's own state: at most three ids of a build.
    state = spark.read.format("statestore").option("stateVarName", "accepted").load(f"{at}/checkpoint")
    assert {r[0]: r[1] for r in state.groupBy("key.build_id").count().collect()} == {"a": 3, "b": 3, "late": 3}
    assert sorted(p.name for p in Path(f"{at}/out").iterdir()) == ["decisions", "staged"] and not list(Path(f"{at}/out/staged").iterdir())


def test_a_repeated_batch_changes_nothing(spark):
    rows_ = [((("a", i, f"f{i}")), None) for i in range(6)] + [(None, ("a", f"f{i}", i)) for i in range(3)]
    df = spark.createDataFrame(rows_, "request struct<build_id:string,seq:long,finding_id:string>, accepted struct<build_id:string,finding_id:string,first_seq:long>")
    at = folder(spark)
    step = S.decide_batch(at)
    step(df, 0)
    before = rows(S.read_decisions(spark, at), "seq", "accepted")
    step(df, 0)
    assert rows(S.read_decisions(spark, at), "seq", "accepted") == before
    assert [s for s, ok in before if ok] == [0, 1, 2]


def test_first_ids_of_a_hot_build_are_few(spark):
    """Before the shuffle, partitions pass on twice the limit per build, and early ids win whatever their order inside."""
    processor = stateful._Accepted(3, 1000)
    taken = {}

    class Taken:
        def iterator(self):
            return iter([((k,), v) for k, v in taken.items()])

        def updateValue(self, key, value):
            taken[key[0]] = value

    processor.taken = Taken()
    frame = lambda *ids: pd.DataFrame({"finding_id": [i for i, _ in ids], "first_seq": [s for _, s in ids]})
    out = list(processor.handleInputRows(("b",), iter([frame(("x", 5), ("y", 2)), frame(("x", 1))]), None))[0]
    assert sorted(zip(out.finding_id, out.first_seq)) == [("x", 1), ("y", 2)]
    out = list(processor.handleInputRows(("b",), iter([frame(("z", 9), ("w", 7), ("x", 6))]), None))[0]
    assert sorted(zip(out.finding_id, out.first_seq)) == [("w", 7), ("x", 1), ("y", 2)]


def test_quota_state(spark, tmp_path):
    events = random_log(200)
    df = log(spark, events).cache()
    at = folder(spark)
    state = S.quota_state(stream_of(spark, df, tmp_path, "seq"))
    run(state.writeStream.outputMode("update").format("noop"), at)
    cols = ("stream_key", "seq", "state", "reason", "resets_at", "using_overage")
    got = S.quota_now(spark, f"{at}/checkpoint")
    assert rows(got, *cols) == rows(quota.latest_quota(quota.quota_events(df)), *cols)
    assert rows(got.drop("reason"), "stream_key", "seq", "state", "resets_at", "using_overage") == sorted({r[0]: r for r in replay(events)}.values())


def test_merged_findings_prefer_the_backend_whenever_it_comes(spark, tmp_path):
    rnd = random.Random(8)
    data = [(i, "r" if i % 3 else "q", "hot" if i % 2 else f"f{i % 7}", rnd.choice([0, 1, 1, 1]), rnd.choice("xyz"), rnd.randrange(5)) for i in range(200)]
    schema = "at long, run_id string, fingerprint string, feed_rank int, file string, line int"
    df = spark.createDataFrame(data, schema).withColumn("seq", F.col("at") % 11).withColumn("title", F.lit("t"))
    at = folder(spark)
    rows_ = stream_of(spark, df, tmp_path, "at", 5).drop("at")
    run(S.merged_findings(rows_).writeStream.outputMode("update").format("noop"), at)
    got = S.merged_state(spark, f"{at}/checkpoint", rows_.schema)
    cols = ("run_id", "fingerprint", "feed_rank", "seq", "file", "line", "title")
    want = gates.merge_feeds(df.filter("feed_rank = 0").drop("at", "feed_rank"), df.filter("feed_rank = 1").drop("at", "feed_rank"))
    assert rows(got, *cols) == rows(want, *cols)
    assert 0 < got.filter("feed_rank = 0").count()


def test_unique_findings(spark, tmp_path):
    data = [("r", "hot" if i % 2 else f"f{i % 7}", i) for i in range(60)]
    df = spark.createDataFrame(data, "run_id string, fingerprint string, seq long").withColumn("ts", F.timestamp_seconds("seq"))
    at = folder(spark)
    out = S.unique_findings(stream_of(spark, df, tmp_path, "seq"))
    run(out.writeStream.format("parquet").option("path", f"{at}/rows"), at)
    got = [r.fingerprint for r in spark.read.parquet(f"{at}/rows").collect()]
    assert sorted(got) == sorted({d[1] for d in data})


def test_late_rows_are_counted(spark, tmp_path):
    data = [("r", "P0", 100), ("r", "P1", 200_000), ("r", "P0", 300_000), ("r", "P0", 150), ("r", "P0", 400_000), ("r", "P3", 400_001)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "seq long, run_id string, severity string, at long")
    src = stream_of(spark, df.withColumn("ts", F.timestamp_seconds("at")), tmp_path, "seq", 6)
    at = folder(spark)
    late = S.LateRows()
    spark.streams.addListener(late)
    q = S.severity_windows(src).writeStream.queryName("windows").format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/c")
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    for _ in range(100):  # events reach listeners a little later
        if late.dropped.get("windows"):
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    assert late.dropped["windows"] == 1
    assert rows(spark.read.parquet(f"{at}/rows"), "p0", "p1") == [(0, 1), (1, 0), (1, 0)]


def test_run_ends_come_when_they_happen(spark, tmp_path, two_partitions):
    data = [
        ("a", 10, "queued"), ("a", 100, "completed"),
        ("b", 200, "queued"), ("b", 1200, "failed"),
        ("late", 1300, "error"), ("late", 1250, "queued"),  # the end arrives before its trigger
        ("c", 90_000, "queued"), ("z", 99_000, "queued"),
        ("z", 99_003, "error"), ("z", 99_001, "failed"),
        ("twice", 99_100, "queued"), ("twice", 99_100, "queued"),
        ("twice", 99_150, "Blocked "), ("q", 250_000, "queued"),
    ]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "seq long, run_id string, at long, status string")
    src = stream_of(spark, df.withColumn("ts", F.timestamp_seconds("at")), tmp_path, "seq", 7)
    triggers = src.filter("status = 'queued'").select("run_id", F.col("ts").alias("started_at"))
    at = folder(spark)

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{at}/rows")

    with state_settings(spark):
        run(S.run_ends(triggers, src.select("run_id", "ts", "status")).writeStream.foreachBatch(keep), at)
    got = spark.read.parquet(f"{at}/rows")
    # One row per trigger; the last trigger is still open.
    want = [("a", False, 100), ("b", True, None), ("c", True, None), ("late", False, 1300), ("twice", False, 99_150), ("twice", False, 99_150), ("z", False, 99_001)]
    assert rows(got.select("run_id", "timed_out", F.unix_seconds("ended_at"))) == want
    # An end comes out in the batch that brings it, before the watermark has passed the limit.
    came = {r.run_id: r.batch for r in got.collect()}
    batches = {i: b for b, i in enumerate(["a", "b", "late", "c", "z", "twice", "q"])}
    assert came["a"] == 0 and came["late"] == 2 and came["z"] < came["c"] + 10 and came["b"] > batches["b"]
    batch = gates.run_timeouts(df.filter("status = 'queued' and run_id <> 'q'").select("run_id", F.timestamp_seconds("at").alias("started_at")), df.select("run_id", F.timestamp_seconds("at").alias("ts"), "status"))
    assert rows(got, "run_id", "started_at", "timed_out") == rows(batch, "run_id", "started_at", "timed_out")


def test_shared_folder_is_the_clusters(spark):
    class Conf:
        def get(self, key, default=None):
            return "hdfs://nn/shared/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert shared_folder(Session()) == "hdfs://nn/shared"

    class Unset(Conf):
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Cluster:
        conf, sparkContext = Unset(), Context()

    with pytest.raises(ValueError):
        shared_folder(Cluster())
