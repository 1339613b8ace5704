"""One key holds most rows: joins on it are split at run time and give the whole result."""

import bisect

import pytest
from pyspark.sql import functions as F

from siftwork.operators import fixes, gates, phrases, quota, scan
from siftwork.operators.scan import Rule

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}
N = 40_000


@pytest.fixture
def unbroadcast(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_key(col="id"):
    return F.when(F.col(col) % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col(col) % 997).cast("string")))


def wide(spark):
    """Rows that do not compress away, most of them under one key, in many input splits."""
    return spark.range(0, N, 1, 16).select("id", hot_key().alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("noise"))


def split_at_run_time(df):
    out = df.collect()
    return out, "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_calls_on_a_hot_stream(spark, unbroadcast):
    latest = spark.range(0, 997).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("stream_key"), F.lit("exhausted").alias("state"))
    latest = latest.groupBy("stream_key").agg(F.max("state").alias("state"))
    asks = wide(spark).select(F.col("key").alias("stream_key"), F.col("id").alias("tokens"), "noise")
    out, split = split_at_run_time(quota.admit_calls(asks, latest))
    assert split and len(out) == N and sum(r.allow for r in out) == sum(i % 3 > 0 for i in range(N))


def test_fixes_of_a_hot_finding(spark, unbroadcast):
    asks = wide(spark).select(F.lit("b").alias("build_id"), F.col("id").alias("seq"), F.col("key").alias("finding_id"), "noise")
    out, split = split_at_run_time(fixes.admit_fixes(asks))
    assert split and len(out) == N and sum(r.accepted for r in out) == 3
    assert sum(r.already_attempted for r in out) > N // 2


def test_match_of_a_hot_finding(spark, unbroadcast):
    asks = wide(spark).select(F.lit("b").alias("build_id"), F.col("id").alias("seq"), F.col("key").alias("finding_id"), "noise")
    blank = [F.lit("").alias(c) for c in ("gate_id", "tool", "severity", "title", "description", "recommended_fix", "evidence")]
    found = wide(spark).select(F.lit("b").alias("build_id"), F.col("id").alias("seq"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.col("key").alias("rule_id"), *blank)
    out, split = split_at_run_time(fixes.match_findings(asks, found))
    assert split and len(out) == N and all(r.found for r in out)


def test_feed_of_a_hot_run(spark, unbroadcast):
    local = wide(spark).select(F.col("key").alias("run_id"), "id", "noise")
    backend = local.filter("run_id in ('k0', 'k3')")
    out, split = split_at_run_time(gates.backend_or_local(backend, local))
    assert split and len(out) == N


def test_scan_of_a_hot_run(spark, unbroadcast):
    files = wide(spark).select(F.col("key").alias("run_id"), F.col("id").cast("string").alias("file"), F.concat("noise", F.lit("\nx=1")).alias("text"))
    rule = Rule(r"x=\d", "P1")
    rules = files.select("run_id").distinct().select("run_id", F.lit(1).alias("rule_no"), *[F.lit(v).cast("string").alias(n) for n, v in rule._asdict().items()])
    out, split = split_at_run_time(scan.scan_run_rules(files, rules))
    assert split and len(out) == N and {r.line for r in out} == {2}


def test_phrases_behind_a_hot_word(spark, unbroadcast):
    texts = wide(spark).select("id", F.concat(F.lit("the "), "key", F.lit(" "), "noise").alias("t"))
    book = spark.createDataFrame([("the",), ("the hot",), ("k3",)], "phrase string")
    out, split = split_at_run_time(phrases.phrase_hits(texts, book, ["id"], "t", carry_text=True))
    assert split
    assert len(out) == N + sum(i % 3 > 0 for i in range(N)) + sum(i % 3 == 0 and i % 997 == 3 for i in range(N))


def test_top_rows_of_a_hot_run(spark):
    found = wide(spark).select(
        F.col("key").alias("run_id"), F.lit("P1").alias("severity"), F.lpad(F.col("id").cast("string"), 9, "0").alias("file"), F.lit(0).alias("line")
    )
    top = gates.top_findings(found).filter("run_id = 'hot'").orderBy("rank").collect()
    assert [int(r.file) for r in top] == [i for i in range(20) if i % 3 > 0][:10]


def test_ends_of_a_hot_run(spark, unbroadcast):
    log = wide(spark).withColumn("ts", F.timestamp_seconds(F.col("id") * 7))
    triggers = log.filter("id % 5 = 0").select(F.col("key").alias("run_id"), F.col("ts").alias("started_at"))
    samples = log.filter("id % 5 = 3").select(F.col("key").alias("run_id"), "ts", F.lit("failed").alias("status"))
    df = gates.run_timeouts(triggers, samples, 60)
    out = {(r.run_id, r.started_at): (r.ended_at, r.timed_out) for r in df.collect()}
    by_run = {}
    for r in samples.orderBy("ts").collect():
        by_run.setdefault(r.run_id, []).append(r.ts)
    for r in triggers.collect():
        ends = by_run.get(r.run_id, [])
        k = bisect.bisect_left(ends, r.started_at)
        end = ends[k] if k < len(ends) else None
        assert out[r.run_id, r.started_at] == (end, end is None or (end - r.started_at).total_seconds() > 60)
    assert len(out) == triggers.count()
    # Rows are dealt by run and hour; only the summaries of a run's hours meet.
    groups = triggers.groupBy("run_id", F.floor(F.unix_seconds("started_at") / 3600)).count()
    assert groups.agg(F.max("count")).first()[0] < 200
