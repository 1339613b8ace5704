import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import gates, quota
from tests.conftest import rows

SCHEMA = "stream_key string, seq long, ts timestamp, http_status int, headers map<string,string>, manual_reset boolean"
NOW = 1_000_000


def log(spark, events):
    """Events ``(key, seq, at, status, headers, manual)`` with epoch seconds."""
    df = spark.createDataFrame([(k, s, None, c, h, m) for k, s, _, c, h, m in events], SCHEMA)
    at = spark.createDataFrame([(k, s, float(a)) for k, s, a, *_ in events], "stream_key string, seq long, at double")
    return df.drop("ts").join(at, ["stream_key", "seq"]).withColumn("ts", F.timestamp_seconds("at")).drop("at")


def state_of(spark, status, headers, at=NOW):
    out = quota.quota_events(log(spark, [("k", 1, at, status, headers, False)])).collect()
    return (out[0].state, out[0].reason) if out else None


@pytest.mark.parametrize("status, headers, want", [
    (200, {"Anthropic-RateLimit-Unified-Status": "allowed"}, "normal"),
    (200, {"ratelimit-unified-status": "Rejected"}, "throttled"),
    (200, {"anthropic-ratelimit-unified-5h-utilization": "0.92", "anthropic-ratelimit-unified-reset": str(NOW + 7200)}, "warning"),
    (200, {"anthropic-ratelimit-unified-5h-utilization": "0.92", "anthropic-ratelimit-unified-reset": str(NOW + 1080)}, "normal"),
    (200, {"ratelimit-unified-7d-utilization": "0.80", "x-ratelimit-reset": str(NOW + 561_600)}, "warning"),
    (200, {"ratelimit-unified-7d-utilization": "0.30", "x-ratelimit-reset": str(NOW + 604_800)}, "warning"),
    (200, {"ratelimit-unified-7d-utilization": "0.20", "x-ratelimit-reset": str(NOW + 604_800)}, "normal"),
    (200, {"ratelimit-unified-5h-utilization": "nan", "x-ratelimit-reset": str(NOW + 7200)}, "normal"),
    (200, {"ratelimit-unified-5h-utilization": "0.99"}, None),
    (200, {"content-type": "x"}, None),
    (200, None, None),
    (503, {"ratelimit-unified-status": "allowed"}, None),
    (429, {"Retry-After": "15"}, "throttled"),
    (429, {"retry-after": "0"}, "exhausted"),
    (429, {"retry-after": "soon"}, "exhausted"),
    (429, {}, "exhausted"),
    (429, {"retry-after": "15", "anthropic-ratelimit-overage-status": "ALLOWED"}, "using_overage"),
    (429, {"overage-status": "disabled", "retry-after": "9.7"}, "throttled"),
])
def test_state_after_one_event(spark, status, headers, want):
    got = state_of(spark, status, headers)
    assert (got and got[0]) == want


def test_reasons(spark):
    h = {"ratelimit-unified-5h-utilization": "0.92", "ratelimit-unified-reset": str(NOW + 7200)}
    assert state_of(spark, 200, h)[1] == "early_warning[5h]: util=0.92 >= 0.9, time_progress=0.60 <= 0.72"
    assert state_of(spark, 429, {"retry-after": "45"})[1] == "429 received; retry_after=45s"


def random_log(n=400):
    rnd = random.Random(2)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.5 else rnd.choice("ab")
        kind = rnd.randrange(6)
        headers = {
            0: {"ratelimit-unified-status": "allowed", "ratelimit-unified-reset": str(NOW + i)}, 1: {"retry-after": "3"},
            2: {"overage-status": "allowed", "x-ratelimit-reset": "5"}, 3: {"x-ratelimit-reset": str(i)},
            4: {"ratelimit-unified-status": "rejected"}, 5: {},
        }[kind]
        out.append((key, i, NOW + i, 200 if kind in (0, 4) else 429, headers, rnd.random() < 0.05))
    return out


def replay(events):
    """One tracker per key, event by event."""
    state, out = {}, []
    for key, seq, _, status, h, manual in events:
        s = state.setdefault(key, {"reset": None, "over": False})
        reset = int(h["ratelimit-unified-reset"]) if "ratelimit-unified-reset" in h else int(h["x-ratelimit-reset"]) if "x-ratelimit-reset" in h else None
        if manual:
            s.update(state="normal", over=False)
        elif status == 429 and h.get("overage-status") == "allowed":
            s.update(state="using_overage", over=True)
        else:
            s["reset"] = reset if reset is not None else s["reset"]
            if status == 429:
                s["state"] = "throttled" if h.get("retry-after") else "exhausted"
            else:
                s["state"] = "throttled" if h["ratelimit-unified-status"] == "rejected" else "normal"
        out.append((key, seq, s["state"], s["reset"], s["over"]))
    return out


@pytest.mark.parametrize("bucket", [1, 7, 1_000_000])
def test_timeline_equals_a_replay(spark, bucket):
    events = random_log()
    df = log(spark, events).repartition(5)
    got = quota.quota_timeline(df, bucket).select("stream_key", "seq", "state", "resets_at", "using_overage")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == replay(events)
    latest = quota.latest_quota(quota.quota_events(df)).select("stream_key", "seq", "state", "resets_at", "using_overage")
    assert sorted(map(tuple, latest.collect())) == sorted({r[0]: r for r in replay(events)}.values())


def test_admission(spark):
    cases = [("normal", 100_000, True, False), ("exhausted", 1, False, False), ("throttled", 4_000, True, True), ("throttled", 4_001, False, False),
             ("warning", 1, True, True), ("warning", 20_000, True, True), ("using_overage", 9, True, True)]
    df = spark.createDataFrame([(s, t) for s, t, _, _ in cases], "state string, tokens long")
    got = df.select("state", "tokens", quota.admission(F.col("state"), F.col("tokens")).alias("a")).select("state", "tokens", "a.allow", "a.warn")
    assert sorted(map(tuple, got.collect())) == sorted(cases)


def test_unknown_stream_is_normal(spark):
    latest = spark.createDataFrame([("a", "exhausted")], "stream_key string, state string")
    asks = spark.createDataFrame([("a", 1), ("b", 1)], "stream_key string, tokens long")
    assert rows(quota.admit_calls(asks, latest), "stream_key", "allow") == [("a", False), ("b", True)]


def test_run_status(spark):
    s = spark.createDataFrame(
        [("a", 1, 0, "queued", "", None), ("a", 3, 500, " Completed ", "done", {"P0": "2"}), ("a", 2, 100, "running", "x", {"P0": "1"}), ("b", 1, 0, "", None, None),
         ("c", 2, 901, "failed", "", None)],
        "run_id string, seq long, at long, status string, progress string, counts map<string,string>",
    ).withColumn("ts", F.timestamp_seconds("at"))
    assert rows(gates.latest_status(s), "run_id", "status", "progress", F.col("counts")["P0"]) == [
        ("a", "completed", "done", "2"), ("b", "queued", "queued", None), ("c", "failed", "failed", None),
    ]
    started = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string").withColumn("started_at", F.timestamp_seconds(F.lit(0)))
    assert rows(gates.run_timeouts(started, s), "run_id", "timed_out") == [("a", False), ("b", True), ("c", True)]


def test_first_end_at_or_after_the_trigger(spark):
    samples = [("a", 10, "failed"), ("a", 100, "done"), ("a", 100, "completed"), ("a", 160, "error"), ("b", 5, "failed"), ("c", 50, "blocked"), ("c", 70, "failed")]
    s = spark.createDataFrame(samples, "run_id string, at long, status string").withColumn("ts", F.timestamp_seconds("at"))
    t = spark.createDataFrame([("a", 20), ("a", 100), ("a", 150), ("a", 161), ("b", 6), ("c", 50), ("d", 1)], "run_id string, at long").withColumn("started_at", F.timestamp_seconds("at"))
    got = gates.run_timeouts(t, s, 30).select("run_id", F.unix_seconds("started_at"), F.unix_seconds("ended_at"), "timed_out")
    assert sorted(map(tuple, got.collect())) == [
        ("a", 20, 100, True), ("a", 100, 100, False), ("a", 150, 160, False), ("a", 161, None, True), ("b", 6, None, True), ("c", 50, 50, False), ("d", 1, None, True),
    ]


def test_asks_do_not_block_the_bridge(spark):
    found = spark.createDataFrame([("a", "P0", "ask"), ("b", "P0", None), ("c", "P1", "allow"), ("c", "P1", "deny")], "run_id string, severity string, decision string")
    runs = spark.createDataFrame([(r, "completed", True) for r in "abc"], "run_id string, status string, waited boolean")
    assert rows(gates.bridge_verdicts(found, runs), "run_id", "p0", "p1", "blocking", "verdict") == [
        ("a", 1, 0, 0, "passed"), ("b", 1, 0, 1, "blocked"), ("c", 0, 2, 1, "blocked"),
    ]
    assert rows(gates.bridge_verdicts(found, runs, parity=True), "verdict") == [("blocked",)] * 3
