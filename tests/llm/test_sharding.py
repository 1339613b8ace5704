from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from llm_support import docs_of
from siftwork.llm import sharding


def rows_of(written):
    return [(r.row.doc_id, r.size, r.shard, r.slot) for r in written.collect()]


def test_shards_are_a_balanced_permutation(spark):
    docs = docs_of(spark, [(k, "é" * (k % 50)) for k in range(999)] + [(999, None)])
    written, folder = sharding.shuffled_shards(docs, shards=7, bucket_bytes=4000)
    rows = rows_of(written)
    counts = Counter(r[2] for r in rows)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r[3] for r in rows if r[2] == s) == list(range(n))
    assert sorted((r[0], r[1]) for r in rows) == [(k, 2 * (k % 50) + 16) for k in range(999)] + [(999, 16)]
    assert len(list(Path(folder).glob("shard=*"))) == 7
    order = [r[0] for r in sorted(rows, key=lambda r: r[2:])]
    # Neighbours in the table are no neighbours in the shards.
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:])) < 20


def test_same_seed_same_shards(spark):
    docs = docs_of(spark, [(k, f"t{k}") for k in range(200)])
    one, two, other = (rows_of(sharding.shuffled_shards(docs, shards=3, seed=s)[0]) for s in (1, 1, 2))
    assert sorted(one) == sorted(two) != sorted(other)


def test_equal_rows_lie_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_BUCKET_GROUP", 3)
    docs = docs_of(spark, [(None, "same")] * 2000 + [(7, "t")] * 2000 + [(k, f"u{k}") for k in range(2000)])
    rows = sharding._sized(docs, 1)
    assert rows.select("hash").distinct().count() == 6000
    assert max(Counter(r.hash % 20 for r in rows.collect()).values()) < 400
    written, _ = sharding.shuffled_shards(docs, shards=9, bucket_bytes=6000)
    got = rows_of(written)
    assert Counter((r[0], r[1]) for r in got) == Counter({(None, 20): 2000, (7, 17): 2000} | {(k, 16 + len(f"u{k}")): 1 for k in range(2000) if k != 7}) + Counter([(7, 18)])
    for s in range(9):
        assert sorted(r[3] for r in got if r[2] == s) == list(range(len([r for r in got if r[2] == s])))
        # Each kind of row is in each shard.
        assert {r[0] for r in got if r[2] == s} >= {None, 7}


def test_order_in_a_bucket_does_not_depend_on_arrival(spark):
    laid = []
    for order in (range(300), reversed(range(300))):
        held = spark.createDataFrame([([(k, {"a": k}) for k in order],)], "held array<struct<hash:long,row:map<string,int>>>").coalesce(1)
        laid.append(held.select(F.shuffle(F.array_sort("held", sharding._by_hash), F.lit(5))).first()[0])
    assert laid[0] == laid[1] != sorted(laid[0], key=lambda x: x.hash)


def test_rows_before_each_bucket(spark):
    begins = sharding._begins(spark.createDataFrame([(b, b % 3 + 1) for b in range(0, 9000, 2)], "bucket long, n long"))
    want, at = {}, 0
    for b in range(0, 9000, 2):
        want[b] = at
        at += b % 3 + 1
    assert {r.bucket: r.begin for r in begins.collect()} == want


def test_odd_inputs(spark):
    assert rows_of(sharding.shuffled_shards(docs_of(spark, []))[0]) == []
    docs = docs_of(spark, [(None, None), (1, "a"), (1, "a"), (2, "x" * 300_000)])
    for name in ("size", "shard", "slot", "bucket", "row", "hash", "place"):
        docs = docs.withColumn(name, F.lit("c"))
    rows = rows_of(sharding.shuffled_shards(docs, shards=40, bucket_bytes=100)[0])
    assert sorted((r[0] or 0, r[1], r[3]) for r in rows) == [(0, 16, 0), (1, 17, 0), (1, 17, 0), (2, 300_016, 0)]


def test_no_python_in_the_plan(spark):
    written, _ = sharding.shuffled_shards(docs_of(spark, [(1, "a")]))
    assert "Python" not in written._jdf.queryExecution().executedPlan().toString()
