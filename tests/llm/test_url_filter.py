import numpy as np
import xxhash
from pyspark.sql import functions as F

from siftwork.llm import url_filter
from siftwork.llm.common import Scratch


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_verdicts(spark):
    cases = {
        "http://a.net": ("a.net", "", None, "allow"),
        "http://A.NET/x": ("a.net", "/x", "net/", "block"),
        "https://w.example.net/en/1?x=/": ("w.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/en": ("example.net", "/en", "net/", "block"),
        "https://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "x://b.example.com/de/#a": ("b.example.com", "/de/", "example.com/de/", "block"),
        "https://o.org/fr/1://x": ("o.org", "/fr/1://x", "org/fr/", "allow"),
        "https://a.net:80/": ("a.net:80", "/", None, "allow"),
        "https://my-casino.example.org/": ("my-casino.example.org", "/", None, "block"),
        "https://www.my-casino.example.org/fr/": ("www.my-casino.example.org", "/fr/", "org/fr/", "allow"),
        "no url": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://?q": ("", "", None, "allow"),
        "http:///net/": ("", "/net/", None, "allow"),
        "http://é.net/\n": ("é.net", "/\n", "net/", "block"),
        "http://x.com/" + "a" * 50_000: ("x.com", "/" + "a" * 50_000, None, "allow"),
    }
    got = url_filter.judge_pages(pages(spark, list(cases)).withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == list(cases.values())
    assert url_filter.judge_pages(pages(spark, [])).collect() == []


def test_many_shards_and_collisions(spark, monkeypatch):
    entries = [(f"h{k}.example", "block" if k % 3 else "allow") for k in range(500)]
    table = spark.createDataFrame(entries + [(None, "block"), ("", "block"), entries[0], entries[0]], "entry string, verdict string")
    none = table.limit(0)
    urls = url_filter.build(spark, none, table, Scratch(spark, "test"), shard_entries=60)
    assert len(urls.paths) > 3
    keys = [e.encode() for e, _ in entries] + [b"h1.exampl", b"zzz"]
    want = [b"lb" if v == "block" else b"la" for _, v in entries] + [None, None]
    assert urls.find(keys) == want
    # A key of the same digest but another string is not taken for the stored one.
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda k, real=xxhash.xxh64_intdigest: real(b"h7.example") if k == b"other" else real(k))
    assert urls.find([b"other", b"h7.example"]) == [None, b"lb"]
    assert url_filter.UrlList([], [], []).find([b"a"]) == [None]
    assert np.all(np.diff(np.array(urls.lows, np.float64)) > 0)


def test_rule_wins_over_list(spark):
    listed = spark.createDataFrame([("a.b.com", "block"), ("b.com", "block")], "entry string, verdict string")
    rules = spark.createDataFrame([("b.com", "allow")], "entry string, verdict string")
    urls = url_filter.build(spark, rules, listed, Scratch(spark, "test"))
    got = url_filter.judge(pages(spark, ["http://a.b.com/x", "http://c.com/"]).select("page_id", "url"), urls, default="block").orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("b.com", "allow"), (None, "block")]
