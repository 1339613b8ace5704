import gzip
import hashlib

from pyspark.sql import functions as F

from siftwork.llm import warc
from siftwork.llm.common import Scratch

LONG = "<p>" + "long page é\n" * 20


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    rows = [(5, "http://a/1", LONG), (3, "http://a/2", LONG), (9, None, LONG), (1, "http://a/\r\nX: y", "short"), (2, "u", "short")]
    rows += [(7, "http://e", None), (8, "http://e", ""), (10, "http://big", "x\r\n\r\n" * 400_000), (3, "http://a/2", LONG), (None, "n", LONG)]
    got = sorted((tuple(r) for r in warc.archived_pages(pages(spark, rows)).collect()), key=str)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = html == LONG and i != 3
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=str)


def test_filters_reach_the_headers(spark):
    scratch = Scratch(spark, "test")
    rows = [(k, f"http://a/{k}", LONG if k % 2 else f"{LONG}{k}") for k in range(12)]
    path = warc.write_pages(warc.classified(pages(spark, rows), scratch), scratch)
    read = warc.read_warc(spark, payload="false", manifest=path)
    some = read.filter((F.col("record_type") == "revisit") & (F.col("target_uri") == "http://a/3"))
    assert "Filter (" not in some._jdf.queryExecution().sparkPlan().toString()
    (row,) = some.collect()
    assert (row.record_id, row.refers_to, row.payload, row.http_length) == ("<urn:page:3>", "<urn:page:1>", None, len(LONG.encode()))
    assert read.filter(F.col("record_type") == "response").count() == 7


def test_foreign_archives(spark, tmp_path):
    one = warc.record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<a>", "Content-Type": "text/plain"}, b"\r\n\r\nhello")
    two = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<b>", "Content-Type": "application/http"}, b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nbody")
    (tmp_path / "plain.warc").write_bytes(one + two)
    (tmp_path / "packed.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "notes.txt").write_text("no archive")
    got = warc.read_warc(spark, path=str(tmp_path), splitBytes="1").select("record_id", "payload").collect()
    assert sorted((r[0], bytes(r[1])) for r in got) == [("<a>", b"\r\n\r\nhello")] * 2 + [("<b>", b"body")] * 2
    only = warc.read_warc(spark, path=str(tmp_path)).filter("record_type = 'response'").collect()
    assert [bytes(r.payload) for r in only] == [b"body", b"body"]


def test_members_are_gzip():
    data = b"some data" * 1000
    assert gzip.decompress(warc.member(data) + warc.member(b"")) == data


def test_empty_table_and_extra_columns(spark):
    assert warc.archived_pages(pages(spark, [])).collect() == []
    odd = pages(spark, [(1, "u", LONG)])
    for name in ("digest", "n", "first", "record_type", "refers_to"):
        odd = odd.withColumn(name, F.lit(0))
    assert [r.page_id for r in warc.archived_pages(odd).collect()] == [1]
