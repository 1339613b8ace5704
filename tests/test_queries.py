"""Every registered query against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402
import __spark_entry__ as entry  # noqa: E402
from siftwork.workloads import load  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(load()[0]))
def test_query_equals_sql(spark, con, name):
    line = check.compare(spark, con, name, SF)
    assert line.startswith("ok"), line


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(load()[1]) == set(load()[0])
    assert set(load()[0]) <= set(entry.queries())


def test_excluded_dirs_of_a_very_long_url(spark, tmp_path):
    urls = [f"https://a.example/{'d' * 4095}/", f"https://a.example/{'d' * 5000}/", "https://b.example/x"]
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(urls)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = load()[0]["excluded_dirs"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in got] == con.execute(load()[1]["excluded_dirs"]).fetchall() == [("b.example", 1)]
