"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwork.llm import katz, langid, mixing, near_dedup, packing, quality, secrets, sharding, simhash, url_filter, vector_codes, warc, whitening
from siftwork.plans.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# DuckDB SQL for the queries that it can express.
SQL: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets share 85 percent."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


SQL["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha256(body) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT d.page_id, n AS payload_bytes, d.h AS payload_digest,
  CASE WHEN first IS NOT NULL AND d.page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h
"""


@_query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return url_filter.judge_pages(_table(spark, sf_dir, "pages"))


SQL["op5_url_filter"] = rf"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, '.' || host AS h,
    CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|[.-])({'|'.join(url_filter.BLOCKED_WORDS)})([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shuffled shards, read back from the written shards."""
    written, _ = sharding.shuffled_shards(_table(spark, sf_dir, "documents"))
    return written.select(
        "row.doc_id",
        "size",
        F.crc32(F.encode(F.coalesce("row.text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of all documents at the target entropy of the sources."""
    used = mixing.schedule(_table(spark, sf_dir, "documents"))
    return used.select("row.doc_id", "row.source", "tokens", "share", "weight", "exponent", "budget", "pass", "block", "place")


@_query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, with thresholds certified on the labels."""
    docs = _table(spark, sf_dir, "documents")
    rules = quality.learn(docs, _table(spark, sf_dir, "labels"))
    return quality.judged(docs.select("doc_id", "text", "lang"), rules).select("doc_id", "quality.*")


@_query
def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _table(spark, sf_dir, "documents")
    models = langid.learn(docs)
    found = langid.identified(docs.select("doc_id", "text"), models)
    return found.select("doc_id", (~langid.training_fold(F.col("doc_id"))).alias("held_out"), "language.*")


@_query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return simhash.fingerprinted(_table(spark, sf_dir, "documents"))


@_query
def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the model that the training documents give."""
    return katz.scored(_table(spark, sf_dir, "documents"))


@_query
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.scanned(_table(spark, sf_dir, "documents"))


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and exact errors of every vector."""
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


SQL["op12_vector_codes"] = vector_codes.SQL


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector."""
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))
