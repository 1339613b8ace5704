"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. ``run``
writes each stage's result as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwork.llm import langid, mixing, near_dedup, packing, quality
from siftwork.llm.common import Scratch, maybe_broadcast
from siftwork.plans.session import tune


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoff of their language."""
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = _free(docs, "verdict")
    return quality.judged(docs, rules, verdict).filter(F.col(verdict)["kept"]).select(docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the calibrated share of strange texts and texts without letters go.

    Nothing is held out here, so the models learn from all documents.
    """
    language = _free(docs, "language")
    found = langid.identified(docs, langid.learn(docs, whole=True), language)
    return found.filter(~F.col(language)["rejected"] & (F.col(language)["lang_pred"] != "und")).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; of rows with one id, one."""
    near = near_dedup.near_duplicates(docs).groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    near = Scratch(spark, "groups").keep(near.filter("doc_id is not null and (not kept or n > 1)"), "near")
    gone, twice = near.filter("not kept").select("doc_id"), near.filter("kept").select("doc_id")
    n_gone, n_twice = gone.count(), twice.count()
    kept = docs.join(maybe_broadcast(gone, n_gone), "doc_id", "left_anti").select(docs.columns)
    if not n_twice:
        return kept
    again = kept.join(maybe_broadcast(twice, n_twice), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return kept.join(maybe_broadcast(twice, n_twice), "doc_id", "left_anti").select(docs.columns).unionByName(again)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of smaller sources up to the repetitions that the target weights ask for."""
    return mixing.schedule(docs).select("row.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_dedup", one_of_each_group),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

# Fitted thresholds, language models and tokenisation are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(tune(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
