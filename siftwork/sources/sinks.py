"""Findings and summaries as JSON files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from siftwork.schemas import JSON_KEYS, SEVERITIES
from siftwork.sources.committed import write_committed


def json_findings(findings: DataFrame) -> DataFrame:
    """Findings under their on-disk keys, with their number in the feed."""
    return findings.select("run_id", "seq", *[F.col(c).alias(k) for c, k in JSON_KEYS.items()])


def write_findings(findings: DataFrame, path: str, by_run: bool = True, mode: str = "overwrite") -> None:
    """JSON lines with nulls kept, one folder per run.

    Rows are placed by run first, so that a run has few files; a large run is split. With very many
    runs pass ``by_run=False``: the run then is a key of each row.
    """
    rows = json_findings(findings)
    if by_run:
        rows.hint("rebalance", "run_id").write.mode(mode).partitionBy("run_id").option("ignoreNullFields", "false").json(path)
    else:
        rows.withColumnRenamed("run_id", "runId").write.mode(mode).option("ignoreNullFields", "false").json(path)


def commit_findings(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """As ``write_findings``, all or nothing: read back with ``read_findings(spark, committed_files(path))``.

    Each line has its run, so any text may name one.
    """
    rows = json_findings(findings)
    line = F.to_json(F.struct(F.col("run_id").alias("runId"), *[c for c in rows.columns if c != "run_id"]), {"ignoreNullFields": "false"})
    write_committed(rows.select("run_id", line.alias("value")), path, mode)


def run_summaries(verdicts: DataFrame, gate_results: DataFrame, threshold: str, policies: DataFrame | None = None, dispatch: DataFrame | None = None) -> DataFrame:
    """One row per run: counts, gates, blocking, ask count. A run has as many gate rows as gates.

    ``policies`` has a row per run (``run_id`` and what to tell of its policy: status, path, version,
    ...), ``dispatch`` is ``routing.dispatch_summary``; each becomes a struct of the summary.
    """
    gates = gate_results.groupBy("run_id").agg(
        F.sort_array(
            F.collect_list(F.struct("gate_id", "status", "finding_count", "error_message"))
        ).alias("gates")
    )
    counts = F.struct(*[F.col(s.lower()).alias(s) for s in SEVERITIES])
    blocks = {"policy": policies, "persona_dispatch": dispatch}
    out = verdicts.join(gates, "run_id", "left")
    for name, block in blocks.items():
        if block is not None:
            body = F.struct(*[c for c in block.columns if c != "run_id"]).alias(name)
            out = out.join(block.select("run_id", body), "run_id", "left")
    return out.select(
        "run_id",
        counts.alias("counts"),
        "gates",
        "blocking",
        F.lit(threshold).alias("fail_severity"),
        "ask_count",
        "verdict",
        *[name for name, block in blocks.items() if block is not None],
    )


def write_summaries(summaries: DataFrame, path: str, mode: str = "overwrite") -> None:
    summaries.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_merged(merged: DataFrame, path: str, mode: str = "overwrite", keys: Sequence[str] = ("run_id",)) -> None:
    """Merged findings as JSON lines, keys in alphabetical order, one folder per run.

    Rows that carry their ``raw`` VARIANT are written as they came, every key of theirs; others by column.
    """
    merged_lines(merged, keys).hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).text(path)


def commit_merged(merged: DataFrame, path: str, mode: str = "overwrite") -> None:
    """As ``write_merged``, all or nothing: read back with ``read_committed``."""
    write_committed(merged_lines(merged, ("run_id",)), path, mode)


def merged_lines(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys and each row's JSON, ``value``."""
    if "raw" in merged.columns:
        # A variant keeps the keys of its objects sorted.
        return merged.select(*keys, F.to_json("raw").alias("value"))
    rest = sorted(c for c in merged.columns if c not in keys and c != "feed_rank")
    return merged.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("value"))

