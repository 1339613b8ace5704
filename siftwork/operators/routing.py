"""Findings to owners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from siftwork.functions.paths import clean_file
from siftwork.functions.text import strip
from siftwork.plans.ranking import top_per_group

# The personas work can be routed to.
KNOWN_PERSONAS = (
    "security", "backend", "testing", "code-quality", "data-layer", "documentation", "reliability",
    "release", "observability", "infrastructure", "supply-chain", "ai-governance", "frontend",
)
BLOCKING = ("P0", "P1")
FILES_PER_PERSONA = 50


def read_ownership(rules: DataFrame, parity: bool = False) -> DataFrame:
    """Literal ownership of ``(repo, seq, pattern, persona)``: quotes off, wildcards dropped, last wins.

    Only a leading ``./`` is removed; with ``parity`` every leading dot and slash is.
    """

    def unquoted(name: str):
        t = strip(F.col(name))
        quoted = (F.length(t) >= 2) & t.rlike(r"""^(?:'.*'|".*")\z""")
        return F.when(quoted, F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)

    pattern = unquoted("pattern")
    lead = r"^[./]+" if parity else r"^\./"
    return (
        rules.select("repo", "seq", pattern.alias("pattern"), unquoted("persona").alias("persona"))
        .filter((F.col("pattern") != "") & (F.col("persona") != "") & ~F.col("pattern").rlike(r"[*?\[\]]"))
        .withColumn("file", F.regexp_replace("pattern", lead, ""))
        .groupBy("repo", "file")
        .agg(F.max_by("persona", "seq").alias("persona"))
    )


def route(
    findings: DataFrame,
    ownership: DataFrame,
    severities: Sequence[str] = BLOCKING,
    personas: Sequence[str] = KNOWN_PERSONAS,
) -> DataFrame:
    """Distinct ``(run_id, file, persona)`` of blocking findings; persona is null if nobody owns it.

    ``ownership(run_id, file, persona)`` has one row per file. Duplicates go before the join, so a
    file with a million findings is looked up once.
    """
    files = (
        findings.filter(F.col("severity").isin(*severities))
        .select("run_id", clean_file(F.col("file")).alias("file"))
        .filter(F.col("file") != "")
        .distinct()
    )
    owner = F.lower(strip(F.col("persona")))
    owned = ownership.select("run_id", "file", F.when(owner.isin(*personas), owner).alias("persona"))
    return files.join(owned, ["run_id", "file"], "left")


def routed_files(routes: DataFrame, per_persona: int = FILES_PER_PERSONA) -> DataFrame:
    """First files of each persona by name, as rows."""
    return top_per_group(
        routes.filter(F.col("persona").isNotNull()), ["run_id", "persona"], [F.col("file")], per_persona
    )


def persona_buckets(routes: DataFrame, per_persona: int = FILES_PER_PERSONA) -> DataFrame:
    """One row per run and persona with its sorted file list, at most ``per_persona`` long."""
    return (
        routed_files(routes, per_persona)
        .groupBy("run_id", "persona")
        .agg(F.sort_array(F.collect_list("file")).alias("files"))
    )


def remaining_files(routes: DataFrame, per_persona: int = FILES_PER_PERSONA) -> DataFrame:
    """The owned files that ``routed_files`` leaves for a later round, as rows."""
    first = routed_files(routes, per_persona).select("run_id", "persona", "file")
    return routes.filter(F.col("persona").isNotNull()).select("run_id", "persona", "file").join(first, ["run_id", "persona", "file"], "left_anti")


def unrouted_files(routes: DataFrame) -> DataFrame:
    """Files nobody owns, as rows: their number has no bound."""
    return routes.filter(F.col("persona").isNull()).select("run_id", "file")


def dispatch_summary(
    routes: DataFrame,
    persona_findings: DataFrame | None = None,
    failures: DataFrame | None = None,
    per_persona: int = FILES_PER_PERSONA,
) -> DataFrame:
    """Per run: personas to invoke, unrouted files, files past the limit of their persona, persona findings.

    ``failures(run_id, persona)`` names personas that were invoked and gave no report.
    """
    n = F.col("_n")
    out = routes.groupBy("run_id", "persona").agg(F.count(F.lit(1)).alias("_n")).groupBy("run_id").agg(
        # The sets are bounded by the persona list.
        F.sort_array(F.collect_set("persona")).alias("personas"),
        F.coalesce(F.sum(F.when(F.col("persona").isNull(), n)), F.lit(0)).alias("unrouted"),
        F.coalesce(F.sum(F.when(F.col("persona").isNotNull(), F.greatest(n - per_persona, F.lit(0)))), F.lit(0)).alias("remaining"),
    )
    if failures is not None:
        lost = failures.groupBy("run_id").agg(F.sort_array(F.collect_set("persona")).alias("failed_personas"))
        out = out.join(lost, "run_id", "left")
        out = out.withColumn("failed_personas", F.coalesce("failed_personas", F.array().cast("array<string>")))
    if persona_findings is None:
        return out.withColumn("persona_findings", F.lit(0).cast("long"))
    n = persona_findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("persona_findings"))
    return out.join(n, "run_id", "left").fillna(0, ["persona_findings"])
