"""Fix requests in comments: parse, admit, match to findings, plan."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siftwork.functions.paths import clean_file
from siftwork.functions.text import branch_slug, first_text, strip
from siftwork.operators.routing import KNOWN_PERSONAS
from siftwork.plans.lookup import lookup
from siftwork.plans.ranking import first_per_group, top_per_group

FIX_LIMIT = 3
BUDGET_USD = 2.0


def command_pattern(handle: str) -> str:
    return (
        rf"(?U)(?:^|\s){re.escape(handle)}\s+fix\s+([A-Za-z0-9._:/\-]+)"
        r"(?:\s+--persona\s+([A-Za-z0-9_\-]+))?(?:\s+--reason\s+([^\n]{1,200}))?"
    )


def parse_commands(
    comments: DataFrame, handle: str = "/gate", personas: Sequence[str] = KNOWN_PERSONAS
) -> DataFrame:
    """Comments of ``(build_id, seq, body)`` that ask for a fix, with id, persona override and reason."""
    pattern = command_pattern(handle)
    body = F.col("body")
    persona = F.lower(F.regexp_extract(body, pattern, 2))
    return comments.filter(body.contains(handle) & body.rlike(pattern)).select(
        *comments.columns,
        F.regexp_extract(body, pattern, 1).alias("finding_id"),
        F.when(persona.isin(*personas), persona).alias("persona_override"),
        F.nullif(strip(F.regexp_extract(body, pattern, 3)), F.lit("")).alias("reason"),
    )


def admit_fixes(
    requests: DataFrame, limit: int = FIX_LIMIT, attempted: DataFrame | None = None
) -> DataFrame:
    """Decision on each request of ``(build_id, seq, finding_id)``.

    Requests are taken in ``seq`` order: an id that was already accepted is a duplicate, and past
    ``limit`` accepted ids everything else is rate-limited. So the accepted ids of a build are its
    first ``limit`` distinct ids, which two partial aggregates find without ordering the build.
    ``attempted(build_id, finding_id)`` are ids accepted before; they count towards the limit.
    """
    first = requests.groupBy("build_id", "finding_id").agg(F.min("seq").alias("first_seq"))
    prior = None
    if attempted is not None:
        prior = attempted.select("build_id", "finding_id").distinct()
        used = prior.groupBy("build_id").agg(F.count(F.lit(1)).alias("_used"))
        fresh = first.join(prior, ["build_id", "finding_id"], "left_anti")
        ranked = top_per_group(fresh, ["build_id"], [F.col("first_seq")], limit, rank="_place")
        taken = ranked.join(used, "build_id", "left").filter(F.col("_place") + F.coalesce("_used", F.lit(0)) <= limit)
        winners = taken.select("build_id", "finding_id", "first_seq").unionByName(
            prior.withColumn("first_seq", F.lit(None).cast("long"))
        )
    else:
        winners = top_per_group(first, ["build_id"], [F.col("first_seq")], limit)
    return decided(requests, winners, limit)


def decided(requests: DataFrame, winners: DataFrame, limit: int = FIX_LIMIT) -> DataFrame:
    """Decisions on requests where the accepted ids of their builds are known, ``winners(build_id, finding_id, first_seq)``.

    The request with the first ``seq`` of an accepted id is accepted; it is null where that request lies in the past.
    """
    out = lookup(requests, winners.withColumn("_won", F.lit(True)), ["build_id", "finding_id"])
    won, now = F.col("_won").isNotNull(), F.coalesce(F.col("seq") == F.col("first_seq"), F.lit(False))
    name = F.col("finding_id")
    return (
        out.withColumn("accepted", won & now)
        .withColumn("already_attempted", won & ~now)
        .withColumn("rate_limited", ~won)
        .withColumn(
            "decision_reason",
            F.when(won & now, F.concat(F.lit("accepted fix "), name))
            .when(won, F.concat(F.lit("finding "), name, F.lit(" already attempted in this build")))
            .otherwise(F.lit(f"per-build fix limit ({limit}) reached")),
        )
        .drop("_won", "first_seq")
    )


def composite_id(gate_id: Column, file: Column, line: Column) -> Column:
    return F.concat_ws(":", gate_id, F.replace(file, F.lit("/"), F.lit("-")), line.cast("string"))


def finding_id(rule_id: Column, gate_id: Column, file: Column, line: Column) -> Column:
    """Rule id, else gate, file with dashes for separators, and line."""
    dashed = F.replace(file, F.lit("\\"), F.lit("-"))
    return first_text(rule_id, composite_id(gate_id, dashed, line))


_MATCHED = ("gate_id", "tool", "severity", "file", "line", "title", "description", "rule_id", "recommended_fix", "evidence")


def match_findings(requests: DataFrame, findings: DataFrame, key: str = "build_id") -> DataFrame:
    """The finding each request names: by rule id, else by composite id; first in feed order.

    ``findings`` has ``key`` too. Findings are reduced to one row per id before the join, so a rule
    with very many findings adds one row to it.
    """
    names = F.array(
        F.struct(F.lit(0).alias("key_rank"), F.nullif(F.col("rule_id"), F.lit("")).alias("finding_id")),
        F.struct(
            F.lit(1).alias("key_rank"),
            composite_id(F.col("gate_id"), F.col("file"), F.col("line")).alias("finding_id"),
        ),
    )
    named = findings.select(key, "seq", *_MATCHED, F.inline(names)).filter(F.col("finding_id").isNotNull())
    order = [F.col(c) for c in ("key_rank", "seq", "file", "line", "title")]
    index = first_per_group(named, [key, "finding_id"], order).withColumn("found", F.lit(True))
    out = lookup(requests, index.drop("seq", "key_rank"), [key, "finding_id"])
    return out.withColumn("found", F.coalesce("found", F.lit(False)))


def select_persona(override: Column, owner: Column, tool: Column, personas: Sequence[str] = KNOWN_PERSONAS) -> Column:
    """Override, else owner of the file, else the tool itself where it is a persona."""
    cs = [override, F.lower(strip(owner)), F.lower(strip(tool))]
    return F.coalesce(*[F.when(c.isin(*personas), c) for c in cs])


def prompt_context() -> Column:
    def shown(label: str, name: str) -> Column:
        return F.when(F.col(name) != "", F.concat(F.lit(label), F.col(name))).otherwise("")

    lines = [
        F.concat(F.lit("FINDING: "), F.col("title")),
        F.concat(F.lit("FILE: "), F.col("file"), F.lit(":"), F.col("line").cast("string")),
        F.concat(F.lit("SEVERITY: "), F.col("severity")),
        F.concat(F.lit("GATE: "), F.col("gate_id"), F.lit(" / "), F.col("tool")),
        shown("DESCRIPTION: ", "description"),
        shown("EVIDENCE: ", "evidence"),
        shown("RECOMMENDED FIX: ", "recommended_fix"),
    ]
    return strip(F.concat_ws("\n", *lines))


def plan_fixes(
    matched: DataFrame,
    ownership: DataFrame,
    base_branch: str = "main",
    branch_prefix: str = "fix",
    budget_usd: float = BUDGET_USD,
    key: str = "build_id",
) -> DataFrame:
    """Plan per matched request; ``ownership(key, file, persona)`` names the owners.

    ``status`` is ``rejected``, ``not_found``, ``no_owner`` or ``planned``; plan columns are null
    unless planned.
    """
    df = matched.withColumn("_file", clean_file(F.col("file")))
    owners = ownership.select(key, F.col("file").alias("_file"), F.col("persona").alias("_owner"))
    df = lookup(df, owners, [key, "_file"])
    persona = select_persona(F.col("persona_override"), F.col("_owner"), F.col("tool"))
    df = df.withColumn("persona", persona)
    status = (
        F.when(~F.col("accepted"), "rejected")
        .when(~F.col("found"), "not_found")
        .when(F.col("persona").isNull(), "no_owner")
        .otherwise("planned")
    )
    df = df.withColumn("status", status)
    planned = F.col("status") == "planned"
    fid = finding_id(F.col("rule_id"), F.col("gate_id"), F.col("file"), F.col("line"))
    return df.select(
        key,
        "seq",
        "finding_id",
        "status",
        F.when(planned, F.col("persona")).alias("persona"),
        F.when(planned, fid).alias("plan_finding_id"),
        F.when(planned & (F.col("_file") != ""), F.array("_file"))
        .when(planned, F.array().cast("array<string>"))
        .alias("files"),
        F.when(planned, prompt_context()).alias("prompt_context"),
        F.when(planned, F.concat_ws("/", F.lit(branch_prefix), F.col("persona"), branch_slug(fid))).alias("branch_name"),
        F.when(planned, F.lit(base_branch)).alias("base_branch"),
        F.when(planned, F.lit(float(budget_usd))).alias("token_budget_usd"),
    )
