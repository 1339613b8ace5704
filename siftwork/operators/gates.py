"""Counts, verdicts, ranked reports and merged feeds, many runs at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siftwork.functions import severity as S, variants as V
from siftwork.functions.numbers import whole_int
from siftwork.functions.text import first_text, permalink, shorten, strip
from siftwork.operators.normalize import gate_of, parse_failed, report_outcomes
from siftwork.plans.carry import next_known
from siftwork.plans.lookup import lookup
from siftwork.plans.ranking import first_per_group, top_per_group
from siftwork.schemas import FINDING_COLUMNS, SEVERITIES, as_findings

TOP_LIMIT = 10


# ---- unions ----


def combine(*parts: DataFrame) -> DataFrame:
    """All findings of all producers; duplicates stay."""
    return reduce(DataFrame.unionByName, [as_findings(p) for p in parts])


def run_custom_gate(df: DataFrame, gate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Findings of a user's gate, any function of DataFrame to DataFrame, held to the schema."""
    out = gate(df)
    missing = [c for c in ("run_id", "gate_id", "tool", "severity", "file", "title") if c not in out.columns]
    if missing:
        raise ValueError(f"gate output lacks {', '.join(missing)}")
    extra = [c for c in out.columns if c not in FINDING_COLUMNS]
    if extra:
        raise ValueError(f"gate output has unknown columns {', '.join(extra)}")
    return as_findings(out)


# ---- counts and verdicts ----


def _count_columns(severity: Column) -> list[Column]:
    return [F.count_if(severity == s).alias(s.lower()) for s in SEVERITIES]


def severity_counts(findings: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """``p0..p3`` per key; zeros stay and unknown severities are not counted."""
    return findings.groupBy(*keys).agg(*_count_columns(F.upper(strip(F.coalesce("severity", F.lit(""))))))


def grouped_counts(findings: DataFrame) -> DataFrame:
    """Counts by (run, severity) and by (run, gate) from one pass."""
    return (
        findings.groupingSets(
            [["run_id", "severity"], ["run_id", "gate_id"]], "run_id", "severity", "gate_id"
        )
        .agg(F.grouping("severity").alias("by_gate"), F.count(F.lit(1)).alias("n"))
        .select("run_id", "severity", "gate_id", "by_gate", "n")
    )


def run_verdicts(runs: DataFrame, findings: DataFrame, threshold: str = "P1", errors: DataFrame | None = None) -> DataFrame:
    """Per run: counts, ask count, blocking flag and verdict; runs without findings are kept.

    ``errors(run_id)`` names runs with a gate that failed: with nothing blocking they are ``error``,
    not ``passed``.
    """
    per_run = findings.groupBy("run_id").agg(
        *_count_columns(F.col("severity")),
        F.count_if(F.col("decision") == "ask").alias("ask_count"),
        F.bool_or(S.is_blocking(F.col("severity"), F.col("decision"), threshold)).alias("blocking"),
    )
    out = runs.select("run_id").distinct().join(per_run, "run_id", "left")
    numbers = {c: F.coalesce(c, F.lit(0)) for c in [*(s.lower() for s in SEVERITIES), "ask_count"]}
    out = out.withColumns({**numbers, "blocking": F.coalesce("blocking", F.lit(False))})
    if errors is not None:
        failed = errors.select("run_id").distinct().withColumn("_failed", F.lit(True))
        out = out.join(failed, "run_id", "left")
    else:
        out = out.withColumn("_failed", F.lit(None).cast("boolean"))
    return out.withColumn(
        "verdict",
        F.when(F.col("blocking"), "blocked").when(F.col("_failed"), "error").otherwise("passed"),
    ).drop("_failed")


def blocking_matrix(findings: DataFrame, gates: Sequence[str], keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Blocking total of every run at every gate setting, from one count per run."""
    counts = severity_counts(findings, keys)
    cols = {s: F.col(s.lower()) for s in SEVERITIES}
    settings = F.explode(
        F.array(*[F.struct(F.lit(g).alias("gate"), S.blocking_total(g, cols).alias("blocking")) for g in gates])
    )
    return counts.select(*keys, settings.alias("_g")).select(*keys, "_g.*")


def latest_status(samples: DataFrame) -> DataFrame:
    """Last status sample per run of ``(run_id, seq, status, progress, counts MAP)``.

    Progress falls back to the status; counts are those of the last sample that has any.
    """
    status = F.lower(strip(first_text(F.col("status"), F.lit("queued"))))
    tidy = samples.withColumn("status", status).withColumn(
        "progress", first_text(strip(F.coalesce("progress", F.lit(""))), status)
    )
    return tidy.groupBy("run_id").agg(
        F.max("seq").alias("seq"),
        F.max_by("status", "seq").alias("status"),
        F.max_by("progress", "seq").alias("progress"),
        F.max_by("counts", F.when(F.col("counts").isNotNull(), F.col("seq"))).alias("counts"),
    )


def is_terminal(status: Column) -> Column:
    s = F.lower(strip(F.coalesce(status, F.lit(""))))
    return s.isin("completed", "failed", "error", "cancelled", "blocked")


def bridge_verdicts(findings: DataFrame, status: DataFrame, gate: str = "P1", parity: bool = False) -> DataFrame:
    """Verdict per run of ``status(run_id, status, waited)``, with the bridge's blocking rule.

    Counts cover all findings; those whose ``decision`` is ``ask`` or ``allow`` do not block. With
    ``parity`` the decision is not looked at.
    """
    severity = F.upper(strip(F.coalesce("severity", F.lit(""))))
    free = F.lit(False)
    if "decision" in findings.columns and not parity:
        free = F.coalesce(F.col("decision").isin("ask", "allow"), F.lit(False))
    counts = findings.groupBy("run_id").agg(
        *_count_columns(severity), *[F.count_if((severity == s) & ~free).alias(f"_{s}") for s in SEVERITIES]
    )
    out = status.join(counts, "run_id", "left").fillna(0, [*(s.lower() for s in SEVERITIES), *(f"_{s}" for s in SEVERITIES)])
    total = S.blocking_total(gate, {s: F.col(f"_{s}") for s in SEVERITIES})
    return out.withColumn("blocking", total).drop(*(f"_{s}" for s in SEVERITIES)).withColumn(
        "verdict", S.verdict(F.col("blocking"), F.col("waited"), F.col("status"))
    )


def run_timeouts(triggers: DataFrame, samples: DataFrame, wait_seconds: int = 900, span_seconds: int = 3600) -> DataFrame:
    """Per trigger: the first terminal status at or after it, and whether that came within the wait limit.

    Ends before a trigger belong to something else. One row per trigger; a run's triggers and ends are ordered together,
    so a trigger is not paired with every end, and in buckets of ``span_seconds``, so a run of any length is spread.
    """
    starts = triggers.select("run_id", F.col("started_at").alias("_at"), F.lit(True).alias("_start"))
    ends = samples.filter(is_terminal(F.col("status"))).select("run_id", F.col("ts").alias("_at"), F.lit(False).alias("_start"))
    both = starts.unionByName(ends).withColumn("_us", F.unix_micros(F.col("_at").cast("timestamp")))
    # A trigger sorts before an end of the same moment.
    ended = F.when(~F.col("_start"), F.col("_at"))
    ordered = next_known(both, "run_id", "_us", [F.col("_at"), F.desc("_start")], ended, "ended_at", span_seconds * 1_000_000)
    limit = F.col("started_at") + F.make_dt_interval(secs=F.lit(wait_seconds))
    found = ordered.filter("_start").select("run_id", F.col("_at").alias("started_at"), "ended_at")
    return found.withColumn("timed_out", F.coalesce(F.col("ended_at") > limit, F.lit(True)))


# ---- ranked report ----


def locator(scope: Column | None = None, **fields: Column) -> tuple[Column, Column]:
    """Path and line of a loose finding: the scope's fields first, then the row's own."""

    def get(name: str) -> Column:
        return fields.get(name, F.lit(None).cast("string"))

    def in_scope(name: str) -> Column:
        return V.text_at(scope, f"$.{name}") if scope is not None else F.lit(None).cast("string")

    path = first_text(in_scope("path"), in_scope("file"), get("file"), get("path"), get("filename"), F.lit("repo"))
    line = F.coalesce(
        *[
            F.nullif(F.nullif(c.cast("string"), F.lit("")), F.lit("0"))
            for c in (
                in_scope("line_start"), in_scope("lineStart"), in_scope("line"), get("line"), get("line_start"),
            )
        ]
    )
    return (
        first_text(strip(path), F.lit("repo")),
        F.greatest(F.lit(0), F.coalesce(whole_int(line), F.lit(0))),
    )


def top_findings(findings: DataFrame, limit: int = TOP_LIMIT) -> DataFrame:
    """First findings per run by severity, file and line, with ``rank``."""
    order = [S.rank(F.upper(F.col("severity"))), F.col("file"), F.col("line")]
    ties = [F.col(c) for c in ("seq", "rule_id", "title", "evidence") if c in findings.columns]
    return top_per_group(findings, ["run_id"], [*order, *ties], limit, rank="rank")


def omitted_counts(findings: DataFrame, limit: int = TOP_LIMIT) -> DataFrame:
    """How many findings of a run a ranked report leaves out."""
    n = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("run_id", "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("omitted"))


def report_rows(top: DataFrame, repo: Column, commit: Column) -> DataFrame:
    """Display columns of ranked findings: shortened texts, locator and link.

    Takes findings and loose rows alike: ``category`` goes before the tool, and ``impact`` is shown where there is one.
    """

    def own(name: str) -> Column:
        return F.col(name) if name in top.columns else F.lit(None).cast("string")

    return top.select(
        "run_id",
        "rank",
        first_text(F.upper(strip(F.col("severity"))), F.lit("P3")).alias("severity"),
        F.when(F.col("line") > 0, F.concat_ws(":", "file", "line")).otherwise(F.col("file")).alias("locator"),
        permalink(repo, commit, F.col("file"), F.col("line")).alias("link"),
        shorten(first_text(F.col("title"), F.col("description"), F.lit("Finding"))).alias("title"),
        shorten(first_text(own("category"), own("tool"), own("gate_id"), F.lit("review")), 80).alias("category"),
        shorten(own("impact"), 220).alias("impact"),
        shorten(F.col("recommended_fix"), 240).alias("fix"),
    )


# ---- merged feeds ----


def loose_findings(rows: DataFrame) -> DataFrame:
    """Fields of external findings ``(run_id, seq, raw VARIANT)`` that merging and reports need, and the whole row.

    The columns from ``title`` on are those of ``report_rows``; an empty severity is P3 there.
    """
    raw = F.col("raw")
    path, line = locator(
        F.try_variant_get(raw, "$.scope", "variant"),
        **{k: V.text_at(raw, f"$.{k}") for k in ("file", "path", "filename", "line", "line_start")},
    )
    return rows.select(
        "run_id",
        "seq",
        first_text(V.text_at(raw, "$.severity"), F.lit("")).alias("severity"),
        first_text(V.text_at(raw, "$.category"), V.text_at(raw, "$.tool"), F.lit("")).alias("kind"),
        path.alias("file"),
        line.alias("line"),
        first_text(V.text_at(raw, "$.title"), V.text_at(raw, "$.message"), V.text_at(raw, "$.impact"), F.lit("")).alias(
            "title"
        ),
        strip(
            first_text(
                V.text_at(raw, "$.finding_fingerprint"), V.text_at(raw, "$.fingerprint"), V.text_at(raw, "$.finding_id")
            )
        ).alias("given"),
        first_text(V.text_at(raw, "$.category"), V.text_at(raw, "$.tool"), V.text_at(raw, "$.gateId"), V.text_at(raw, "$.gate_id")).alias("category"),
        V.text_at(raw, "$.description").alias("description"),
        V.text_at(raw, "$.impact").alias("impact"),
        first_text(
            V.text_at(raw, "$.remediation_guidance"), V.text_at(raw, "$.recommended_fix"), V.text_at(raw, "$.recommendedFix")
        ).alias("recommended_fix"),
        raw.alias("raw"),
    )


def fingerprint(given: Column, severity: Column, kind: Column, file: Column, line: Column, title: Column) -> Column:
    """The feed's own fingerprint, else severity, kind, path, line and title joined with bars."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (severity, kind, file, line, title)]
    return first_text(strip(given), F.concat_ws("|", *parts))


def merge_feeds(backend: DataFrame, local: DataFrame) -> DataFrame:
    """Both feeds of ``(run_id, seq, fingerprint, ...)``, first per fingerprint, backend before local."""
    ranked = backend.withColumn("feed_rank", F.lit(0)).unionByName(local.withColumn("feed_rank", F.lit(1)))
    order = ["feed_rank", "seq", *sorted(c for c in ("file", "line", "title") if c in ranked.columns)]
    return first_per_group(ranked, ["run_id", "fingerprint"], [F.col(c) for c in order])


def backend_or_local(backend: DataFrame, local: DataFrame) -> DataFrame:
    """Backend findings of a run if it has any, else its local ones."""
    covered = backend.select("run_id").distinct()
    return backend.unionByName(lookup(local, covered, ["run_id"], "left_anti"))


# ---- tools and gates ----


def _outcomes(reports: DataFrame, findings: DataFrame | None, by: str) -> DataFrame:
    """Per run and ``by`` (``tool`` or ``gate_id``): ``bad`` reports, the first tool with one, and ``n`` findings, the reports'
    own or those of ``findings``."""
    if findings is None:
        seen = report_outcomes(reports)
    else:
        bad = parse_failed(F.col("tool"), F.col("payload"))
        seen = reports.select("run_id", "tool", gate_of(F.col("tool")).alias("gate_id"), bad.alias("parse_error"), F.lit(0).alias("n"))
    out = seen.groupBy("run_id", by).agg(
        F.count_if("parse_error").alias("bad"),
        F.min(F.when(F.col("parse_error"), F.col("tool"))).alias("bad_tool"),
        F.sum("n").alias("n"),
    )
    if findings is None:
        return out
    return out.drop("n").join(findings.groupBy("run_id", by).agg(F.count(F.lit(1)).alias("n")), ["run_id", by], "left")


def tool_meta(reports: DataFrame, findings: DataFrame | None, switches: DataFrame) -> DataFrame:
    """Per run and tool of ``switches(run_id, tool, enabled)``: invoked, reason, finding count.

    Without ``findings`` the reports' own are counted, and each report is parsed once.
    """
    out = switches.join(_outcomes(reports, findings, "tool"), ["run_id", "tool"], "left")
    invoked = F.col("enabled") & F.col("bad").isNotNull()
    return out.select(
        "run_id",
        "tool",
        invoked.alias("invoked"),
        F.when(~F.col("enabled"), "disabled").when(F.col("bad").isNull(), "no-report").when(F.col("bad") > 0, "parse-error").alias("reason"),
        F.when(invoked, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("finding_count"),
    )


def gate_results(reports: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Status and finding count per run and gate; a report that does not parse makes its gate ``error``.

    One failing gate leaves the others as they are. Without ``findings`` the reports' own are counted, and each report is
    parsed once.
    """
    return _outcomes(reports, findings, "gate_id").filter(F.col("gate_id").isNotNull()).select(
        "run_id",
        "gate_id",
        F.when(F.col("bad") > 0, "error").otherwise("ok").alias("status"),
        F.coalesce("n", F.lit(0)).alias("finding_count"),
        F.concat(F.lit("unreadable report: "), "bad_tool").alias("error_message"),
    )
