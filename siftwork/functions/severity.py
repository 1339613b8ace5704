"""Severity ranks, blocking rules, verdicts and score bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from siftwork.functions.numbers import lenient_double, whole_long
from siftwork.functions.text import strip
from siftwork.schemas import SEVERITIES

UNKNOWN_RANK = 99


def rank(severity: Column, unknown: int = UNKNOWN_RANK) -> Column:
    out = F.lit(unknown)
    for i, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == s, i).otherwise(out)
    return out


def known_or_p2(severity: Column) -> Column:
    s = F.upper(strip(F.coalesce(severity, F.lit("P2"))))
    return F.when(s.isin(*SEVERITIES), s).otherwise("P2")


def blocks(severity: Column, threshold: Column | str) -> Column:
    """Severity at or above the threshold; ``never`` and unknown values do not block."""
    t = F.lit(threshold) if isinstance(threshold, str) else threshold
    return (t != "never") & (rank(severity) <= rank(t, -1))


def is_blocking(severity: Column, decision: Column, threshold: Column | str) -> Column:
    """``ask`` and ``allow`` never block; a null decision blocks by severity."""
    excused = F.coalesce(decision.isin("ask", "allow"), F.lit(False))
    return ~excused & F.coalesce(blocks(severity, threshold), F.lit(False))


def blocks_merge(severity: Column, gate: Column | str) -> Column:
    """Bridge rule: NONE, P0 and P2 as named, anything else means P0 and P1."""
    g = F.lit(gate) if isinstance(gate, str) else gate
    g = F.upper(strip(F.coalesce(F.nullif(g, F.lit("")), F.lit("P1"))))
    s = F.upper(strip(F.coalesce(severity, F.lit(""))))
    return (
        F.when(g == "NONE", F.lit(False))
        .when(g == "P0", s == "P0")
        .when(g == "P2", s.isin("P0", "P1", "P2"))
        .otherwise(s.isin("P0", "P1"))
    )


def blocking_total(gate: Column | str, counts: dict[str, Column]) -> Column:
    """Sum of the counts that the bridge rule blocks on."""
    parts = [F.when(blocks_merge(F.lit(s), gate), counts[s]).otherwise(0) for s in SEVERITIES]
    return reduce(lambda a, b: a + b, parts).cast("long")


def verdict(blocking: Column, waited: Column, status: Column) -> Column:
    failed = waited & status.isin("failed", "error", "cancelled")
    return (
        F.when(blocking > 0, "blocked").when(F.coalesce(failed, F.lit(False)), "error").otherwise("passed")
    )


def normal_counts(raw: Column, fallback: Column) -> dict[str, Column]:
    """Counts per severity: the map's value, else the fallback's, never below zero.

    A map that is present replaces the fallback whole; a bad number in it counts as zero.
    """
    def pick(m: Column, s: str) -> Column:
        return F.greatest(F.lit(0), F.coalesce(whole_long(F.try_element_at(m, F.lit(s))), F.lit(0)))

    return {s: F.when(raw.isNotNull(), pick(raw, s)).otherwise(pick(fallback, s)) for s in SEVERITIES}


def cvss_number(raw: Column) -> Column:
    """Score in a CVSS entry: last part between slashes that is a number from 0 to 10."""
    parts = F.transform(F.reverse(F.split(raw, "/")), lenient_double)
    in_band = F.filter(parts, lambda x: (x >= 0) & (x <= 10))
    return F.nanvl(F.coalesce(F.get(in_band, F.lit(0)), lenient_double(raw), F.lit(0.0)), F.lit(0.0))


def cvss_band(scores: Column) -> Column:
    """Severity of the highest score of an array of raw score texts; none usable is P2."""
    top = F.coalesce(F.array_max(F.transform(scores, cvss_number)), F.lit(0.0))
    return (
        F.when(top >= 9, "P0").when(top >= 7, "P1").when(top >= 4, "P2").when(top > 0, "P3").otherwise("P2")
    )


def result_line(status: Column, gate: Column, counts: dict[str, Column]) -> Column:
    """One line that states a run's result and counts."""
    label = F.when(status == "passed", "Passed").when(status == "blocked", "Blocked").otherwise("Errored")
    names = F.array_join(
        F.array_compact(F.array(*[F.when(blocks_merge(F.lit(s), gate), F.lit(s)) for s in SEVERITIES])), "/"
    )
    detail = (
        F.when((status == "passed") & (names != ""), F.concat(F.lit("no "), names, F.lit(" findings")))
        .when(status == "passed", "severity gate disabled")
        .otherwise(F.concat(blocking_total(gate, counts).cast("string"), F.lit(" blocking finding(s)")))
    )
    shown = F.concat_ws(", ", *[F.concat(F.lit(s + "="), counts[s].cast("string")) for s in SEVERITIES])
    return F.concat(
        F.lit("Result: "), label, F.lit(" (severity_gate="), gate, F.lit("): "), detail, F.lit(". Counts: "), shown
    )
