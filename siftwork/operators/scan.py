"""Corpus scan: every rule on every line of every file."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftwork.functions import patterns, text as X
from siftwork.functions.paths import base_name, in_excluded_dir
from siftwork.functions.severity import known_or_p2
from siftwork.plans.lookup import lookup
from siftwork.plans.pin import let, pinned
from siftwork.schemas import SEVERITIES, as_findings

# Fixed value: larger files are not scanned.
MAX_FILE_BYTES = 1_000_000
EVIDENCE_CHARS = 240
DEFAULT_TITLE = "Forbidden policy pattern matched"


class Rule(NamedTuple):
    pattern: str
    severity: str = "P2"
    message: str = ""
    in_glob: str | None = None
    behavior: str = "deny"


def _severity(rule: Rule) -> str:
    word = (rule.severity or "P2").strip().upper()
    return word if word in SEVERITIES else "P2"


def scannable(files: DataFrame, excluded: Sequence[str] | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files of ``(file, size, ...)`` inside the size limit and outside excluded directories.

    ``too_large`` has the files beyond the limit; give them to ``skipped_findings``.
    """
    return _outside(files, excluded).filter(F.col("size") <= max_bytes)


def too_large(files: DataFrame, excluded: Sequence[str] | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    return _outside(files, excluded).filter(F.col("size") > max_bytes).withColumn("skipped", F.lit("too large"))


def _outside(files: DataFrame, excluded: Sequence[str] | None) -> DataFrame:
    args = (tuple(excluded),) if excluded is not None else ()
    return files.filter(~in_excluded_dir(F.col("file"), *args))


def skipped_findings(files: DataFrame) -> DataFrame:
    """One finding to look at per file of ``(run_id, file, skipped)`` that was not scanned; it counts as an ask."""
    return as_findings(
        files.filter(F.col("skipped").isNotNull()),
        gate_id=F.lit("policy"),
        tool=F.lit("forbid-patterns"),
        severity=F.lit("P2"),
        title=F.lit("File was not scanned"),
        description=F.concat(F.lit("File was not scanned: "), "skipped"),
        rule_id=F.lit("policy:not-scanned"),
        decision=F.lit("ask"),
    )


def _scoped(file: Column, glob: str | None) -> Column:
    if glob is None:
        return F.lit(True)
    return file.rlike(glob) | base_name(file).rlike(glob)


# A prepared rule inside the array of rules that a file meets.
_RULE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("pattern", "severity", "message", "behavior", "regex", "glob", "literal", "loose", "key")]
    + [T.StructField("rule_no", T.LongType()), T.StructField("gate", T.BooleanType())]
)


# From so many rules on, the texts are first looked through for the rules' required texts, all at once.
INDEXED_RULES = 16
NO_KEY = "(?!)()"


def _matched(files: DataFrame, rules: Column, index: Column | None = None) -> DataFrame:
    """``(run_id, file, line, line_text)`` and the rule, for every rule of the array that matches a line.

    One row per file and one per line of files that some rule can match, whatever the number of rules: the rules are
    elements of an array, so the plan does not grow with them and no text is copied per rule. ``index`` is a regex that
    finds the keys of all rules in one pass over a text; only rules whose key occurs, and those without one, are then tried.
    """
    text, file, line = F.col("text"), F.col("file"), F.col("line_text")

    def possible(r: Column) -> Column:
        scoped = r["glob"].isNull() | F.rlike(file, r["glob"]) | F.rlike(base_name(file), r["glob"])
        held = r["literal"].isNull() | text.contains(r["literal"])
        return scoped & held & (~r["gate"] | F.rlike(text, F.coalesce(r["loose"], r["regex"])))

    def hit(r: Column) -> Column:
        held = r["literal"].isNull() | line.contains(r["literal"])
        return held & (r["loose"].isNull() | F.rlike(line, r["loose"])) & F.rlike(line, r["regex"])

    candidates = rules
    if index is not None:
        keys = F.coalesce(F.array_distinct(F.regexp_extract_all(text, index, F.lit(1))), F.array().cast("array<string>"))
        keyless = F.filter(rules, lambda r: r["key"].isNull())

        def keyed(found: Column) -> Column:
            mine = F.filter(rules, lambda r: r["key"].isNotNull() & F.exists(found, lambda k: k.startswith(r["key"])))
            return F.when(F.size(found) > 0, F.concat(keyless, mine)).otherwise(keyless)

        candidates = let(keys, keyed)
    near = pinned(files, _near=F.filter(candidates, possible)).filter(F.size("_near") > 0)
    lines = X.explode_lines(near.select("run_id", "file", "text", "_near"), "text", "run_id", "file", "_near")
    found = pinned(lines, _hits=F.filter(F.col("_near"), hit)).filter(F.size("_hits") > 0)
    return found.select("run_id", "file", "line", "line_text", F.inline("_hits"))


def _finding_columns(rule_no: Column, pattern: Column, message: Column) -> dict[str, Column]:
    return {
        "seq": rule_no.cast("long"),
        "gate_id": F.lit("policy"),
        "tool": F.lit("forbid-patterns"),
        "title": F.coalesce(F.nullif(message, F.lit("")), F.lit(DEFAULT_TITLE)),
        "description": F.concat(F.lit("Configured forbid pattern matched: "), pattern),
        "rule_id": F.concat(F.lit("policy:forbid-pattern:"), rule_no.cast("string")),
        "evidence": F.left(X.strip(F.col("line_text")), F.lit(EVIDENCE_CHARS)),
        "decision": F.col("behavior"),
    }


def _rejected_columns(policy_file: str) -> dict[str, Column]:
    unsafe = F.col("reject_kind") == "unsafe-regex"
    no = F.col("rule_no").cast("string")
    lead = F.when(unsafe, " was rejected before scanning: ").otherwise(" failed to compile: ")
    return {
        "seq": F.col("rule_no").cast("long"),
        "gate_id": F.lit("policy"),
        "tool": F.lit("forbid-patterns"),
        "severity": F.lit("P1"),
        "file": F.lit(policy_file),
        "title": F.when(unsafe, "Unsafe policy forbid pattern").otherwise("Invalid policy forbid pattern"),
        "description": F.concat(F.lit("Pattern "), no, lead, F.col("reject_reason")),
        "rule_id": F.concat_ws(":", F.lit("policy:forbid-pattern"), no, F.col("reject_kind")),
        "decision": F.lit("deny"),
    }


def scan_rules(files: DataFrame, rules: Sequence[Rule], policy_file: str = "policy.yaml") -> DataFrame:
    """Findings of one rule list on all files of ``(run_id, file, text)``.

    The rules are one literal of the plan, so one corpus pass serves all of them, nothing is joined and
    no row is shuffled. Many rules are indexed by the texts that their matches must hold, so a file meets those only whose
    text it has. A file is split into lines only if some rule can match its text; inside, a
    rule's fixed text is looked for before its regex runs. A rule that cannot be used becomes a denying
    finding of every run and leaves the others as they are.
    """
    jvm = files.sparkSession._jvm
    prepared = _checked(jvm, [patterns.prepare(r.pattern.strip(), r.in_glob) for r in rules])
    good = [(i, r, p) for i, (r, p) in enumerate(zip(rules, prepared), 1) if p.reject_kind is None]
    bad = [(i, p) for i, p in enumerate(prepared, 1) if p.reject_kind is not None]
    if not rules:
        raise ValueError("no rules")
    table = [
        {
            "rule_no": i, "pattern": r.pattern.strip(), "severity": _severity(r), "message": r.message, "behavior": r.behavior,
            "regex": p.regex, "glob": p.glob, "literal": p.literal, "loose": p.loose, "gate": p.gate,
            "key": patterns.index_key(p.literal),
        }
        for i, r, p in good
    ]
    keys = sorted({r["key"] for r in table if r["key"]})
    index = F.lit(patterns.any_key_regex(keys)) if len(keys) >= INDEXED_RULES else None
    # One literal, whatever the number of rules.
    found = _matched(files, F.from_json(F.lit(json.dumps(table)), T.ArrayType(_RULE)), index)
    out = as_findings(found, **_finding_columns(F.col("rule_no"), F.col("pattern"), F.col("message")))
    if not bad:
        return out
    rows = F.inline(F.from_json(F.lit(json.dumps([{"rule_no": i, "reject_kind": p.reject_kind, "reject_reason": p.reject_reason} for i, p in bad])), "array<struct<rule_no:bigint,reject_kind:string,reject_reason:string>>"))
    runs = files.select("run_id").distinct().select("run_id", rows)
    return out.unionByName(as_findings(runs, **_rejected_columns(policy_file)))


def _refused(compile_, patterns_: Sequence[str]) -> dict[str, str]:
    """Those of the patterns that the scan's regex engine refuses, with its reason.

    Each is well-formed by itself, so many are tried as alternatives of one; only where that fails are they tried in halves.
    """
    try:
        if patterns_:
            compile_("|".join(f"(?:{p})" for p in patterns_) if len(patterns_) > 1 else patterns_[0])
        return {}
    except (Py4JJavaError, IllegalArgumentException) as exc:
        if len(patterns_) == 1:
            return {patterns_[0]: str(exc).splitlines()[0]}
    half = len(patterns_) // 2
    return _refused(compile_, patterns_[:half]) | _refused(compile_, patterns_[half:])


def _checked(jvm, rules: Sequence[patterns.Prepared]) -> list[patterns.Prepared]:
    """The rules, those rejected of which the scan's regex engine refuses a pattern."""
    used = sorted({x for p in rules for x in (p.regex, p.glob, p.loose) if x is not None})
    refused = _refused(jvm.java.util.regex.Pattern.compile, used)
    if not refused:
        return list(rules)
    reasons = [next((refused[x] for x in (p.regex, p.glob, p.loose) if x in refused), None) for p in rules]
    return [p if why is None else patterns.Prepared("invalid-regex", why) for p, why in zip(rules, reasons)]


_PREPARED = "reject_kind string, reject_reason string, regex string, glob string, literal string, loose string, gate boolean, key string"


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Check and translate the rules of ``(run_id, rule_no, pattern, severity, message, in_glob, behavior)``.

    Python sees rules in a scan, never corpus lines.
    """
    prepare = patterns.prepare

    def run(pattern: pd.Series, glob: pd.Series) -> pd.DataFrame:
        rows = [prepare(p, g or None) for p, g in zip(pattern, glob)]
        out = pd.DataFrame(rows, columns=list(patterns.Prepared._fields))
        return out.assign(key=[patterns.index_key(x.literal) for x in rows])

    udf = F.pandas_udf(run, _PREPARED)
    named = rules.withColumn("pattern", X.strip(F.col("pattern"))).filter(F.col("pattern") != "")
    out = pinned(named, _p=udf("pattern", F.coalesce("in_glob", F.lit("")))).select("*", "_p.*").drop("_p")
    # What the scan's regex engine refuses fails its rule, not the scan.
    refused = F.lit(False)
    for name in ("regex", "glob", "loose"):
        compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col(name))
        refused = refused | (F.col(name).isNotNull() & compiled.isNull())
    out = pinned(out, _refused=refused)
    kind = F.when(F.col("_refused"), "invalid-regex").otherwise(F.col("reject_kind"))
    reason = F.when(F.col("_refused"), "pattern is not supported by the scan").otherwise(F.col("reject_reason"))
    return out.withColumns({"reject_kind": kind, "reject_reason": reason}).drop("_refused")


def rejected_rules(prepared: DataFrame, policy_file: str = "policy.yaml") -> DataFrame:
    """One denying finding per rule that was not fit to scan with."""
    return as_findings(prepared.filter(F.col("reject_kind").isNotNull()), **_rejected_columns(policy_file))


def scan_run_rules(files: DataFrame, rules: DataFrame, policy_file: str = "policy.yaml") -> DataFrame:
    """Findings where every run brings its own rules, any number of runs.

    A run's rules are one array, so a file meets them in one joined row and its lines are made once. Spark broadcasts the
    arrays when they are small; else the files of a run go to several places, each with a copy of its array.
    """
    prepared = prepare_rules(rules)
    good = prepared.filter(F.col("reject_kind").isNull()).withColumn("severity", known_or_p2(F.col("severity")))
    listed = good.groupBy("run_id").agg(F.collect_list(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _RULE])).alias("_rules"))
    # A run with few rules has an index that finds nothing, and all its rules are tried.
    def index_of(keys: pd.Series) -> pd.Series:
        return pd.Series([patterns.any_key_regex(sorted(set(k))) if len(k) >= INDEXED_RULES else NO_KEY for k in keys])

    keys = F.filter(F.transform("_rules", lambda r: r["key"]), lambda k: k.isNotNull())
    listed = pinned(listed, _index=F.pandas_udf(index_of, "string")(keys))
    few = F.col("_index") == NO_KEY
    listed = listed.withColumn("_rules", F.when(few, F.transform("_rules", lambda r: r.withField("key", F.lit(None).cast("string")))).otherwise(F.col("_rules")))
    met = lookup(files.select("run_id", "file", "text"), listed, ["run_id"], "inner")
    found = _matched(met, F.col("_rules"), F.col("_index"))
    hits = as_findings(found, **_finding_columns(F.col("rule_no"), F.col("pattern"), F.col("message")))
    return hits.unionByName(rejected_rules(prepared, policy_file))
