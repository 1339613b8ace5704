"""Tool reports to findings.

Each tool has one expression from the report text to an array of finding structs, so that a mixed
report table is parsed in a single narrow pass: pick the expression by tool, explode, project.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from siftwork.functions import variants as V
from siftwork.functions.numbers import whole_int
from siftwork.functions.paths import clean_file, posix_path
from siftwork.functions.severity import cvss_band
from siftwork.functions.text import explode_lines, first_text, strip, stripped_lines
from siftwork.plans.pin import exploded, let, pinned
from siftwork.schemas import as_findings

_ITEM = "array<struct<severity:string,file:string,line:int,title:string,rule_id:string>>"

# Each tool's own severity words.
SEMGREP_LEVELS = {"ERROR": "P1", "WARNING": "P2", "INFO": "P3"}
CHECKOV_LEVELS = {"CRITICAL": "P0", "HIGH": "P1", "MEDIUM": "P2", "LOW": "P3"}
TFLINT_LEVELS = {"error": "P1", "warning": "P2", "notice": "P3", "info": "P3"}


def _item(severity: Column, file: Column, line: Column, title: Column, rule_id: Column) -> Column:
    return F.struct(
        severity.alias("severity"),
        file.alias("file"),
        F.coalesce(line, F.lit(0)).cast("int").alias("line"),
        title.alias("title"),
        rule_id.alias("rule_id"),
    )


def _level(word: Column, levels: dict[str, str]) -> Column:
    out = F.lit("P2")
    for name, severity in levels.items():
        out = F.when(word == name, severity).otherwise(out)
    return out


def _word(v: Column, path: str, default: Column) -> Column:
    """Trimmed text at ``path``; ``default`` only where the key is missing or null."""
    return strip(F.coalesce(V.text_at(v, path), default))


def _named(v: Column, path: str) -> Column:
    return F.coalesce(V.first_text_at(v, path), F.lit("unknown"))


# ---- text reports ----

_TSC = r"^(.*?)\(([0-9]+)(?:,[0-9]+)*\): (error|warning) (TS[^:]*):(.*)$"
# Location ends at the first closing parenthesis of the line, as a strict reading has it.
_TSC_PARITY = r"^([^)]*)\(([0-9]+)(?:,[^(),]*)*\): (error|warning) (TS[^:]*):(.*)$"


def tsc_items(payload: Column, parity: bool = False) -> Column:
    pattern = _TSC_PARITY if parity else _TSC
    hits = F.filter(stripped_lines(payload), lambda x: x.rlike(pattern))
    return F.transform(
        hits,
        lambda x: _item(
            F.when(F.regexp_extract(x, pattern, 3) == "error", "P1").otherwise("P2"),
            posix_path(F.regexp_extract(x, pattern, 1)),
            whole_int(F.regexp_extract(x, pattern, 2)),
            strip(F.regexp_extract(x, pattern, 5)),
            F.concat(F.lit("tsc:"), F.regexp_extract(x, pattern, 4)),
        ),
    )


def prettier_items(payload: Column) -> Column:
    warned = F.filter(stripped_lines(payload), lambda x: x.startswith("[warn]"))
    files = F.filter(
        F.transform(warned, lambda x: strip(F.substring(x, 7, 2_000_000_000))),
        lambda x: (x != "") & ~x.startswith("Code style issues"),
    )
    return F.transform(
        files,
        lambda x: _item(
            F.lit("P2"),
            posix_path(x),
            F.lit(0),
            F.lit("Prettier formatting differences"),
            F.lit("prettier:unformatted"),
        ),
    )


_TAGGED = r"(?s)^(.*)\[([^\[]*)\]\z"


def actionlint_items(payload: Column) -> Column:
    parts = F.transform(stripped_lines(payload), lambda x: F.split(x, ":", 4))
    good = F.filter(parts, lambda p: (F.size(p) == 4) & whole_int(F.get(p, F.lit(1))).isNotNull())

    def one(p: Column) -> Column:
        rest = strip(F.get(p, F.lit(3)))
        tag = F.nullif(strip(F.regexp_extract(rest, _TAGGED, 2)), F.lit(""))
        return _item(
            F.lit("P2"),
            posix_path(F.get(p, F.lit(0))),
            whole_int(F.get(p, F.lit(1))),
            F.when(rest.rlike(_TAGGED), strip(F.regexp_extract(rest, _TAGGED, 1))).otherwise(rest),
            F.concat(F.lit("actionlint:"), F.coalesce(tag, F.lit("unknown"))),
        )

    return F.transform(good, one)


# ---- JSON reports ----


def eslint_items(doc: Column) -> Column:
    reports = V.objects(V.array_at(doc))

    def per_file(r: Column) -> Column:
        file = posix_path(F.coalesce(V.text_at(r, "$.filePath"), F.lit("")))
        return F.transform(
            V.objects(V.array_at(r, "$.messages")),
            lambda m: _item(
                F.when(F.coalesce(V.int_at(m, "$.severity"), F.lit(1)) >= 2, "P1").otherwise("P2"),
                file,
                V.int_at(m, "$.line"),
                F.coalesce(V.text_at(m, "$.message"), F.lit("")),
                F.concat(F.lit("eslint:"), first_text(V.text_at(m, "$.ruleId"), F.lit("unknown"))),
            ),
        )

    return F.flatten(F.transform(reports, per_file))


def gitleaks_items(doc: Column) -> Column:
    return F.transform(
        V.objects(V.array_at(doc)),
        lambda r: _item(
            F.lit("P0"),
            _word(r, "$.File", F.lit("")),
            V.int_at(r, "$.StartLine"),
            _word(r, "$.Description", F.lit("Potential secret")),
            F.concat(F.lit("gitleaks:"), _named(r, "$.RuleID")),
        ),
    )


def semgrep_items(doc: Column) -> Column:
    def one(r: Column) -> Column:
        check = _word(r, "$.check_id", F.lit("unknown"))
        level = F.upper(F.coalesce(V.text_at(r, "$.extra.severity"), F.lit("WARNING")))
        return _item(
            _level(level, SEMGREP_LEVELS),
            _word(r, "$.path", F.lit("")),
            V.int_at(r, "$.start.line"),
            _word(r, "$.extra.message", check),
            F.concat(F.lit("semgrep:"), check),
        )

    return F.transform(V.objects(V.array_at(doc, "$.results")), one)


def osv_items(doc: Column) -> Column:
    def per_result(r: Column) -> Column:
        file = _word(r, "$.source.path", F.lit(""))

        def per_package(p: Column) -> Column:
            name = _word(p, "$.package.name", F.lit(""))

            def per_vulnerability(u: Column) -> Column:
                ident = _named(u, "$.id")
                summary = _word(u, "$.summary", ident)
                scores = F.transform(
                    V.objects(V.array_at(u, "$.severity")),
                    lambda s: F.coalesce(V.text_at(s, "$.score"), F.lit("")),
                )
                return _item(
                    cvss_band(scores),
                    file,
                    F.lit(0),
                    F.when(name != "", F.concat(name, F.lit(": "), summary)).otherwise(summary),
                    F.concat(F.lit("osv:"), ident),
                )

            return F.transform(V.objects(V.array_at(p, "$.vulnerabilities")), per_vulnerability)

        return F.flatten(F.transform(V.objects(V.array_at(r, "$.packages")), per_package))

    return F.flatten(F.transform(V.objects(V.array_at(doc, "$.results")), per_result))


def checkov_items(doc: Column) -> Column:
    v = doc
    blocks = V.objects(F.when(V.is_object(v), F.array(v)).otherwise(V.array_at(v)))

    def one(c: Column) -> Column:
        check = _word(c, "$.check_id", F.lit("unknown"))
        level = F.upper(first_text(V.text_at(c, "$.severity"), F.lit("MEDIUM")))
        return _item(
            _level(level, CHECKOV_LEVELS),
            strip(F.ltrim(F.coalesce(V.text_at(c, "$.file_path"), F.lit("")), F.lit("/"))),
            F.when(V.is_whole(c, "$.file_line_range[0]"), V.int_at(c, "$.file_line_range[0]")),
            _word(c, "$.check_name", check),
            F.concat(F.lit("checkov:"), check),
        )

    checks = F.flatten(F.transform(blocks, lambda b: V.objects(V.array_at(b, "$.results.failed_checks"))))
    return F.transform(checks, one)


def tflint_items(doc: Column) -> Column:
    def one(i: Column) -> Column:
        rule = _word(i, "$.rule.name", F.lit("unknown"))
        level = F.lower(first_text(V.text_at(i, "$.rule.severity"), F.lit("warning")))
        return _item(
            _level(level, TFLINT_LEVELS),
            _word(i, "$.range.filename", F.lit("")),
            V.int_at(i, "$.range.start.line"),
            _word(i, "$.message", rule),
            F.concat(F.lit("tflint:"), rule),
        )

    return F.transform(V.objects(V.array_at(doc, "$.issues")), one)


# tool name -> (gate, items expression of the text or, for a JSON report, of its VARIANT, report is JSON)
TOOLS: dict[str, tuple[str, Callable[[Column], Column], bool]] = {
    "tsc": ("static", tsc_items, False),
    "eslint": ("static", eslint_items, True),
    "prettier": ("static", prettier_items, False),
    "gitleaks": ("security", gitleaks_items, True),
    "semgrep": ("security", semgrep_items, True),
    "osv-scanner": ("security", osv_items, True),
    "actionlint": ("security", actionlint_items, False),
    "checkov": ("security", checkov_items, True),
    "tflint": ("security", tflint_items, True),
}


def _is_json(tool: Column) -> Column:
    return tool.isin(*[name for name, (_, _, is_json) in TOOLS.items() if is_json])


def _unreadable(tool: Column, payload: Column, doc: Column) -> Column:
    bad = doc.isNull() | ((tool == "eslint") & ~V.is_array(doc))
    return F.coalesce(_is_json(tool) & (strip(payload) != "") & bad, F.lit(False))


def parse_failed(tool: Column, payload: Column) -> Column:
    """A JSON tool's report that is neither blank nor JSON. It is an error, not zero findings."""
    return F.when(_is_json(tool), let(V.parse(payload), lambda v: _unreadable(tool, payload, v))).otherwise(F.lit(False))


def gate_of(tool: Column) -> Column:
    """Gate that a tool belongs to; null for an unknown tool."""
    out = F.lit(None).cast("string")
    for name, (gate, _, _) in TOOLS.items():
        out = F.when(tool == name, gate).otherwise(out)
    return out


def _items(tool: str, parity: bool = False, doc: Column | None = None) -> Column:
    """The items of one tool's reports; ``doc`` is the parsed report where there is one already."""
    _, build, is_json = TOOLS[tool]
    if is_json:
        return build(V.parse(F.col("payload")) if doc is None else doc)
    return tsc_items(F.col("payload"), parity) if tool == "tsc" else build(F.col("payload"))


def _items_by_tool(parity: bool = False, doc: Column | None = None) -> Column:
    items = F.lit(None).cast(_ITEM)
    for name in TOOLS:
        items = F.when(F.col("tool") == name, _items(name, parity, doc).cast(_ITEM)).otherwise(items)
    return items


def normalize_reports(reports: DataFrame, parity: bool = False) -> DataFrame:
    """Findings of every report of ``(run_id, tool, payload)``, all tools in one pass.

    ``seq`` is the position inside the report.
    """
    rows = exploded(reports, ["run_id", "tool"], _items_by_tool(parity), "seq", "_item")
    return as_findings(
        rows.select("run_id", "tool", "seq", "_item.*"), gate_id=gate_of(F.col("tool"))
    )


def report_outcomes(reports: DataFrame, parity: bool = False) -> DataFrame:
    """``(run_id, tool, gate_id, parse_error, n)`` of every report: whether it is unreadable and how many findings it has.

    Each report is parsed once for both.
    """
    rows = pinned(reports.select("run_id", "tool", "payload"), _doc=F.when(_is_json(F.col("tool")), V.parse(F.col("payload"))))
    doc = F.col("_doc")
    return rows.select(
        "run_id",
        "tool",
        gate_of(F.col("tool")).alias("gate_id"),
        _unreadable(F.col("tool"), F.col("payload"), doc).alias("parse_error"),
        F.coalesce(F.size(_items_by_tool(parity, doc)), F.lit(0)).cast("long").alias("n"),
    )


def normalize_tool(reports: DataFrame, tool: str, parity: bool = False) -> DataFrame:
    """Findings of one tool's reports."""
    rows = exploded(reports.filter(F.col("tool") == tool), ["run_id", "tool"], _items(tool, parity), "seq", "_item")
    return as_findings(rows.select("run_id", "tool", "seq", "_item.*"), gate_id=F.lit(TOOLS[tool][0]))


def persona_candidates(reports: DataFrame) -> DataFrame:
    """Candidate rows of persona reports, ready for the judge contract; rows without file are dropped.

    Input ``(run_id, tool, payload)`` with the persona as ``tool``.
    """
    v = V.parse(F.col("payload"))
    rows = exploded(reports, ["run_id", "tool"], V.objects(V.json_list(v)), "seq", "raw")
    raw = F.col("raw")
    return (
        rows.withColumn("file", clean_file(V.text_at(raw, "$.file")))
        .filter(F.col("file") != "")
        .select(
            "run_id",
            "seq",
            "tool",
            "raw",
            "file",
            first_text(V.text_at(raw, "$.severity"), F.lit("P2")).alias("severity"),
            strip(first_text(V.text_at(raw, "$.title"), V.text_at(raw, "$.message"), F.lit(""))).alias("title"),
            strip(first_text(V.text_at(raw, "$.rootCause"), V.text_at(raw, "$.description"), F.lit(""))).alias(
                "description"
            ),
            first_text(V.text_at(raw, "$.recommendedFix"), V.text_at(raw, "$.recommended_fix")).alias(
                "recommended_fix"
            ),
        )
    )


# ---- sandbox logs ----

# Log markers of blocked actions, in test order, per platform.
SANDBOX_MARKERS = {
    "linux": (
        ("operation not permitted", "fs_write"),
        ("permission denied", "fs_read"),
        ("network is unreachable", "network"),
        ("address family not supported", "network"),
    ),
    "macos": (
        ("deny file-write", "fs_write"),
        ("deny file-read", "fs_read"),
        ("deny network", "network"),
    ),
}


def sandbox_violations(logs: DataFrame, platform: str = "linux") -> DataFrame:
    """Blocked actions named in log text of ``(run_id, payload)``, one row per matching line."""
    lines = explode_lines(logs, "payload", "run_id").withColumn("raw_line", strip(F.col("line_text"))).drop("line_text")
    found = F.lit(None).cast("string")
    for marker, kind in reversed(SANDBOX_MARKERS[platform]):
        found = F.when(F.lower("raw_line").contains(marker), kind).otherwise(found)
    tail = F.btrim(strip(F.substring_index("raw_line", ":", -1)), F.lit(",.'\""))
    target = F.when(F.col("raw_line").contains(":") & (tail != ""), tail).otherwise(F.col("raw_line"))
    return (
        lines.withColumn("kind", found)
        .filter(F.col("kind").isNotNull())
        .withColumn("target", F.left(target, F.lit(200)))
    )
