"""Row shapes shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FINDING_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("gate_id", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("recommended_fix", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("decision", T.StringType()),
    ]
)
FINDING_COLUMNS = [f.name for f in FINDING_SCHEMA]

# Severity labels in rank order, and the three decisions.
SEVERITIES = ("P0", "P1", "P2", "P3")
DECISIONS = ("allow", "deny", "ask")

# JSON key of each finding column on disk.
JSON_KEYS = {
    "gate_id": "gateId",
    "tool": "tool",
    "severity": "severity",
    "file": "file",
    "line": "line",
    "title": "title",
    "description": "description",
    "rule_id": "ruleId",
    "confidence": "confidence",
    "recommended_fix": "recommendedFix",
    "evidence": "evidence",
    "decision": "decision",
}

# Values a finding takes where its producer has none.
_DEFAULTS = {"seq": 0, "line": 0, "description": "", "confidence": 1.0}


def as_findings(df: DataFrame, **cols: Column) -> DataFrame:
    """Project ``df`` to the finding schema; ``cols`` override columns of the same name."""
    out = []
    for field in FINDING_SCHEMA:
        if field.name in cols:
            c = cols[field.name]
        elif field.name in df.columns:
            c = F.col(field.name)
        else:
            c = F.lit(_DEFAULTS.get(field.name))
        out.append(c.cast(field.dataType).alias(field.name))
    return df.select(*out)
