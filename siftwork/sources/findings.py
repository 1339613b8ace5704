"""Findings and judge candidates from JSON text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siftwork.functions import variants as V
from siftwork.functions.numbers import lenient_double
from siftwork.functions.text import RARE_BREAK, first_text, line_array, strip
from siftwork.plans.pin import exploded, pinned
from siftwork.schemas import JSON_KEYS, as_findings


class BadFindings(ValueError):
    """A strict read met lines that are not JSON objects."""


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line of text files: ``file_name``, ``split`` (the byte at which the line's piece of the file begins), ``row`` (the
    line's number in its task) and ``value``."""
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("split"), row.alias("row"), "value"
    )


def _parsed(lines: DataFrame) -> DataFrame:
    lines = pinned(lines.filter(F.col("value") != ""), raw=V.parse(F.col("value")))
    return lines.withColumn("bad", ~V.is_object(F.col("raw")))


def read_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines of JSON-lines files with source ``file_name``, ``raw`` VARIANT and ``bad`` flag.

    ``position`` orders the lines of a file: the byte at which the line's split of the file begins,
    plus the number of the row in its task. A line has a byte at least, so splits do not overlap.
    """
    lines = _lines(spark, path).select("file_name", (F.col("split") + F.col("row")).alias("position"), strip(F.col("value")).alias("value"))
    return _parsed(lines)


def read_loose(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Object rows only; malformed lines and other JSON values are skipped."""
    return read_rows(spark, path).filter(~F.col("bad")).select("file_name", "position", "raw")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line of text files with its number in the file, ``line``, from 1; files are read in splits, however large.

    Each split counts its lines, a window over the counts of a file's splits gives every split its first number, and a window
    inside a split numbers its lines. A line holds ``breaks`` more lines where its text has rarer line breaks than those
    at which files are cut; they count.
    """
    lines = _lines(spark, path)
    # What follows keeps a break at the end from being dropped.
    held = F.when(F.col("value").rlike(RARE_BREAK), F.size(line_array(F.concat("value", F.lit("."))))).otherwise(1)
    lines = lines.withColumn("_n", held.cast("long"))
    splits = lines.groupBy("file_name", "split").agg(F.sum("_n").alias("_lines"))
    before = Window.partitionBy("file_name").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file_name", "split", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("file_name", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    out = lines.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, ["file_name", "split"])
    return out.select("file_name", (F.col("_start") + F.col("_before") + 1).alias("line"), (F.col("_n") - 1).alias("breaks"), "value")


def bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Line number of every line that a strict read refuses, per file.

    A line that holds rarer line breaks is bad as a whole if it is not one object; then each of its lines is tested, and
    the first is named where all of them are fine by themselves.
    """
    bad = _parsed(numbered_lines(spark, path).withColumns({"text": F.col("value"), "value": strip(F.col("value"))})).filter("bad")
    whole = F.struct(F.lit(0).cast("long").alias("at"), F.when(F.col("raw").isNull(), "not JSON").otherwise("not an object").alias("why"))

    def tested(line: Column, at: Column) -> Column:
        v = V.parse(strip(line))
        why = F.when(strip(line) == "", None).when(v.isNull(), "not JSON").when(~V.is_object(v), "not an object")
        return F.struct(at.cast("long").alias("at"), why.alias("why"))

    found = F.filter(F.transform(line_array(F.col("text")), tested), lambda t: t["why"].isNotNull())
    each = F.when((F.col("breaks") == 0) | (F.size(found) == 0), F.array(whole)).otherwise(found)
    return bad.select("file_name", "line", F.inline(each)).select("file_name", (F.col("line") + F.col("at")).cast("int").alias("line"), "why")


def read_strict(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Object rows; any malformed line fails the read and names its file and line."""
    rows = read_rows(spark, path)
    if not rows.filter("bad").isEmpty():
        first = bad_lines(spark, path).orderBy("file_name", "line").first()
        raise BadFindings(f"{first.file_name}: line {first.line} is {first.why}")
    return rows.select("file_name", "position", "raw")


def finding_columns(rows: DataFrame, parity: bool = False) -> DataFrame:
    """Finding columns of loose rows ``(run_id, raw)``; camelCase or snake_case keys.

    A confidence of zero and the decision are kept; with ``parity`` zero reads as 1.0 and the
    decision is dropped.
    """
    raw = F.col("raw")

    def at(column: str) -> Column:
        return first_text(V.text_at(raw, f"$.{JSON_KEYS[column]}"), V.text_at(raw, f"$.{column}"))

    confidence = lenient_double(V.text_at(raw, "$.confidence"))
    if parity:
        confidence = F.nullif(confidence, F.lit(0.0))
    return as_findings(
        rows,
        gate_id=F.coalesce(at("gate_id"), F.lit("")),
        tool=F.coalesce(at("tool"), F.lit("")),
        severity=F.coalesce(at("severity"), F.lit("P2")),
        file=F.coalesce(at("file"), F.lit("")),
        line=F.coalesce(V.int_at(raw, "$.line"), F.lit(0)),
        title=F.coalesce(at("title"), F.lit("")),
        description=F.coalesce(at("description"), F.lit("")),
        rule_id=at("rule_id"),
        confidence=F.coalesce(confidence, F.lit(1.0)),
        recommended_fix=at("recommended_fix"),
        evidence=at("evidence"),
        decision=F.lit(None) if parity else at("decision"),
    )


def read_findings(spark: SparkSession, path: str | list[str], mode: str = "skip", parity: bool = False) -> DataFrame:
    """Findings of JSON-lines files. ``mode`` is ``skip`` or ``strict``.

    ``run_id`` is the ``run_id=`` folder of the file where there is one, else the file's name. ``seq``
    is the row's own, else its position in the file.
    """
    rows = read_strict(spark, path) if mode == "strict" else read_loose(spark, path)
    folder = F.regexp_extract("file_name", r"run_id=([^/]+)", 1)
    run = F.coalesce(F.nullif(folder, F.lit("")), F.substring_index("file_name", "/", -1))
    own = V.text_at(F.col("raw"), "$.runId")
    with_run = rows.withColumn("run_id", F.coalesce(own, run))
    return finding_columns(with_run.withColumn("seq", F.coalesce(F.try_variant_get("raw", "$.seq", "long"), F.col("position"))), parity)


def read_judge_json(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of whole JSON files, a list or an object with ``findings``: ``(file_name, seq, raw)``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_name"), "value")
    return exploded(whole, ["file_name"], V.json_list(V.parse(F.col("value"))), "seq", "raw")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """``(file_name, payload)`` of text files, one row each: the input of ``judge_inputs``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_name"), F.col("value").alias("payload")
    )
