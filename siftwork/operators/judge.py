"""Contract that candidate findings must meet; the first failing test names the rejection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from siftwork.functions import variants as V
from siftwork.functions.numbers import is_finite, lenient_double
from siftwork.functions.paths import inside_base
from siftwork.functions.text import blank_to_null, first_text, line_array, strip
from siftwork.operators.phrases import Book, contains_phrase, occurring, phrase_book, phrase_hits
from siftwork.plans.lookup import lookup
from siftwork.plans.pin import exploded, pinned
from siftwork.schemas import FINDING_COLUMNS, SEVERITIES, as_findings

# Lowest confidence that is ever accepted, and the default floor per severity.
HARD_FLOOR = 0.8
DEFAULT_FLOORS = {"P0": 0.80, "P1": 0.80, "P2": 0.85, "P3": 0.95}
REJECT_CLASSES = ("confidence", "exclusion", "precedent", "category", "schema")


def confidence_of(raw: Column, path: str = "$.confidence") -> Column:
    """Number at ``path``; zero when the key is missing, null when it is not a number."""
    t = V.text_at(raw, path)
    flag = F.when(V.kind(F.try_variant_get(raw, path, "variant")) == "BOOLEAN", (t == "true").cast("double"))
    return F.when(~V.has(raw, path), F.lit(0.0)).otherwise(F.coalesce(flag, lenient_double(t)))


def read_candidates(candidates: DataFrame) -> DataFrame:
    """Columns of ``(run_id, seq, raw VARIANT)``; columns already present are kept as they are."""
    raw = F.col("raw")

    def word(path: str) -> Column:
        return strip(F.coalesce(V.text_at(raw, path), F.lit("")))

    made = {
        "severity": word("$.severity"),
        "category": F.lower(word("$.category")),
        "title": word("$.title"),
        "description": word("$.description"),
        "file": word("$.file"),
        "recommended_fix": V.text_at(raw, "$.recommended_fix"),
        "evidence": V.text_at(raw, "$.evidence"),
        "tool": F.lit("llm"),
    }
    kept = {name: F.col(name) for name in made if name in candidates.columns}
    cols = {**made, **kept}
    return pinned(
        candidates,
        **{
            **cols,
            "severity": F.upper(cols["severity"]),
            "line": F.coalesce(V.int_at(raw, "$.line"), F.lit(0)),
            "confidence": confidence_of(raw),
            "_shown": F.coalesce(V.text_at(raw, "$.confidence"), F.lit("null")),
            "_rule": first_text(V.text_at(raw, "$.rule_id"), V.text_at(raw, "$.ruleId"), V.text_at(raw, "$.kind")),
            "_object": V.is_object(raw),
        },
    ).drop("raw")


def effective_floor(
    severity: Column, floors: Mapping[str, float] | Column | None, global_floor: float | Column | None
) -> Column:
    """Per-severity override, else the global floor, else the default; never below the hard floor."""
    def by_severity(table: Mapping[str, float]) -> Column:
        out = F.lit(None).cast("double")
        for name, value in table.items():
            out = F.when(severity == name, F.lit(float(value))).otherwise(out)
        return out

    override = floors if isinstance(floors, Column) else by_severity(floors or {})
    if isinstance(floors, Column):
        override = F.try_element_at(floors, severity)
    shared = global_floor if isinstance(global_floor, Column) else F.lit(global_floor).cast("double")
    return F.greatest(F.lit(HARD_FLOOR), F.coalesce(override, shared, by_severity(DEFAULT_FLOORS)))


def judge(
    candidates: DataFrame,
    categories: DataFrame,
    phrases: DataFrame,
    floors: Mapping[str, float] | Column | None = None,
    global_floor: float | Column | None = None,
    gate_id: str = "llm_judge",
    decision: Column | None = None,
) -> DataFrame:
    """Every candidate as a finding row with ``reject_class`` and ``reject_reason``; null = accepted.

    ``(run_id, seq)`` is carried along and need not be unique: several reports of one run count from
    zero each. ``categories(category)`` and ``phrases(kind, phrase)`` are the user's lists; only
    candidates that pass all other tests are matched against phrases.
    """
    c = read_candidates(candidates)
    known = categories.select(F.lower(strip(F.col("category"))).alias("category")).distinct()
    c = lookup(c, known.withColumn("_known", F.lit(True)), ["category"])
    floor = effective_floor(F.col("severity"), floors, global_floor)
    conf = F.col("confidence")
    shown = F.format_string("%.2f", conf)

    def fail(name: str, reason: Column) -> Column:
        return F.struct(F.lit(name).alias("reject_class"), reason.alias("reject_reason"))

    early = (
        F.when(~F.col("_object"), fail("schema", F.lit("not a dict")))
        .when(
            ~F.col("severity").isin(*SEVERITIES),
            fail("schema", F.concat(F.lit("invalid severity: '"), F.col("severity"), F.lit("'"))),
        )
        .when(
            (F.col("category") != "") & F.col("_known").isNull(),
            fail("category", F.concat(F.lit("unsupported category: '"), F.col("category"), F.lit("'"))),
        )
        .when(
            conf.isNull(),
            fail(
                "schema",
                F.concat(F.lit("non-numeric confidence: "), F.col("_shown")),
            ),
        )
        .when(
            ~is_finite(conf) | (conf < 0) | (conf > 1),
            fail("schema", F.concat(F.lit("confidence outside [0, 1]: "), shown)),
        )
        .when(
            conf < floor,
            fail(
                "confidence",
                F.concat(
                    F.lit("confidence "), shown, F.lit(" below "), F.col("severity"), F.lit(" floor "),
                    F.format_string("%.2f", floor),
                ),
            ),
        )
        .when(F.col("title") == "", fail("schema", F.lit("empty title")))
    )
    words = F.concat_ws(" ", "title", "description")
    hays = {"exclusion": F.concat_ws(" ", words, "category"), "precedent": words}
    tested = pinned(c, _early=early)
    book = phrase_book(phrases, ["kind"])
    if not book and not candidates.isStreaming:
        # The exclusion text holds all of the other.
        phrases = occurring(phrases, tested.filter(F.col("_early").isNull()), hays["exclusion"], ["kind"])
        book = phrase_book(phrases, ["kind"])
    if book:
        flagged = _flagged_in_place(tested, hays, book)
    else:
        flagged = _flagged_by_join(tested, hays, phrases)
    failed = F.coalesce(
        F.col("_early"),
        F.when(F.col("_kind") == "exclusion", fail("exclusion", F.lit("matches hard exclusion"))),
        F.when(F.col("_kind") == "precedent", fail("precedent", F.lit("matches known-safe precedent"))),
    )
    rule = strip(F.coalesce(F.col("_rule"), F.lit("")))
    fallback = F.when(F.col("category") != "", F.concat(F.lit("llm:"), F.col("category"))).otherwise("llm:unknown")
    out = pinned(flagged, _fail=failed).withColumns(
        {
            "gate_id": F.lit(gate_id),
            "rule_id": F.when(rule != "", F.left(rule, F.lit(120))).otherwise(fallback),
            "recommended_fix": blank_to_null(strip(F.col("recommended_fix"))),
            "evidence": blank_to_null(strip(F.col("evidence"))),
            "decision": decision if decision is not None else F.lit(None).cast("string"),
        }
    )
    return out.select(*FINDING_COLUMNS, "category", "_fail.reject_class", "_fail.reject_reason")


def _flagged_in_place(tested: DataFrame, hays: Mapping[str, Column], book: Book) -> DataFrame:
    """``_kind``: the first kind of phrase that a candidate holds. No row moves.

    The exclusion text holds all words of the other, so its words serve both.
    """
    lowered = pinned(tested, _hay=F.when(F.col("_early").isNull(), F.struct(*[F.lower(h).alias(k) for k, h in hays.items()])))
    near = pinned(lowered, _near=F.when(F.col("_hay").isNotNull(), book.candidates(F.col("_hay.exclusion"))))

    def holds(kind: str) -> Column:
        return F.exists("_near", lambda e: (e["kind"] == kind) & contains_phrase(F.col(f"_hay.{kind}"), e["phrase"]))

    some = F.size("_near") > 0
    kind = F.when(some & holds("exclusion"), "exclusion").when(some & holds("precedent"), "precedent")
    return near.withColumn("_kind", kind).drop("_hay", "_near")


def _flagged_by_join(tested: DataFrame, hays: Mapping[str, Column], phrases: DataFrame) -> DataFrame:
    """The same for a phrase list too large for every task."""
    # Whether a phrase occurs depends on the words alone, so hits come back by a hash of the words.
    # Rows that failed before have one too: nulls would all go to one task.
    key = F.sha2(F.encode(F.concat_ws("\0", "title", "description", "category"), "UTF-8"), 256)
    tested = tested.withColumn("_at", key)
    stays = tested.filter(F.col("_early").isNull()).select(
        "_at", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), h.alias("hay")) for k, h in hays.items()]))
    )
    hits = phrase_hits(stays, phrases, ["_at"], "hay", on=["kind"], carry_text=True)
    # Exclusions are tested before precedents, and come first by name.
    return lookup(tested, hits.groupBy("_at").agg(F.min("kind").alias("_kind")), ["_at"])


def accepted(judged: DataFrame) -> DataFrame:
    return as_findings(judged.filter(F.col("reject_class").isNull()))


def rejected(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reject_class").isNotNull())


def rejection_counts(judged: DataFrame) -> DataFrame:
    """Per run: accepted, and one count per rejection class, zeros kept."""
    return judged.groupBy("run_id").agg(
        F.count_if(F.col("reject_class").isNull()).alias("accepted"),
        *[F.count_if(F.col("reject_class") == c).alias(c) for c in REJECT_CLASSES],
    )


def judge_inputs(configured: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of the configured files, and one denying finding per input that cannot be used.

    ``configured(run_id, findings_file, root)``: a blank file name means the gate is skipped.
    ``files(run_id, findings_file, payload)`` are the texts that were found. An input that is
    missing, outside its root or malformed gives no candidate: the gate fails closed.
    """
    asked = configured.select(
        "run_id", strip(F.coalesce("findings_file", F.lit(""))).alias("findings_file"), "root"
    ).filter(F.col("findings_file") != "")
    name = F.col("findings_file")
    joined = asked.join(files.select("run_id", "findings_file", "payload"), ["run_id", "findings_file"], "left")

    lines = F.filter(
        F.transform(
            line_array(F.col("payload")), lambda x, i: F.struct((i + 1).alias("no"), strip(x).alias("t"))
        ),
        lambda s: s["t"] != "",
    )
    per_line = F.transform(lines, lambda s: F.struct(s["no"].alias("no"), V.parse(s["t"]).alias("v")))
    bad_line = F.get(F.filter("_lines", lambda s: ~V.is_object(s["v"])), F.lit(0))
    whole = V.parse(F.col("payload"))
    listed = F.when(V.is_object(F.col("_doc")) & ~V.truthy(F.col("_doc"), "$.findings", F.lit(False)),
                    F.when(V.truthy(F.col("_doc"), "$.Findings", F.lit(False)),
                           V.array_at(F.col("_doc"), "$.Findings")).otherwise(F.array().cast("array<variant>"))
                    ).otherwise(V.json_list(F.col("_doc")))
    bad_item = F.get(
        F.filter(F.transform("_list", lambda v, i: F.struct(i.alias("no"), v.alias("v"))), lambda s: ~V.is_object(s["v"])),
        F.lit(0),
    )
    is_lines = F.lower(name).endswith(".jsonl")
    read = pinned(joined, _lines=F.when(is_lines, per_line), _doc=F.when(~is_lines, whole))
    read = pinned(read, _list=listed, _bad_line=bad_line)
    read = read.withColumn("_bad_item", bad_item)
    error = (
        F.when(
            ~inside_base(name, F.col("root")),
            F.lit("LLM judge findings file must resolve inside the repository root"),
        )
        .when(F.col("payload").isNull(), F.lit("LLM judge findings file not found"))
        .when(
            F.col("_bad_line").isNotNull(),
            F.concat(
                F.lit("invalid JSONL at line "),
                F.col("_bad_line.no").cast("string"),
                F.when(F.col("_bad_line.v").isNull(), F.lit("")).otherwise(": expected object"),
            ),
        )
        .when(~is_lines & F.col("_doc").isNull(), F.lit("invalid JSON findings file"))
        .when(
            ~is_lines & F.col("_list").isNull(),
            F.lit("LLM judge findings payload must be a list or {findings: [...]}"),
        )
        .when(
            F.col("_bad_item").isNotNull(),
            F.concat(
                F.lit("LLM judge finding at index "), F.col("_bad_item.no").cast("string"), F.lit(" must be an object")
            ),
        )
    )
    read = pinned(read, error=error)
    items = F.when(is_lines, F.transform("_lines", lambda s: s["v"])).otherwise(F.col("_list"))
    candidates = exploded(read.filter(F.col("error").isNull()), ["run_id"], items, "seq", "raw")
    errors = as_findings(
        read.filter(F.col("error").isNotNull()),
        gate_id=F.lit("llm_judge"),
        tool=F.lit("contract-loader"),
        severity=F.lit("P1"),
        file=name,
        title=F.lit("LLM judge input could not be validated"),
        description=F.col("error"),
        rule_id=F.lit("llm_judge:invalid-input"),
        decision=F.lit("deny"),
    )
    return candidates, errors
