"""The operators' inputs, derived row by row from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwork.functions.text import SPACES
from siftwork.operators.scan import Rule
from siftwork.plans.pin import pinned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text corpora as source files ----

RULES = [
    Rule('token = "[0-9a-f]{16,}"', "p0", "Secret token in text"),
    Rule(r"[A-Za-z0-9.+_-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "P1", "Mail address in text", behavior="ask"),
    Rule(r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "P2", ""),
    Rule("License", "P3", "License text", behavior="allow"),
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of one run per source."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("run_id"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("file"),
        "text",
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as files of one run per role."""
    c = table(spark, sf_dir, "conversations")
    name = F.concat_ws("/", F.lit("chat"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select(F.col("role").alias("run_id"), name.alias("file"), "text")


WS_SQL = "'" + "".join(c if c.isprintable() and c != "'" else "" for c in " ") + "'" + "".join(
    f"||chr({ord(c)})" for c in SPACES if c != " "
)

LINE_BREAK_SQL = r"'\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'"


def lines_sql(run: str, file: str, source: str) -> str:
    """Lines of every text of ``source`` as (run_id, file, line, t)."""
    return f"""
    SELECT run_id, file, unnest(range(1, len(arr) + 1)) AS line, unnest(arr) AS t
    FROM (SELECT {run} AS run_id, {file} AS file,
                 string_split_regex(text, {LINE_BREAK_SQL}) AS arr FROM {source})"""


DOC_FILE_SQL = "lang || '/' || doc_id || '.' || lang"
CHAT_FILE_SQL = "'chat/' || conv_id || '/' || turn"

RULES_SQL = """
    SELECT * FROM (VALUES
      (1, 'token = "[0-9a-f]{16,}"', 'P0', 'Secret token in text', 'deny'),
      (2, '[A-Za-z0-9.+_-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+', 'P1', 'Mail address in text', 'ask'),
      (3, '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b', 'P2', 'Forbidden policy pattern matched', 'deny'),
      (4, 'License', 'P3', 'License text', 'allow')
    ) AS r(rule_no, pattern, severity, title, decision)"""


def _hits_sql(lines: str) -> str:
    tests = "\n".join(
        f"""      SELECT l.*, {i} AS rule_no FROM ({lines}) l WHERE regexp_matches(t, '{r.pattern}')"""
        + (" UNION ALL" if i < len(RULES) else "")
        for i, r in enumerate(RULES, 1)
    )
    return f"""
    SELECT h.run_id, h.file, h.line, h.t, r.* FROM (
{tests}
    ) h JOIN ({RULES_SQL}) r USING (rule_no)"""


DOC_HITS_SQL = _hits_sql(lines_sql("source", DOC_FILE_SQL, "documents"))
CHAT_HITS_SQL = _hits_sql(lines_sql("role", CHAT_FILE_SQL, "conversations"))


# ---- events ----


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the columns that reports and requests are built from."""
    e = table(spark, sf_dir, "events")
    k = F.col("k")
    return pinned(e, k=F.get_json_object("props", "$.k").try_cast("int")).select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_type").alias("kind"),
        "value",
        "k",
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor("value").cast("int").alias("line"),
        F.concat(F.lit("src/"), "event_type", F.lit("/f"), k.cast("string"), F.lit(".ts")).alias("file"),
    )


EVENTS_SQL = """
    SELECT event_id, 'u' || user_id AS run_id, event_type AS kind, value,
           CAST(props->>'$.k' AS INTEGER) AS k, ts, CAST(floor(value) AS INTEGER) AS line,
           'src/' || event_type || '/f' || CAST(props->>'$.k' AS INTEGER) || '.ts' AS file
    FROM events"""


def dealt(df: DataFrame) -> DataFrame:
    """The rows in as many even parts as a shuffle has. A row's report takes a thousand times longer to print and read than
    the row itself, so the few row groups of a small file must not decide how many tasks share that work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns)


def by_kind(click: Column, error: Column, purchase: Column, signup: Column, view: Column) -> Column:
    kind = F.col("kind")
    return (
        F.when(kind == "click", click)
        .when(kind == "error", error)
        .when(kind == "purchase", purchase)
        .when(kind == "signup", signup)
        .when(kind == "view", view)
    )


def text(value: str | None) -> Column:
    return F.lit(value).cast("string")


# ---- tool reports: one per event and tool, as the tool would print it ----

BROKEN = "[{"  # a report that was cut off


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def payload(tool: str) -> Column:
    """Report text of an event row for one tool; sign-ups have an unreadable JSON report."""
    n, line, file, k = F.col("event_id").cast("string"), F.col("line"), F.col("file"), F.col("k")
    ls, ks = line.cast("string"), k.cast("string")
    note = F.concat(F.lit("Event "), n)
    if tool == "tsc":
        level = by_kind(text("warning"), text("error"), text("warning"), text("message"), text("error"))
        path = F.when(F.col("kind") == "view", F.concat(F.lit("app/(g)/f"), ks, F.lit(".ts"))).otherwise(file)
        return F.concat(path, F.lit("("), ls, F.lit(",4): "), level, F.lit(" TS2"), ks, F.lit(": "), note, F.lit("\nFound 1 error.\n"))
    if tool == "prettier":
        return F.concat(F.lit("[warn] ./"), file, F.lit("\n\n[warn] Code style issues found in 1 file.\nnote: "), n, F.lit("\n[warn]\n"))
    if tool == "actionlint":
        head = F.concat(F.lit(".github/workflows/f"), ks, F.lit(".yml:"))
        return by_kind(
            F.concat(head, F.lit("x:4: "), note, F.lit(" [expression]\n")),
            F.concat(head, ls, F.lit(":4: "), note, F.lit(": bad [syntax] key [syntax-check]\n\nsummary\n")),
            F.concat(F.lit("path:"), ls, F.lit("\n")),
            F.concat(head, ls, F.lit(":4: "), note, F.lit(" []\n")),
            F.concat(head, ls, F.lit(":4: "), note, F.lit("\r\n")),
        )
    if tool == "eslint":
        rule = F.when(F.col("kind") != "click", F.col("kind"))
        msg = _json(ruleId=rule, severity=F.when(F.col("kind") == "error", 2).otherwise(1), line=line, message=note)
        body = F.concat(F.lit('[7,{"filePath":"./'), file, F.lit('","messages":[null,'), msg, F.lit("]}]"))
    elif tool == "gitleaks":
        rule = F.when(F.col("kind") == "view", text(" ")).otherwise(F.col("kind"))
        rec = _json(Description=F.concat(F.lit("Leak "), note, F.lit(" ")), RuleID=rule, File=file, StartLine=line)
        body = F.concat(F.lit('["x",5,null,'), rec, F.lit("]"))
    elif tool == "semgrep":
        level = by_kind(text("odd"), text("error"), text("WARNING"), text(None), text("INFO"))
        rec = F.to_json(
            F.struct(
                F.concat(F.lit("rules."), "kind").alias("check_id"),
                file.alias("path"),
                F.struct(ls.alias("line")).alias("start"),
                F.struct(level.alias("severity"), F.when(F.col("kind") != "click", note).alias("message")).alias("extra"),
            )
        )
        body = F.concat(F.lit('{"results":[null,"x",'), rec, F.lit('],"errors":[]}'))
    elif tool == "osv-scanner":
        score = F.floor(F.col("value") / 40).cast("string")
        scores = by_kind(
            F.concat(F.lit('[{"score":"'), score, F.lit('"}]')),
            F.concat(F.lit('[{"type":"V3","score":"CVSS:3.1/AV:N / '), score, F.lit('"},{"score":"low"},3]')),
            text("null"),
            text("[]"),
            text('[{"score":"CVSS:3.1/AV:N/AC:L"}]'),
        )
        vuln = F.concat(F.lit('{"id":"V-'), ks, F.lit('","summary":" '), note, F.lit('","severity":'), scores, F.lit("}"))
        name = F.when(F.col("kind") == "click", text("{}")).otherwise(text('{"name":"pkg","ecosystem":"npm"}'))
        body = F.concat(
            F.lit('{"results":[4,{"source":{"path":"lock/'), ks, F.lit('.json"},"packages":[{"package":'), name,
            F.lit(',"vulnerabilities":['), vuln, F.lit(',"y"]}]}]}'),
        )
    elif tool == "checkov":
        level = by_kind(text("LOW"), text("critical"), text("HIGH"), text(None), text(None))
        first = F.when(F.col("kind") == "click", text('"x"')).otherwise(ls)
        rec = _json(check_id=F.concat(F.lit("CKV_"), ks), check_name=note, file_path=F.concat(F.lit("//"), file), severity=level)
        rec = F.concat(F.rtrim(rec, F.lit("}")), F.lit(',"file_line_range":['), first, F.lit(",9]}"))
        one = F.concat(F.lit('{"results":{"failed_checks":['), rec, F.lit("]}}"))
        body = F.when(F.col("kind") == "purchase", F.concat(F.lit("["), one, F.lit(',"x"]'))).otherwise(one)
    elif tool == "tflint":
        level = by_kind(text("info"), text("error"), text("Warning"), text(None), text("notice"))
        rec = F.to_json(
            F.struct(
                F.struct(F.concat(F.lit("tf_"), "kind").alias("name"), level.alias("severity")).alias("rule"),
                note.alias("message"),
                F.struct(file.alias("filename"), F.struct(line.alias("line")).alias("start")).alias("range"),
            )
        )
        body = F.concat(F.lit('{"issues":['), rec, F.lit(",0]}"))
    else:
        raise ValueError(tool)
    return F.when(F.col("kind") == "signup", BROKEN).otherwise(body)


def reports(spark: SparkSession, sf_dir: str, *tools: str) -> DataFrame:
    """Reports ``(run_id, tool, payload, event_id)``, one per event and tool."""
    e = dealt(events(spark, sf_dir))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tool"), payload(t).alias("payload")) for t in tools]))
    return e.select("run_id", "event_id", each.alias("_r")).select("run_id", "event_id", "_r.*")


def report_rows_sql(tool: str) -> str:
    """The findings that the reports of one tool hold, straight from the event columns."""
    cols = {
        "tsc": (
            "CASE WHEN kind IN ('error','view') THEN 'P1' ELSE 'P2' END",
            "CASE WHEN kind = 'view' THEN 'app/(g)/f' || k || '.ts' ELSE file END",
            "line", "'Event ' || event_id", "'tsc:TS2' || k", "kind <> 'signup'",
        ),
        "eslint": (
            "CASE WHEN kind = 'error' THEN 'P1' ELSE 'P2' END", "file", "line", "'Event ' || event_id",
            "'eslint:' || CASE WHEN kind = 'click' THEN 'unknown' ELSE kind END", "kind <> 'signup'",
        ),
        "prettier": ("'P2'", "file", "0", "'Prettier formatting differences'", "'prettier:unformatted'", "true"),
        "gitleaks": (
            "'P0'", "file", "line", "'Leak Event ' || event_id",
            "'gitleaks:' || CASE WHEN kind = 'view' THEN 'unknown' ELSE kind END", "kind <> 'signup'",
        ),
        "semgrep": (
            "CASE kind WHEN 'error' THEN 'P1' WHEN 'view' THEN 'P3' ELSE 'P2' END", "file", "line",
            "CASE WHEN kind = 'click' THEN 'rules.click' ELSE 'Event ' || event_id END", "'semgrep:rules.' || kind",
            "kind <> 'signup'",
        ),
        "osv-scanner": (
            """CASE WHEN kind IN ('purchase','view') THEN 'P2'
                 WHEN kind = 'error' AND floor(value/40) > 10 THEN 'P2'
                 WHEN floor(value/40) >= 9 THEN 'P0' WHEN floor(value/40) >= 7 THEN 'P1'
                 WHEN floor(value/40) >= 4 THEN 'P2' WHEN floor(value/40) > 0 THEN 'P3' ELSE 'P2' END""",
            "'lock/' || k || '.json'", "0",
            "CASE WHEN kind = 'click' THEN '' ELSE 'pkg: ' END || 'Event ' || event_id", "'osv:V-' || k", "kind <> 'signup'",
        ),
        "actionlint": (
            "'P2'", "'.github/workflows/f' || k || '.yml'", "line",
            "CASE kind WHEN 'error' THEN 'Event ' || event_id || ': bad [syntax] key' ELSE 'Event ' || event_id END",
            "'actionlint:' || CASE kind WHEN 'error' THEN 'syntax-check' ELSE 'unknown' END",
            "kind IN ('error','signup','view')",
        ),
        "checkov": (
            "CASE kind WHEN 'click' THEN 'P3' WHEN 'error' THEN 'P0' WHEN 'purchase' THEN 'P1' ELSE 'P2' END",
            "file", "CASE WHEN kind = 'click' THEN 0 ELSE line END", "'Event ' || event_id", "'checkov:CKV_' || k",
            "kind <> 'signup'",
        ),
        "tflint": (
            "CASE kind WHEN 'error' THEN 'P1' WHEN 'purchase' THEN 'P2' ELSE 'P3' END", "file", "line",
            "'Event ' || event_id", "'tflint:tf_' || kind", "kind <> 'signup'",
        ),
    }
    severity, file, line, title, rule, where = cols[tool]
    return f"""
    SELECT run_id, '{tool}' AS tool, {severity} AS severity, {file} AS file, CAST({line} AS BIGINT) AS line,
           {title} AS title, {rule} AS rule_id FROM ({EVENTS_SQL}) WHERE {where}"""
