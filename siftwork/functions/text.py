"""Text expressions: line splitting, trimming, shortening, slugs, canonical JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftwork.plans.pin import exploded, let

# The characters that end a line, and those that count as white space,
# in the text model the findings are defined on (Unicode white space plus FS..US).
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
RARE_BREAK = "[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# White space that is not yet one blank: a run of any, or a single one of another kind.
SPACE_RUN = f"[{SPACES}]{{2,}}|[{SPACES[1:]}]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def first_text(*cs: Column) -> Column:
    """First argument that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def line_array(text: Column) -> Column:
    """Lines of ``text``; no line follows a final line break. Null or empty text has none."""
    # Plain "\n" is the common case and splits without the regex engine.
    unix = F.when(text.rlike(RARE_BREAK), F.regexp_replace(text, LINE_BREAK, "\n")).otherwise(text)
    return F.when(text != "", F.split(F.regexp_replace(unix, "\n\\z", ""), "\n"))


def explode_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line with its 1-based ``line`` number and ``line_text``."""
    lines = exploded(df, list(keep), line_array(F.col(text)), "_pos", "line_text")
    return lines.select(*keep, (F.col("_pos") + 1).alias("line"), "line_text")


def stripped_lines(text: Column) -> Column:
    return F.transform(line_array(text), strip)


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE_RUN, " "))


def shorten(c: Column, limit: int = 320) -> Column:
    """White space collapsed, cut to ``limit`` characters with a trailing ellipsis."""

    def cut(t: Column) -> Column:
        head = F.rtrim(F.left(t, F.lit(max(0, limit - 3))))
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(head, F.lit("...")))

    return let(collapse_spaces(c), cut)


def file_slug(c: Column, limit: int = 160, default: str = "manual-trigger") -> Column:
    dashed = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "[^A-Za-z0-9_.-]+", "-")
    return F.coalesce(F.nullif(F.left(F.btrim(dashed, F.lit(".-")), F.lit(limit)), F.lit("")), F.lit(default))


def branch_slug(c: Column, limit: int = 60) -> Column:
    dashed = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", "-")
    return F.left(F.lower(F.btrim(dashed, F.lit("-"))), F.lit(limit))


def artifact_suffix(c: Column, limit: int = 64) -> Column:
    dashed = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_.-]", "-")
    return F.left(F.btrim(F.regexp_replace(dashed, "-+", "-"), F.lit("-")), F.lit(limit))


def artifact_name(run_id: Column, attempt: Column, suffix: Column, base: str = "findings") -> Column:
    return F.concat_ws(
        "-", F.lit(base), run_id.cast("string"), attempt.cast("string"), F.nullif(artifact_suffix(suffix), F.lit(""))
    )


def normal_form(text: Column) -> Column:
    """Unix line ends, every line right-trimmed, the whole trimmed."""
    unix = F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    # Trimming line by line is several times faster here than a regex over the whole text.
    lines = F.transform(F.split(unix, "\n"), lambda x: F.rtrim(x, F.lit(SPACES)))
    return strip(F.array_join(lines, "\n"))


def _escape_unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _escape_char(ch: Column) -> Column:
    code = F.ascii(ch)
    high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
    low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)
    return (
        F.when(code < 128, ch)
        .when(code < 0x10000, _escape_unit(code))
        .otherwise(F.concat(_escape_unit(high), _escape_unit(low)))
    )


def ascii_json(json_text: Column) -> Column:
    """JSON text with every non-ASCII character as a \\u escape."""
    escaped = F.array_join(F.transform(F.split(json_text, ""), _escape_char), "")
    return F.when(json_text.rlike("[^\\x00-\\x7f]"), escaped).otherwise(json_text)


def csv_items(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def url_quote(c: Column, keep_slash: bool = True) -> Column:
    """Percent-encoding with the unreserved set A-Z a-z 0-9 - _ . ~"""
    out = F.url_encode(c)
    swaps = [("+", "%20"), ("*", "%2A"), ("%7E", "~")] + ([("%2F", "/")] if keep_slash else [])
    for old, new in swaps:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def permalink(repo: Column, commit: Column, path: Column, line: Column, host: str = "https://github.com") -> Column:
    sha = first_text(strip(commit), F.lit("HEAD"))
    return F.concat(
        F.lit(host + "/"),
        url_quote(strip(F.coalesce(repo, F.lit("")))),
        F.lit("/blob/"),
        url_quote(sha, keep_slash=False),
        F.lit("/"),
        url_quote(F.ltrim(F.coalesce(path, F.lit("")), F.lit("/"))),
        F.when(line > 0, F.concat(F.lit("#L"), line.cast("string"))).otherwise(""),
    )


def deterministic_run_id(
    repo: Column, commit: Column, pr_number: Column, command: Column, scan_mode: Column, prefix: str = "ghlocal"
) -> Column:
    """Stable id of a run from the inputs that define it."""
    payload = F.to_json(
        F.struct(
            command.alias("command"),
            commit.alias("commit_sha"),
            pr_number.cast("long").alias("pr_number"),
            repo.alias("repository_full_name"),
            scan_mode.alias("scan_mode"),
            F.lit("deterministic_only").alias("source"),
        ),
        {"ignoreNullFields": "false"},
    )
    digest = F.left(F.sha2(ascii_json(payload), 256), F.lit(24))
    return F.concat_ws("_", F.lit(prefix), file_slug(repo, 80, "repo"), digest)
