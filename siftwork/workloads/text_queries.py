"""Path, policy, option and text expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwork.functions import numbers as N, paths as P, text as X, variants as V
from siftwork.functions.severity import normal_counts
from siftwork.operators import events as E, gates, policy, profile
from siftwork.plans.pin import pinned
from siftwork.operators.scan import prepare_rules, rejected_rules, scannable
from siftwork.workloads.inputs import EVENTS_SQL, WS_SQL, by_kind, events, table, text
from siftwork.workloads.registry import query

# ---- paths ----


def raw_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses turned into path inputs, some of them hostile."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    tail = F.regexp_extract("url", "^https?://[^/]+(.*)", 1)
    raw = (
        F.when(tail.endswith("#top"), F.concat(F.lit("/~"), tail))
        .when(tail.contains("page="), F.concat(F.lit("//share"), tail))
        .when(tail.contains("utm_"), F.concat(F.lit("a%252e"), tail))
        .when(tail.endswith(".html"), F.concat(F.lit(" Docs\\"), F.upper(tail), F.lit(" ")))
        .when(tail.endswith("/"), F.concat(F.lit("C:"), F.regexp_replace(tail, "[^/]", "")))
        .when(host.startswith("m."), F.concat(F.lit("x\u202e"), tail))
        .when(host.startswith("blog."), F.concat(F.lit("x\x07"), tail))
        .when(host.startswith("www."), F.concat(F.lit("\\$HOME"), tail))
        .when(host.endswith(".org"), F.lit("\u2003 "))
        .when(host.endswith(".net"), F.concat(F.lit("My%20Docs%"), tail))
        .otherwise(tail)
    )
    out = pinned(p, run_id=host, seq=F.col("page_id"), path=raw, tail=tail)
    return out.select("page_id", "run_id", "seq", "path", "tail")


PATHS_SQL = """
    SELECT page_id, host AS run_id, tail, CASE
        WHEN ends_with(tail, '#top') THEN '/~' || tail
        WHEN contains(tail, 'page=') THEN '//share' || tail
        WHEN contains(tail, 'utm_') THEN 'a%252e' || tail
        WHEN ends_with(tail, '.html') THEN ' Docs\\' || upper(tail) || ' '
        WHEN ends_with(tail, '/') THEN 'C:' || regexp_replace(tail, '[^/]', '', 'g')
        WHEN starts_with(host, 'm.') THEN 'x' || chr(8238) || tail
        WHEN starts_with(host, 'blog.') THEN 'x' || chr(7) || tail
        WHEN starts_with(host, 'www.') THEN '\\$HOME' || tail
        WHEN ends_with(host, '.org') THEN chr(8195) || ' '
        WHEN ends_with(host, '.net') THEN 'My%20Docs%' || tail
        ELSE tail END AS path
    FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
                 regexp_extract(url, '^https?://[^/]+(.*)', 1) AS tail FROM pages)"""

HYGIENE_SQL = f"""
    SELECT *, CASE WHEN trim(path, {WS_SQL}) = '' THEN 'empty'
        WHEN regexp_matches(path, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') THEN 'control_character'
        WHEN contains(path, chr(8238)) THEN 'bidi_override'
        WHEN url_decode(replace(path, 'Docs%', 'Docs')) <> path AND regexp_matches(url_decode(replace(path, 'Docs%', 'Docs')), '%[0-9A-Fa-f][0-9A-Fa-f]')
          THEN 'double_encoded_percent'
        WHEN starts_with(path, '//') OR starts_with(path, '\\\\') THEN 'unc_path'
        WHEN starts_with(ltrim(ltrim(path, '/'), '\\'), '~') THEN 'tilde_prefix'
        WHEN left(ltrim(ltrim(path, '/'), '\\'), 1) IN ('$', '%', '=') THEN 'shell_expansion'
        WHEN regexp_matches(path, '^[A-Za-z]:') AND ltrim(ltrim(substr(path, 3), '/'), '\\') = '' THEN 'windows_drive_root'
      END AS reason FROM ({PATHS_SQL})"""


@query("path_hygiene", f"SELECT page_id, reason FROM ({HYGIENE_SQL})")
def path_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_paths(spark, sf_dir).select("page_id", P.hygiene_reason(F.col("path")).alias("reason"))


@query(
    "hygiene_report", f"SELECT coalesce(reason, 'clean') AS reason, count(*) AS n FROM ({HYGIENE_SQL}) GROUP BY ALL"
)
def hygiene_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(P.hygiene_reason(F.col("path")), F.lit("clean"))
    return raw_paths(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "clean_paths",
    f"""SELECT run_id, clean AS path FROM (SELECT *, row_number() OVER (PARTITION BY run_id, lower(clean) ORDER BY page_id) AS n
          FROM (SELECT *, trim(replace(path, '\\', '/'), {WS_SQL}) AS clean FROM ({HYGIENE_SQL}) WHERE reason IS NULL)) WHERE n = 1""",
)
def clean_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.clean_paths(raw_paths(spark, sf_dir)).select("run_id", "path")


@query(
    "inside_base",
    """SELECT page_id, CASE WHEN contains(tail, 'page=') THEN false WHEN ends_with(tail, '/') THEN ends_with(host, '.com') ELSE true END AS inside
       FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(.*)', 1) AS tail FROM pages)""",
)
def inside_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_paths(spark, sf_dir)
    tail = F.col("tail")
    base = F.concat(F.lit("/srv/./"), "run_id")
    path = (
        F.when(tail.contains("page="), F.concat(F.lit("a/../../x"), tail))
        .when(tail.endswith("/") & F.col("run_id").endswith(".com"), F.concat(F.lit("/srv/"), "run_id", F.lit("//x/.."), tail))
        .when(tail.endswith("/"), F.concat(F.lit("/srv/"), "run_id", F.lit("x"), tail))
        .otherwise(F.concat(F.lit("./b/.."), tail))
    )
    return raw.select("page_id", P.inside_base(path, base).alias("inside"))


@query(
    "excluded_dirs",
    """SELECT run_id, count(*) AS scanned FROM (
         SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS run_id, regexp_extract(url, '^https?://[^/]+(.*)', 1) AS tail, length(html) AS size FROM pages)
       WHERE NOT (contains(tail, '#top') OR ends_with(tail, '/')) AND size <= 1000000 GROUP BY run_id""",
)
def excluded_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files left to scan when some lie under build folders."""
    p = table(spark, sf_dir, "pages")
    tail = F.regexp_extract("url", "^https?://[^/]+(.*)", 1)
    file = (
        F.when(tail.contains("#top"), F.concat(F.lit("pkg/node_modules"), tail))
        .when(tail.endswith("/"), F.concat(tail.substr(F.lit(2), F.length(tail)), F.lit(".git/x")))
        .otherwise(F.concat(F.lit("builds/.github"), tail))
    )
    rows = p.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("run_id"), file.alias("file"), F.length("html").alias("size"))
    return scannable(rows).groupBy("run_id").agg(F.count(F.lit(1)).alias("scanned"))


# ---- repository facts ----


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the file tree of their host, with a package file and a readme where the address says so."""
    p = table(spark, sf_dir, "pages")
    tail = F.regexp_extract("url", "^https?://[^/]+(.*)", 1)
    lang = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1)
    path = (
        F.when(tail.endswith("#top"), "package.json")
        .when(tail.contains("page="), F.concat(F.lit("apps/"), lang, F.lit("/Dockerfile")))
        .when(tail.contains("utm_"), "README.md")
        .when(tail.endswith(".html"), F.concat(F.lit("src"), F.regexp_replace(tail, "html$", "ts")))
        .when(tail.endswith("/"), F.concat(F.lit("infra"), tail, F.lit("main.tf")))
        .otherwise(F.concat(F.lit("packages"), tail))
    )
    deps = (
        F.when(lang == "en", '{"dependencies":{"next":"1"},"devDependencies":{"React-dom":"1","next":"2"}}')
        .when(lang == "fr", '{"dependencies":[],"devDependencies":{"preact":1}}')
        .otherwise("{bad")
    )
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    body = F.when(tail.endswith("#top"), deps).when(
        tail.contains("utm_"), F.concat(F.lit("\r\n ##  # "), title, F.lit("  \n second"))
    )
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return p.select(host.alias("run_id"), path.alias("path"), F.coalesce(body, F.lit("")).alias("text"), title.alias("title"))


_REPO_SQL = """
    SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS run_id, regexp_extract(url, '^https?://[^/]+(.*)', 1) AS tail,
      regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages"""
_KIND_SQL = f"""
    SELECT *, CASE WHEN ends_with(tail, '#top') THEN 'pkg' WHEN contains(tail, 'page=') THEN 'docker' WHEN contains(tail, 'utm_') THEN 'readme'
      WHEN ends_with(tail, '.html') THEN 'ts' WHEN ends_with(tail, '/') THEN 'tf' ELSE 'pack' END AS f FROM ({_REPO_SQL})"""


@query(
    "stack_tags",
    f"""SELECT run_id, CASE WHEN tags = '' THEN 'unspecified' ELSE tags END AS tags FROM (SELECT run_id, concat_ws(',',
          CASE WHEN bool_or(f = 'pkg') THEN 'Node.js' END, CASE WHEN bool_or(f = 'pkg' AND lang = 'en') THEN 'Next.js' END,
          CASE WHEN bool_or(f = 'pkg' AND lang IN ('en', 'fr')) THEN 'React' END, CASE WHEN bool_or(f = 'ts') THEN 'TypeScript' END,
          CASE WHEN bool_or(f = 'tf') THEN 'Terraform' END, CASE WHEN bool_or(f = 'docker') THEN 'Docker' END) AS tags
        FROM ({_KIND_SQL}) GROUP BY run_id)""",
)
def stack_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.stack_tags(repo_files(spark, sf_dir))
    return out.select("run_id", F.array_join("tags", ",").alias("tags"))


_LAYOUT_SQL = f"""
    SELECT run_id, CASE WHEN bool_or(f = 'docker') AND bool_or(f = 'pack') THEN 'monorepo' WHEN bool_or(f = 'docker') THEN 'apps workspace'
        ELSE 'single repository' END AS layout,
      coalesce(nullif(concat_ws(', ', CASE WHEN bool_or(f = 'ts') THEN 'src' END, CASE WHEN bool_or(f = 'tf') THEN 'infra' END,
        CASE WHEN bool_or(f = 'pack') THEN 'packages' END), ''), 'not inferred') AS entry_points
    FROM ({_KIND_SQL}) GROUP BY run_id"""


@query("repo_layout", _LAYOUT_SQL)
def repo_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.layout(repo_files(spark, sf_dir))


def one_readme(files: DataFrame) -> DataFrame:
    """A tree has one file per path; of repeated readmes the one with the smallest title stays."""
    named = files.withColumn("path", F.when(F.col("path") == "README.md", "README.md").otherwise(F.col("path")))
    return named.groupBy("run_id", "path").agg(F.min_by("text", "title").alias("text"))


@query(
    "readme_label",
    f"""SELECT run_id, CASE WHEN t IS NULL THEN 'README: not found' WHEN length(t) <= 120 THEN 'README.md: ' || t
          ELSE 'README.md: ' || rtrim(left(t, 117)) || '...' END AS label
        FROM (SELECT run_id, regexp_replace(trim(ltrim(trim(min(title) FILTER (f = 'readme')), '#')), '\\s+', ' ', 'g') AS t FROM ({_KIND_SQL}) GROUP BY run_id)""",
)
def readme_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = repo_files(spark, sf_dir)
    # The title follows the two marks of the line directly, so that its own marks are text.
    return profile.readme_label(one_readme(tree.withColumn("text", F.regexp_replace("text", "##  # ", "## "))))


@query(
    "repo_synopsis",
    f"""SELECT run_id, 'README: not found. Architecture: ' || layout || '. Stack: ' || tags || '. Entry points: ' || entry_points || '.' AS synopsis
        FROM ({_LAYOUT_SQL}) JOIN (SELECT run_id, CASE WHEN tags = '' THEN 'unspecified' ELSE tags END AS tags FROM (SELECT run_id, concat_ws(', ',
          CASE WHEN bool_or(f = 'pkg') THEN 'Node.js' END, CASE WHEN bool_or(f = 'pkg' AND lang = 'en') THEN 'Next.js' END,
          CASE WHEN bool_or(f = 'pkg' AND lang IN ('en', 'fr')) THEN 'React' END, CASE WHEN bool_or(f = 'ts') THEN 'TypeScript' END,
          CASE WHEN bool_or(f = 'tf') THEN 'Terraform' END, CASE WHEN bool_or(f = 'docker') THEN 'Docker' END) AS tags
        FROM ({_KIND_SQL}) GROUP BY run_id)) USING (run_id)""",
)
def repo_synopsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees whose readmes are blank."""
    tree = repo_files(spark, sf_dir)
    return profile.synopsis(tree.withColumn("text", F.when(F.col("path") == "README.md", " # ").otherwise(F.col("text"))))


@query(
    "dependency_keys",
    f"""SELECT run_id, count(*) AS files, count(DISTINCT lang) FILTER (lang IN ('en', 'fr')) AS kinds, CAST(sum(CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END) AS BIGINT) AS names
        FROM ({_KIND_SQL}) WHERE f = 'pkg' GROUP BY run_id""",
)
def dependency_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = repo_files(spark, sf_dir).filter(F.col("path") == "package.json")
    keys = pinned(packages, keys=profile.dependency_keys(F.col("text")))
    shown = F.array_join(F.array_sort("keys"), ",")
    return keys.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_distinct(F.when(F.size("keys") > 0, shown)).alias("kinds"),
        F.sum(F.size("keys")).alias("names"),
    )


def spec_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree per source; the language decides the folder."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    path = (
        F.when(F.col("lang") == "en", F.concat(F.lit("docs\\spec-"), n, F.lit(".md")))
        .when(F.col("lang") == "de", F.concat(F.lit("Design/"), n, F.lit("/design.TXT")))
        .when(F.col("lang") == "fr", F.concat(F.lit("x/requirements-"), n, F.lit(".py")))
        .otherwise(F.concat(F.lit("s/"), n, F.lit("/requirements.md")))
    )
    return d.select(F.col("source").alias("run_id"), F.replace(path, F.lit("\\"), F.lit("/")).alias("path"), F.col("n_chars").alias("size"), "text")


_SPEC_SQL = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score, lower(path)) AS rank FROM (
      SELECT source AS run_id, text, CASE lang WHEN 'en' THEN 30 WHEN 'de' THEN 60 ELSE 0 END AS score,
        CASE lang WHEN 'en' THEN 'docs/spec-' || doc_id || '.md' WHEN 'de' THEN 'Design/' || doc_id || '/design.TXT'
          ELSE 's/' || doc_id || '/requirements.md' END AS path
      FROM documents WHERE lang <> 'fr' AND n_chars <= 512000)) WHERE rank <= 24"""


@query("spec_rank", f"SELECT run_id, path, CAST(score AS BIGINT) AS score, rank FROM ({_SPEC_SQL})")
def spec_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.discover_specs(spec_files(spark, sf_dir).drop("text"))
    return out.select("run_id", "path", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


_NORMAL_SQL = f"trim(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\x0b\\f]+(\\n|$)', '\\1', 'g'), {WS_SQL})"


@query(
    "spec_counts",
    """SELECT source AS run_id, count(*) AS candidates, greatest(count(*) - 24, 0) AS omitted
        FROM documents WHERE lang <> 'fr' AND n_chars <= 512000 GROUP BY source""",
)
def spec_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a run, and those past the limit."""
    return profile.spec_counts(spec_files(spark, sf_dir).drop("text"))


@query(
    "content_manifest",
    f"""SELECT run_id, count(*) AS files, sha256('[' || string_agg('{{"content_hash":"' || sha256(n) || '","path":"' || path || '"}}', ',' ORDER BY lower(path))
          || ']') AS manifest_hash FROM (SELECT run_id, path, {_NORMAL_SQL} AS n FROM ({_SPEC_SQL})) WHERE n <> '' GROUP BY run_id""",
)
def content_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = spec_files(spark, sf_dir)
    listed = profile.discover_specs(tree.drop("text")).select("run_id", F.col("rank").alias("seq"), "path")
    return profile.manifest_hash(listed, tree.select("run_id", "path", "text"))


@query("content_hashes", f"SELECT doc_id, CASE WHEN n <> '' THEN sha256(n) END AS hash FROM (SELECT doc_id, {_NORMAL_SQL} AS n FROM documents)")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", profile.content_hash(F.col("text")).alias("hash"))


# ---- text ----


@query(
    "short_texts",
    """SELECT doc_id, CASE WHEN length(c) <= 320 THEN c ELSE rtrim(left(c, 317)) || '...' END AS short
       FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)""",
)
def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.shorten(F.col("text")).alias("short"))


@query(
    "slugs",
    """SELECT page_id, coalesce(nullif(left(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '.-'), 160), ''), 'manual-trigger') AS file_slug,
         lower(trim(regexp_replace(html, '[^A-Za-z0-9]+', '-', 'g'), '-'))[:60] AS branch_slug,
         trim(regexp_replace(html, '[^A-Za-z0-9_.-]+', '-', 'g').regexp_replace('-+', '-', 'g'), '-')[:64] AS suffix,
         'findings-run-' || page_id || '-2' || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-p.' || page_id ELSE '-x-y' END AS name FROM pages""",
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    part = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("/p."), n, F.lit(" "))).when(F.col("page_id") % 3 == 2, "-x /- y--").otherwise("--")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        X.file_slug(F.col("url")).alias("file_slug"),
        X.branch_slug(F.col("html")).alias("branch_slug"),
        X.artifact_suffix(F.col("html")).alias("suffix"),
        X.artifact_name(F.concat(F.lit("run-"), n), F.lit(2), part).alias("name"),
    )


@query(
    "permalinks",
    """SELECT page_id, 'https://github.com/acme/r%20d/blob/a%2Fb/' || replace(url_encode(ltrim(title, '/')), '%2F', '/')
         || CASE WHEN length(title) > 40 THEN '#L' || length(title) ELSE '' END AS link
       FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)""",
)
def permalinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)", 1))
    n = F.length("title")
    link = X.permalink(F.lit(" acme/r d "), F.lit("a/b"), F.col("title"), F.when(n > 40, n).otherwise(0))
    return p.select("page_id", link.alias("link"))


@query(
    "run_ids",
    f"""SELECT event_id, 'ghlocal_acme-' || kind || '_' || left(sha256('{{"command":"/gate ' || kind || '","commit_sha":"' || file || '","pr_number":' || k
          || ',"repository_full_name":"acme/' || kind || '","scan_mode":"deep","source":"deterministic_only"}}'), 24) AS id FROM ({EVENTS_SQL})""",
)
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    made = X.deterministic_run_id(
        F.concat(F.lit("acme/"), "kind"), F.col("file"), F.col("k"), F.concat(F.lit("/gate "), "kind"), F.lit("deep")
    )
    return e.select("event_id", made.alias("id"))


@query(
    "lenient_numbers",
    f"""SELECT event_id, CASE kind WHEN 'click' THEN value WHEN 'error' THEN -line - 0.5 WHEN 'view' THEN line * 1000.0 END AS d,
          CAST(CASE kind WHEN 'click' THEN floor(value) WHEN 'error' THEN -line WHEN 'view' THEN line * 1000 END AS BIGINT) AS n,
          CAST(CASE kind WHEN 'click' THEN line WHEN 'error' THEN -line WHEN 'purchase' THEN NULL WHEN 'signup' THEN 9223372036854775807 END AS BIGINT) AS w,
          CAST(CASE kind WHEN 'click' THEN line WHEN 'error' THEN -line END AS INTEGER) AS i
        FROM ({EVENTS_SQL})""",
)
def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    n = F.col("line").cast("string")
    raw = by_kind(
        F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("\n")), F.concat(F.lit("-"), n, F.lit(".5")),
        text("1.0f"), text("0x1A"), F.concat(F.lit("+"), n, F.lit("e3")),
    )
    # Signs and white space, one past the largest number, the largest, and no whole number.
    whole = by_kind(
        F.concat(F.lit(" +"), n, F.lit("\n")), F.concat(F.lit("-00"), n), text("9223372036854775808"), text("9223372036854775807"),
        F.concat(n, F.lit(".0")),
    )
    return e.select(
        "event_id", N.lenient_double(raw).alias("d"), N.lenient_long(raw).alias("n"), N.whole_long(whole).alias("w"), N.whole_int(whole).alias("i")
    )


@query(
    "normal_counts",
    f"""SELECT event_id, CAST(CASE kind WHEN 'click' THEN k WHEN 'error' THEN line ELSE 0 END AS BIGINT) AS p0,
          CAST(CASE kind WHEN 'error' THEN line + 1 ELSE 0 END AS BIGINT) AS p1 FROM ({EVENTS_SQL})""",
)
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)

    def pair(p0: Column, p1: Column) -> Column:
        return F.create_map(F.lit("P0"), p0.cast("string"), F.lit("P1"), p1.cast("string"))

    raw = by_kind(pair(F.col("k"), -F.col("k")), F.lit(None), pair(F.lit("x"), F.lit("1.5")), F.create_map().cast("map<string,string>"), pair(F.lit("-1"), F.lit("")))
    out = normal_counts(raw, pair(F.col("line"), F.col("line") + 1))
    return e.select("event_id", out["P0"].alias("p0"), out["P1"].alias("p1"))


@query(
    "csv_lists",
    f"""SELECT event_id, CASE WHEN k < 30 THEN kind || '|' || file WHEN k < 60 THEN kind || '|' || kind || '|x y' ELSE '' END AS items,
          CAST(CASE WHEN k < 30 THEN 2 WHEN k < 60 THEN 3 ELSE 0 END AS BIGINT) AS n FROM ({EVENTS_SQL})""",
)
def csv_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    raw = F.when(k < 30, F.concat(F.lit(" ,"), "kind", F.lit(" ,, "), "file", F.lit(","))).when(
        k < 60, F.concat("kind", F.lit(","), "kind", F.lit(" , x y\t"))
    ).otherwise(F.lit(" , ,"))
    items = X.csv_items(raw)
    return events(spark, sf_dir).select("event_id", F.array_join(items, "|").alias("items"), F.size(items).cast("long").alias("n"))


# ---- options, policies, rules, events ----


@query(
    "option_words",
    f"""SELECT event_id, CASE kind WHEN 'click' THEN 'baseline' WHEN 'error' THEN 'full-depth' ELSE 'deep-scan' END AS scan,
          CASE kind WHEN 'click' THEN 'off' WHEN 'error' THEN 'audit' WHEN 'purchase' THEN 'baseline' ELSE 'off' END AS browser,
          CASE kind WHEN 'purchase' THEN 'baseline' WHEN 'error' THEN 'audit' ELSE 'off' END AS sbom,
          CASE kind WHEN 'view' THEN 'explicit' ELSE 'none' END AS binding, CASE kind WHEN 'signup' THEN 'warn' ELSE 'block' END AS failure,
          CASE kind WHEN 'click' THEN 'Baseline-Only' WHEN 'error' THEN 'FULL' WHEN 'purchase' THEN 'pr' WHEN 'view' THEN 'explicit' ELSE 'warn' END AS model,
          CASE WHEN k < 50 THEN sha256(file) END AS hash, kind IN ('error', 'purchase') AS terminal FROM ({EVENTS_SQL})""",
)
def option_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    word = by_kind(text(" Baseline-Only "), text("FULL"), text("pr"), text("warn"), text("explicit "))
    digest = F.sha2("file", 256)
    raw = F.when(F.col("k") < 50, F.concat(F.lit(" "), F.upper(digest))).otherwise(F.concat(F.lit("g"), F.substring(digest, 2, 63)))
    status = by_kind(text("running"), text(" Blocked"), text("cancelled"), text(None), text(""))
    return e.select(
        "event_id", policy.normal_mode(word, "scan").alias("scan"), policy.normal_mode(word, "browser").alias("browser"),
        policy.normal_mode(word, "sbom").alias("sbom"), policy.normal_mode(word, "spec_binding").alias("binding"),
        policy.normal_mode(word, "failure_policy").alias("failure"), policy.model_id(word, "default").alias("model"),
        policy.valid_hash(raw).alias("hash"), gates.is_terminal(status).alias("terminal"),
    )


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy document per event."""
    e = events(spark, sf_dir)
    n, k = F.col("event_id").cast("string"), F.col("k").cast("string")
    doc = by_kind(
        F.concat(
            F.lit('{"version":1,"spec_id":" s'), k, F.lit(' ","gates":[{"id":"security-scan","behavior":" ASK "},3,{"id":"static","hard":false},'),
            F.lit('{"id":"policy","enabled":true,"config":{"forbid_patterns":[{"pattern":" p'), n,
            F.lit(' ","severity":"p1","in":"*.ts","behavior":"Allow"},{"pattern":" "},5],"coverage_min":"0.5"}}],"policy":{"forbid_patterns":[{"pattern":"no"}]}}'),
        ),
        F.lit('{"version":2}'),
        F.concat(
            F.lit('{"gates":[{"id":"llm-judge","enabled":1},{"id":"llm_judge","enabled":0,"behavior":7},{"id":"other"}],"policy":{"forbid_patterns":['),
            F.lit('{"pattern":"q","message":"m'), k, F.lit('"}],"coverage_min":'), k,
            F.lit('},"severity_gate":{"block_on":[" p0 ",""],"soft_warn":[]}}'),
        ),
        F.lit('{"version":"x"}'),
        F.lit('["no policy"]'),
    )
    return pinned(e, run_id=n, payload=doc).select("run_id", "payload")


@query(
    "policy_load",
    f"""SELECT CAST(event_id AS VARCHAR) AS run_id, CASE kind WHEN 'error' THEN 'policy schema version is newer than supported'
          WHEN 'signup' THEN 'policy version must be an integer' WHEN 'view' THEN 'policy root must be a mapping' END AS load_error,
          CASE kind WHEN 'click' THEN 's' || k END AS spec_id, CASE kind WHEN 'click' THEN 0.5 WHEN 'purchase' THEN CAST(k AS DOUBLE) END AS coverage_min,
          CASE kind WHEN 'click' THEN 'P0,P1' WHEN 'purchase' THEN 'P0' END AS block_on, CASE WHEN kind IN ('click', 'purchase') THEN 'P2' END AS soft_warn
        FROM ({EVENTS_SQL})""",
)
def policy_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = policy.read_policies(policies(spark, sf_dir))
    return read.select(
        "run_id", "load_error", "spec_id", "coverage_min", F.array_join("block_on", ",").alias("block_on"),
        F.array_join("soft_warn", ",").alias("soft_warn"),
    )


_GATES_SQL = """(VALUES ('ownership', false, 'deny'), ('locks', false, 'deny'), ('static_analysis', true, 'deny'), ('security', true, 'deny'),
    ('policy', false, 'deny'), ('scoped_tests', false, 'deny'), ('llm_judge', false, 'allow')) AS g(gate_id, enabled, behavior)"""


@query(
    "policy_gates",
    f"""SELECT *, behavior = 'deny' AS hard FROM (SELECT CAST(event_id AS VARCHAR) AS run_id, gate_id,
          CASE WHEN kind = 'click' AND gate_id = 'policy' THEN true ELSE enabled END AS enabled,
          CASE WHEN kind = 'click' AND gate_id = 'security' THEN 'ask' WHEN kind = 'click' AND gate_id = 'static_analysis' THEN 'allow' ELSE behavior END AS behavior
        FROM ({EVENTS_SQL}), {_GATES_SQL} WHERE kind IN ('click', 'purchase'))""",
)
def policy_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.policy_gates(policy.read_policies(policies(spark, sf_dir))).select("run_id", "gate_id", "enabled", "behavior", "hard")


@query(
    "policy_rules",
    f"""SELECT CAST(event_id AS VARCHAR) AS run_id, CAST(1 AS BIGINT) AS rule_no, CASE kind WHEN 'click' THEN 'p' || event_id ELSE 'q' END AS pattern,
          CASE kind WHEN 'click' THEN 'P1' ELSE 'P2' END AS severity, CASE kind WHEN 'click' THEN '' ELSE 'm' || k END AS message,
          CASE kind WHEN 'click' THEN '*.ts' END AS in_glob, CASE kind WHEN 'click' THEN 'allow' ELSE 'deny' END AS behavior
        FROM ({EVENTS_SQL}) WHERE kind IN ('click', 'purchase')""",
)
def policy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = policy.policy_rules(policy.read_policies(policies(spark, sf_dir)))
    return rules.withColumn("rule_no", F.col("rule_no").cast("long"))


@query(
    "tool_switches",
    f"""SELECT event_id, kind NOT IN ('click', 'signup') AS osv, kind <> 'view' AS prettier,
          CAST(CASE kind WHEN 'error' THEN 0.9 END AS DOUBLE) AS floor_p0, CAST(CASE kind WHEN 'error' THEN 0.5 WHEN 'view' THEN 1.0 END AS DOUBLE) AS floor_p2 FROM ({EVENTS_SQL})""",
)
def tool_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = by_kind(
        text('{"osv-scanner":{"enabled":0},"prettier":1}'),
        text('{"osv_scanner":{},"osv-scanner":false,"confidence_floors":{"P0":"0.9","p2":0.5,"P3":"x"},"prettier":"no"}'),
        text('{"prettier":[1]}'), text('{"osv_scanner":""}'), text('{"prettier":{"enabled":null},"confidence_floors":{"P2":0,"p2":1}}'),
    )
    v = F.col("v")
    floors = policy.confidence_floors(v)
    return pinned(events(spark, sf_dir), v=V.parse(doc)).select(
        "event_id",
        policy.tool_enabled(v, ("osv_scanner", "osv-scanner"), True).alias("osv"),
        policy.tool_enabled(v, ("prettier",), True).alias("prettier"),
        F.try_element_at(floors, F.lit("P0")).alias("floor_p0"),
        F.try_element_at(floors, F.lit("P2")).alias("floor_p2"),
    )


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per event: safe, unsafe, invalid, back-referencing or, for some, too long."""
    k = F.col("k")
    pattern = by_kind(
        F.concat(F.lit("((click"), k.cast("string"), F.lit("+))+$")),
        F.repeat(F.lit("error"), k + 40),
        F.concat(F.lit("(pay"), k.cast("string"), F.lit(")\\1")),
        F.concat(F.lit("(signup"), k.cast("string")),
        F.concat(F.lit(r"\bview[0-9]{"), k.cast("string"), F.lit(r"}(?:[(+]|\))?[*]")),
    )
    return events(spark, sf_dir).select(
        "run_id", F.col("event_id").alias("rule_no"), pattern.alias("pattern"), F.lit("P2").alias("severity"),
        F.lit("").alias("message"), F.lit(None).cast("string").alias("in_glob"), F.lit("deny").alias("behavior"),
    )


_LINT_SQL = f"""
    SELECT run_id, event_id, CASE kind WHEN 'click' THEN 'unsafe-regex' WHEN 'purchase' THEN 'unsafe-regex' WHEN 'signup' THEN 'invalid-regex'
        WHEN 'error' THEN CASE WHEN 5 * (k + 40) > 500 THEN 'unsafe-regex' END ELSE 'unsafe-regex' END AS bad,
      CASE kind WHEN 'error' THEN 'pattern length ' || 5 * (k + 40) || ' exceeds 500 characters'
        WHEN 'purchase' THEN 'backreferences are not allowed in policy forbid patterns'
        WHEN 'signup' THEN 'missing ), unterminated subpattern at position 0'
        ELSE 'quantified groups containing nested groups, quantifiers, or alternation are not allowed in policy forbid patterns' END AS why
    FROM ({EVENTS_SQL})"""


@query(
    "rule_lint",
    f"""SELECT run_id, 'policy:forbid-pattern:' || event_id || ':' || bad AS rule_id,
          CASE bad WHEN 'unsafe-regex' THEN 'Unsafe' ELSE 'Invalid' END || ' policy forbid pattern' AS title,
          'Pattern ' || event_id || CASE bad WHEN 'unsafe-regex' THEN ' was rejected before scanning: ' ELSE ' failed to compile: ' END || why AS description,
          'P1' AS severity, 'deny' AS decision FROM ({_LINT_SQL}) WHERE bad IS NOT NULL""",
)
def rule_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rejected_rules(prepare_rules(rule_table(spark, sf_dir)))
    return found.select("run_id", "rule_id", "title", "description", "severity", "decision")


@query(
    "pr_number",
    f"""SELECT event_id, n AS pr_number, n IS NOT NULL AS resolved FROM (SELECT event_id, CAST(CASE WHEN k >= 95 THEN 7 WHEN k = 0 THEN NULL
          WHEN kind = 'view' AND k < 50 THEN NULL WHEN kind = 'signup' AND k >= 50 THEN NULL ELSE k END AS BIGINT) AS n FROM ({EVENTS_SQL}))""",
)
def pr_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    k = F.col("k").cast("string")
    doc = by_kind(
        F.concat(F.lit('{"pull_request":{"number":'), k, F.lit('},"issue":{"number":1}}')),
        F.concat(F.lit('{"pull_request":{"number":"9"},"issue":{"pull_request":{},"number":'), k, F.lit("}}")),
        F.concat(F.lit('{"issue":{"number":3},"check_run":{"pull_requests":[{"number":'), k, F.lit("},{}]}}")),
        F.when(F.col("k") < 50, F.concat(F.lit('{"inputs":{"pr_number":" '), k, F.lit(' "}}'))).otherwise("{not json"),
        F.when(F.col("k") < 50, F.concat(F.lit('{"issue":{"number":'), k, F.lit("}}"))).otherwise(
            F.concat(F.lit('{"check_run":{"pull_requests":[]},"inputs":{"pr_number":'), k, F.lit("}}"))
        ),
    )
    rows = e.select("event_id", doc.alias("payload"), F.when(F.col("k") >= 95, 7).alias("override"))
    return E.resolve_pr_numbers(rows).select("event_id", "pr_number", "resolved")
