"""Facts about a repository from its file table: spec files, content hash, stack, layout, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftwork.functions import variants as V
from siftwork.functions.paths import base_name, hygiene_reason, slashed
from siftwork.functions.text import ascii_json, line_array, normal_form, shorten, strip
from siftwork.plans.pin import pinned
from siftwork.plans.ranking import first_per_group, top_per_group

# What makes a file a specification candidate, and the limits.
SPEC_SUFFIXES = (".md", ".markdown", ".txt", ".yml", ".yaml", ".json")
SPEC_NAMES = ("spec.md", "specification.md", "requirements.md", "swe_excellence_framework.md")
SPEC_WORDS = ("spec", "requirement", "design")
SPEC_SKIP_DIRS = (".git", ".venv", "venv", "node_modules", "dist", "build", "__pycache__")
SPEC_MAX_FILES = 24
SPEC_MAX_BYTES = 512_000


def clean_paths(paths: DataFrame) -> DataFrame:
    """Safe paths of ``(run_id, seq, path)``: forward slashes, trimmed, first per path without case."""
    safe = paths.filter(hygiene_reason(F.col("path")).isNull()).withColumn("path", strip(slashed(F.col("path"))))
    low = safe.filter(F.col("path") != "").withColumn("path_key", F.lower("path"))
    return first_per_group(low, ["run_id", "path_key"], [F.col("seq"), F.col("path")])


def is_spec_candidate(path: Column, size: Column) -> Column:
    name = F.lower(base_name(path))
    folders = F.split(path, "/")
    folders = F.slice(folders, F.lit(1), F.size(folders) - 1)
    suffix = F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1)
    words = name.isin(*SPEC_NAMES)
    for w in SPEC_WORDS:
        words = words | name.contains(w)
    skipped = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in SPEC_SKIP_DIRS]))
    return suffix.isin(*SPEC_SUFFIXES) & words & (size <= SPEC_MAX_BYTES) & ~skipped


def spec_score(path: Column, own_dir: str = ".gate/") -> Column:
    """Rank tier of a candidate; ``own_dir`` is the folder the gate keeps its own files in."""
    p = F.lower(strip(slashed(path)))
    name = base_name(p)
    return (
        F.when(name.isin(*SPEC_NAMES), 0)
        .when(p.startswith(own_dir), 10)
        .when(p.contains("system designs and specifications/"), 20)
        .when(p.startswith("docs/") & name.contains("spec"), 30)
        .when(name.contains("spec"), 40)
        .when(name.contains("requirement"), 50)
        .when(p.contains("design"), 60)
        .otherwise(90)
    )


def discover_specs(files: DataFrame, limit: int = SPEC_MAX_FILES) -> DataFrame:
    """Best specification files per run of ``(run_id, path, size, ...)`` with ``score`` and ``rank``."""
    found = files.filter(is_spec_candidate(F.col("path"), F.col("size"))).withColumn("seq", F.lit(0))
    unique = clean_paths(found).drop("seq").withColumn("score", spec_score(F.col("path")))
    return top_per_group(unique, ["run_id"], [F.col("score"), F.col("path_key")], limit, rank="rank")


def spec_counts(files: DataFrame, limit: int = SPEC_MAX_FILES) -> DataFrame:
    """Per run: specification candidates, and how many of them ``discover_specs`` leaves out."""
    found = clean_paths(files.filter(is_spec_candidate(F.col("path"), F.col("size"))).withColumn("seq", F.lit(0)))
    n = found.groupBy("run_id").agg(F.count(F.lit(1)).alias("candidates"))
    return n.withColumn("omitted", F.greatest(F.col("candidates") - limit, F.lit(0)).cast("long"))


def content_hash(text: Column) -> Column:
    """SHA-256 of the normal form; null for text that is empty by then."""
    return F.nullif(F.sha2(normal_form(text), 256), F.sha2(F.lit("").cast("binary"), 256))


def manifest_hash(sources: DataFrame, files: DataFrame) -> DataFrame:
    """One hash per run over its source list and the contents of those files.

    ``sources(run_id, seq, path)`` is a run's list, either ``discover_specs`` (at most 24 paths) or
    an explicit list that came in one input row, so a run's manifest is small by construction.
    ``files(run_id, path, text)`` is joined on the path; only path and hash go on from there.
    """
    wanted = clean_paths(sources).select("run_id", "path", "path_key")
    hashed = pinned(files.join(wanted, ["run_id", "path"]), content_hash=content_hash(F.col("text"))).drop("text")
    entry = F.struct("path_key", F.struct("content_hash", "path").alias("e"))
    listed = hashed.filter(F.col("content_hash").isNotNull()).groupBy("run_id").agg(
        F.sort_array(F.collect_list(entry)).alias("_list")
    )
    manifest = F.to_json(F.transform("_list", lambda x: x["e"]))
    # A run none of whose files has content has no hash.
    every = sources.select("run_id").distinct().join(listed, "run_id", "left")
    return every.select(
        "run_id",
        F.coalesce(F.size("_list"), F.lit(0)).cast("long").alias("files"),
        F.when(F.col("_list").isNotNull(), F.sha2(ascii_json(manifest), 256)).alias("manifest_hash"),
    )


def dependency_keys(payload: Column) -> Column:
    """Names under ``dependencies`` and ``devDependencies`` of a package file."""
    v = V.parse(payload)

    def keys(path: str) -> Column:
        return F.coalesce(
            F.map_keys(F.try_variant_get(v, path, "map<string,variant>")), F.array().cast("array<string>")
        )

    return F.array_union(keys("$.dependencies"), keys("$.devDependencies"))


def stack_tags(files: DataFrame) -> DataFrame:
    """Technology tags per run of ``(run_id, path, text)``, fixed order, at most six."""
    path, name = F.col("path"), base_name(F.col("path"))
    # Only the package file's text is parsed.
    deps = F.when(path == "package.json", F.lower(F.array_join(dependency_keys(F.col("text")), " ")))
    tests = {
        "Node.js": path == "package.json",
        "Next.js": deps.contains("next") | path.isin("next.config.js", "next.config.mjs"),
        "React": deps.contains("react"),
        "TypeScript": path.endswith(".ts") | (path == "tsconfig.json"),
        "Python": path.isin("pyproject.toml", "requirements.txt"),
        "Terraform": path.endswith(".tf"),
        "Docker": name == "Dockerfile",
    }
    seen = files.groupBy("run_id").agg(
        *[F.coalesce(F.bool_or(t), F.lit(False)).alias(f"_{i}") for i, t in enumerate(tests.values())]
    )
    tags = F.slice(
        F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(t)) for i, t in enumerate(tests)])), 1, 6
    )
    return seen.select(
        "run_id", F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("unspecified"))).alias("tags")
    )


# Folders that count as entry points, in display order.
ENTRY_FOLDERS = ("apps/web", "apps/api", "apps/dashboard", "server", "src", ".github/workflows", "infra", "packages")


def layout(files: DataFrame) -> DataFrame:
    """Layout label and entry points per run of ``(run_id, path)``."""
    path = F.col("path")

    def folder(name: str) -> Column:
        return path.startswith(name + "/")

    seen = files.groupBy("run_id").agg(
        F.bool_or(folder("apps")).alias("_apps"),
        F.bool_or(folder("packages")).alias("_packages"),
        F.bool_or(path.isin("pnpm-workspace.yaml", "turbo.json")).alias("_workspace"),
        *[F.bool_or(folder(n) | (path == n)).alias(f"_{i}") for i, n in enumerate(ENTRY_FOLDERS)],
    )
    points = F.slice(
        F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(n)) for i, n in enumerate(ENTRY_FOLDERS)])), 1, 6
    )
    label = (
        F.when(F.col("_workspace") | (F.col("_apps") & F.col("_packages")), "monorepo")
        .when(F.col("_apps"), "apps workspace")
        .otherwise("single repository")
    )
    shown = F.when(F.size(points) > 0, F.array_join(points, ", ")).otherwise("not inferred")
    return seen.select("run_id", label.alias("layout"), shown.alias("entry_points"))


# Readme names in order of preference.
README_NAMES = ("README.md", "readme.md", "README.txt")


def readme_label(files: DataFrame) -> DataFrame:
    """First heading or text line of a run's readme, for every run of ``(run_id, path, text)``."""
    path = F.col("path")
    order = F.lit(None).cast("int")
    for i, name in enumerate(README_NAMES):
        order = F.when(path == name, i).otherwise(order)
    cleaned = F.transform(line_array(F.col("text")), lambda x: strip(F.ltrim(strip(x), F.lit("#"))))
    # Only readme texts are split into lines.
    first = F.when(path.isin(*README_NAMES), F.get(F.filter(cleaned, lambda x: x != ""), F.lit(0)))
    label = F.concat(path, F.lit(": "), shorten(first, 120))
    best = files.groupBy("run_id").agg(F.min_by(label, F.when(first.isNotNull(), order)).alias("label"))
    return best.select("run_id", F.coalesce("label", F.lit("README: not found")).alias("label"))


def synopsis(files: DataFrame) -> DataFrame:
    """One sentence row per run from label, layout, stack and entry points."""
    parts = readme_label(files).join(layout(files), "run_id").join(stack_tags(files), "run_id")
    text = F.concat(
        F.col("label"), F.lit(". Architecture: "), F.col("layout"), F.lit(". Stack: "), F.array_join("tags", ", "),
        F.lit(". Entry points: "), F.col("entry_points"), F.lit("."),
    )
    return parts.select("run_id", text.alias("synopsis"))
