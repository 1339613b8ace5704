"""Policy documents to rows: gate switches, rules, limits. One narrow pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftwork.functions import variants as V
from siftwork.functions.numbers import lenient_double, whole_long
from siftwork.functions.text import strip
from siftwork.plans.pin import exploded, pinned
from siftwork.schemas import DECISIONS, SEVERITIES

# Newest schema version, gates with (enabled, behaviour) defaults, and gate aliases.
SCHEMA_VERSION = 1
GATE_DEFAULTS = {
    "ownership": (False, "deny"),
    "locks": (False, "deny"),
    "static_analysis": (True, "deny"),
    "security": (True, "deny"),
    "policy": (False, "deny"),
    "scoped_tests": (False, "deny"),
    "llm_judge": (False, "allow"),
}
GATE_ALIASES = {"security_scan": "security", "static": "static_analysis"}


def _behavior_at(v: Column, path: str) -> Column:
    """Behaviour word at ``path``: null if there is none, empty if it is not one of the three."""
    item = F.to_json(F.try_variant_get(v, path, "variant"))
    word = F.lower(strip(F.regexp_extract(item, '^"(.*)"$', 1)))
    return F.when(item != "null", F.when(word.isin(*DECISIONS), word).otherwise(""))


def gate_name(v: Column) -> Column:
    name = F.replace(strip(F.coalesce(V.text_at(v, "$.id"), F.lit(""))), F.lit("-"), F.lit("_"))
    for alias, target in GATE_ALIASES.items():
        name = F.regexp_replace(name, f"^{alias}$", target)
    return name


def _entry(g: Column) -> Column:
    """What a policy document says about one gate."""
    return F.struct(
        gate_name(g).alias("name"),
        V.truthy(g, "$.enabled", F.lit(None).cast("boolean")).alias("enabled"),
        _behavior_at(g, "$.behavior").alias("behavior"),
        F.when(F.to_json(F.try_variant_get(g, "$.hard", "variant")) != "null", V.truthy(g, "$.hard", F.lit(True))).alias("hard"),
        F.try_variant_get(g, "$.config", "variant").alias("config"),
    )


def _resolved(entry: Column, default: Column) -> Column:
    """Gate switch: explicit behaviour, else the legacy ``hard`` flag, else the gate's default."""
    said = F.nullif(entry["behavior"], F.lit(""))
    legacy = F.when(entry["behavior"].isNull(), F.when(entry["hard"], "deny").when(~entry["hard"], "allow"))
    behavior = F.coalesce(said, legacy, default["behavior"])
    return F.struct(
        default["gate_id"].alias("gate_id"),
        F.coalesce(entry["enabled"], default["enabled"]).alias("enabled"),
        (behavior == "deny").alias("hard"),
        behavior.alias("behavior"),
        entry["config"].alias("config"),
    )


def _switches(entries: Column) -> Column:
    """All gates, each with the last entry that names it."""
    defaults = F.array(
        *[
            F.struct(F.lit(g).alias("gate_id"), F.lit(on).alias("enabled"), F.lit(b).alias("behavior"))
            for g, (on, b) in GATE_DEFAULTS.items()
        ]
    )
    paired = F.transform(
        defaults,
        lambda d: F.struct(
            d.alias("d"), F.get(F.reverse(F.filter(entries, lambda e: e["name"] == d["gate_id"])), F.lit(0)).alias("e")
        ),
    )
    return F.transform(paired, lambda p: _resolved(p["e"], p["d"]))


def load_error(v: Column) -> Column:
    """Why a policy cannot be used, or null. Such a policy fails closed: it yields no gates."""
    version = F.when(~V.has(v, "$.version"), F.lit(SCHEMA_VERSION)).otherwise(V.int_at(v, "$.version"))
    text_is_whole = whole_long(V.text_at(v, "$.version")).isNotNull()
    is_text = V.kind(F.try_variant_get(v, "$.version", "variant")) == "STRING"
    return (
        F.when(v.isNull(), "policy is not JSON")
        .when(~V.is_object(v), "policy root must be a mapping")
        .when(version.isNull() | F.coalesce(is_text & ~text_is_whole, F.lit(False)), "policy version must be an integer")
        .when(version > SCHEMA_VERSION, "policy schema version is newer than supported")
    )


def read_policies(policies: DataFrame) -> DataFrame:
    """Policy texts ``(run_id, payload)`` with ``load_error``, ``gates`` (all seven) and list columns."""
    df = pinned(policies.select("run_id", "payload"), _v=V.parse(F.col("payload")))
    df = df.withColumn("load_error", load_error(F.col("_v")))
    df = df.withColumn("_v", F.when(F.col("load_error").isNull(), F.col("_v")))
    df = pinned(df, _gates=F.transform(V.objects(V.array_at(F.col("_v"), "$.gates")), _entry))

    def words(path: str, default: tuple[str, ...]) -> Column:
        items = F.filter(
            F.transform(V.array_at(F.col("_v"), path), lambda x: F.upper(strip(F.coalesce(V.text_at(x, "$"), F.lit(""))))),
            lambda s: s != "",
        )
        return F.when(F.size(items) > 0, items).otherwise(F.array(*[F.lit(d) for d in default]))

    first_policy = F.get(F.filter("_gates", lambda g: g["name"] == "policy"), F.lit(0))
    df = df.withColumn("_own", first_policy["config"])
    # A key in the gate's own config wins over the top-level block, even if its value is useless.
    for key in ("forbid_patterns", "coverage_min"):
        own = F.try_variant_get("_own", f"$.{key}", "variant")
        df = df.withColumn(f"_{key}", F.coalesce(own, F.try_variant_get("_v", f"$.policy.{key}", "variant")))
    ok = F.col("load_error").isNull()
    return df.select(
        "run_id",
        "load_error",
        F.when(ok, F.coalesce(V.int_at(F.col("_v"), "$.version"), F.lit(SCHEMA_VERSION))).alias("version"),
        F.nullif(strip(V.text_at(F.col("_v"), "$.spec_id")), F.lit("")).alias("spec_id"),
        F.when(ok, _switches(F.col("_gates"))).alias("gates"),
        V.array_at(F.col("_forbid_patterns")).alias("rule_items"),
        lenient_double(V.text_at(F.col("_coverage_min"), "$")).alias("coverage_min"),
        F.when(ok, words("$.severity_gate.block_on", ("P0", "P1"))).alias("block_on"),
        F.when(ok, words("$.severity_gate.soft_warn", ("P2",))).alias("soft_warn"),
    )


def policy_gates(read: DataFrame) -> DataFrame:
    """One row per run and gate."""
    return exploded(read, ["run_id"], F.col("gates"), "_pos", "_g").select("run_id", "_g.*")


def policy_rules(read: DataFrame) -> DataFrame:
    """One row per usable rule, numbered in document order."""

    def one(x: Column) -> Column:
        glob = strip(F.coalesce(V.text_at(x, "$.in"), F.lit("")))
        return F.struct(
            strip(F.coalesce(V.text_at(x, "$.pattern"), F.lit(""))).alias("pattern"),
            F.upper(F.coalesce(F.nullif(V.text_at(x, "$.severity"), F.lit("")), F.lit("P2"))).alias("severity"),
            F.coalesce(V.text_at(x, "$.message"), F.lit("")).alias("message"),
            F.nullif(glob, F.lit("")).alias("in_glob"),
            F.coalesce(F.nullif(_behavior_at(x, "$.behavior"), F.lit("")), F.lit("deny")).alias("behavior"),
        )

    usable = F.filter(F.transform(V.objects(F.col("rule_items")), one), lambda r: r["pattern"] != "")
    rows = exploded(read, ["run_id"], usable, "_pos", "_r")
    return rows.select("run_id", (F.col("_pos") + 1).alias("rule_no"), "_r.*")


def tool_enabled(config: Column, keys: tuple[str, ...], default: bool) -> Column:
    """First key present decides: a boolean, an object's ``enabled``, or any true value."""
    out = F.lit(default)
    for key in reversed(keys):
        path = f"$['{key}']"
        item = F.try_variant_get(config, path, "variant")
        value = F.when(
            V.kind(item).startswith("OBJECT"), V.truthy(item, "$.enabled", F.lit(True))
        ).otherwise(V.truthy(config, path, F.lit(default)))
        out = F.when(item.isNotNull(), value).otherwise(out)
    return out


def confidence_floors(config: Column, path: str = "$.confidence_floors") -> Column:
    """Map severity to floor; upper- or lower-case keys, values that are not numbers left out."""

    def floor(s: str) -> Column:
        upper, lower = (V.text_at(config, f"{path}.{k}") for k in (s, s.lower()))
        usable = F.nullif(F.nullif(upper, F.lit("")), F.lit("0"))
        return lenient_double(F.coalesce(usable, lower))

    entries = F.array(*[F.struct(F.lit(s).alias("key"), floor(s).alias("value")) for s in SEVERITIES])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


# ---- option words ----

# Accepted words of each option, the canonical word and the default.
MODES: dict[str, tuple[dict[str, str], str]] = {
    "scan": (
        {
            **dict.fromkeys(("baseline", "baseline-only", "baseline_scan", "baseline-scan"), "baseline"),
            **dict.fromkeys(
                (
                    "audit", "audit-full", "audit_full", "full-depth", "full_depth", "full-depth-13", "full_depth_13",
                    "full",
                ),
                "full-depth",
            ),
        },
        "deep-scan",
    ),
    "browser": (
        {
            **dict.fromkeys(("baseline", "smoke", "pr"), "baseline"),
            **dict.fromkeys(("audit", "deep", "full", "full-depth"), "audit"),
        },
        "off",
    ),
    "sbom": (
        {
            **dict.fromkeys(("baseline", "smoke", "pr"), "baseline"),
            **dict.fromkeys(("audit", "deep", "full", "full-depth"), "audit"),
        },
        "off",
    ),
    "spec_binding": ({w: w for w in ("explicit", "auto_discovered")}, "none"),
    "failure_policy": ({w: w for w in ("block", "warn", "ignore", "deterministic_only")}, "block"),
}


def normal_mode(value: Column, option: str) -> Column:
    words, default = MODES[option]
    v = F.lower(strip(F.coalesce(value, F.lit(""))))
    by_target: dict[str, list[str]] = {}
    for word, target in words.items():
        by_target.setdefault(target, []).append(word)
    out = F.lit(default)
    for target, spelled in by_target.items():
        out = F.when(v.isin(*spelled), target).otherwise(out)
    return out


def model_id(value: Column, default: str) -> Column:
    v = strip(F.coalesce(value, F.lit("")))
    return F.when(v.rlike(r"^[A-Za-z0-9._:\-]{1,128}\z"), v).otherwise(default)


def valid_hash(value: Column) -> Column:
    v = F.lower(strip(value))
    return F.when(v.rlike(r"^[0-9a-f]{64}\z"), v)
