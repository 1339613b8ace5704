"""Quota facts from response headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftwork.functions.numbers import lenient_double, lenient_long
from siftwork.functions.text import strip
from siftwork.plans.pin import pinned

# Header names of each fact, in order of preference; compared without case.
HEADER_NAMES = {
    "status": ("ratelimit-unified-status", "anthropic-ratelimit-unified-status"),
    "util_5h": (
        "ratelimit-unified-5h-utilization",
        "anthropic-ratelimit-unified-5h-utilization",
        "x-ratelimit-unified-5h-utilization",
    ),
    "util_7d": (
        "ratelimit-unified-7d-utilization",
        "anthropic-ratelimit-unified-7d-utilization",
        "x-ratelimit-unified-7d-utilization",
    ),
    "resets_at": ("ratelimit-unified-reset", "anthropic-ratelimit-unified-reset", "x-ratelimit-reset"),
    "overage_status": ("overage-status", "ratelimit-overage-status", "anthropic-ratelimit-overage-status"),
    "retry_after_s": ("retry-after",),
}


def folded(headers: Column) -> Column:
    """Lower-case names and values of a header map, last spelling first."""
    return F.struct(
        F.reverse(F.transform(F.map_keys(headers), F.lower)).alias("names"),
        F.reverse(F.map_values(headers)).alias("values"),
    )


def header(fold: Column, names: tuple[str, ...]) -> Column:
    """First non-blank value under any of ``names``; a later spelling of one name wins."""

    def one(name: str) -> Column:
        value = F.get(fold["values"], (F.array_position(fold["names"], name) - 1).cast("int"))
        return F.when(strip(value) != "", value)

    return F.coalesce(*[one(n) for n in names])


def with_quota_facts(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Add the six facts as columns, each header map folded and each header looked up once."""
    raw = {fact: header(F.col("_fold"), names) for fact, names in HEADER_NAMES.items()}
    facts = {
        "status": raw["status"],
        "util_5h": lenient_double(raw["util_5h"]),
        "util_7d": lenient_double(raw["util_7d"]),
        "resets_at": lenient_long(raw["resets_at"]),
        "overage_status": raw["overage_status"],
        "retry_after_s": lenient_long(raw["retry_after_s"]),
    }
    return pinned(pinned(df, _fold=folded(F.col(headers))), **facts).drop("_fold")


def has_quota_facts(status: Column, util_5h: Column, util_7d: Column, resets_at: Column) -> Column:
    used = util_5h.isNotNull() | util_7d.isNotNull()
    return status.isNotNull() | (used & resets_at.isNotNull())
