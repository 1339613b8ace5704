"""Pull request number of CI event payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftwork.functions import variants as V
from siftwork.functions.text import strip
from siftwork.plans.pin import let, pinned


def pr_number(v: Column, override: Column) -> Column:
    """First positive whole number of: override, pull request, issue of a pull request, first pull
    request of the check run, dispatch input. Null where none is given."""

    def whole(path: str) -> Column:
        n = F.try_variant_get(v, path, "long")
        return F.when(V.is_whole(v, path) & (n > 0), n)

    from_issue = F.when(V.is_object(F.try_variant_get(v, "$.issue.pull_request", "variant")), whole("$.issue.number"))
    typed = strip(V.text_at(v, "$.inputs.pr_number"))
    typed_n = F.when(typed.rlike("^[0-9]+$"), typed.try_cast("long"))
    return F.coalesce(
        F.when(override > 0, override.cast("long")),
        whole("$.pull_request.number"),
        from_issue,
        whole("$.check_run.pull_requests[0].number"),
        F.when(typed_n > 0, typed_n),
    )


def resolve_pr_numbers(events: DataFrame) -> DataFrame:
    """Events ``(payload, override, ...)`` with ``pr_number`` and ``resolved``."""
    n = let(V.parse(F.col("payload")), lambda v: pr_number(v, F.col("override")))
    return pinned(events, pr_number=n).withColumn("resolved", F.col("pr_number").isNotNull())
