"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from siftwork.workloads.registry import QUERIES, SQL


def load() -> tuple[dict, dict]:
    """Import every query module and return (queries, sql)."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES, SQL
