"""All queries of the engine itself, by name."""

from __future__ import annotations

import importlib
import pkgutil

import eventide.plans as plans


def load() -> tuple[dict, dict]:
    """Collect QUERIES and SQL of every module in eventide.plans."""
    queries, sql = {}, {}
    for found in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        if found.name == "catalog":
            continue
        module = importlib.import_module(f"eventide.plans.{found.name}")
        queries |= getattr(module, "QUERIES", {})
        sql |= getattr(module, "SQL", {})
    return queries, sql
