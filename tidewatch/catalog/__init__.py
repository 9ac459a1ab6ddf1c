"""Every registered query with the SQL that checks it."""

from __future__ import annotations

from tidewatch.catalog import base

MODULES = ["scalars", "joins", "reports", "analysis", "star", "measures", "graph", "traversal", "governance", "incremental", "landing", "coverage"]


def load() -> dict[str, base.Entry]:
    import importlib

    for m in MODULES:
        try:
            importlib.import_module(f"tidewatch.catalog.{m}")
        except ModuleNotFoundError as missing:
            if missing.name != f"tidewatch.catalog.{m}":
                raise
    return base.REGISTRY
