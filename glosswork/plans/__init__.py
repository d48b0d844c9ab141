"""Registered queries with their SQL counterparts, gathered from the modules of this package."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        yield importlib.import_module(f"{__name__}.{info.name}")


def queries() -> dict:
    """Name -> function of (spark, sf_dir), over all modules."""
    return {k: f for m in _modules() for k, f in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL, over all modules."""
    return {k: q for m in _modules() for k, q in getattr(m, "ORACLES", {}).items()}
