"""The same results as plain SQL over the same tables, for checking."""

from __future__ import annotations

import importlib

MODULES = ["series", "trading", "news", "texts", "models", "writes", "job_queries"]


def all_oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found.update(importlib.import_module(f"oracle.{module}").ORACLES)
    return found
