"""All registered queries by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ["series", "trading", "news", "texts", "models", "writes", "job_queries"]


def queries() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for module in MODULES:
        found.update(importlib.import_module(f"newsignal.plans.{module}").QUERIES)
    return found
