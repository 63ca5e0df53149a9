"""Registered queries: each module pairs Spark plans with their SQL checks."""

import importlib
import pkgutil

from textloom.plans.registry import COVERAGE, ORACLES, QUERIES  # noqa: F401

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _module.endswith("_queries"):
        importlib.import_module(f"{__name__}.{_module}")
