"""All registered queries of the graph engine with their SQL."""

from __future__ import annotations

import importlib

#: Modules with ``QUERIES`` (name to callable) and ``ORACLE`` (name to SQL).
_MODULES: tuple[str, ...] = ("graph", "resolve", "texts", "facts")


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(importlib.import_module(f"evigraph.plans.{m}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(importlib.import_module(f"evigraph.plans.{m}").ORACLE)
    return out
