"""Derived inputs, registered queries and their checking SQL."""

from __future__ import annotations

import importlib

_MODULES = ("scalar_queries", "table_queries", "source_queries", "export_queries")


def _load():
    from postmill.checks import catalog

    for name in _MODULES:
        importlib.import_module(f"postmill.checks.{name}")
    return catalog


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_load().ORACLES)
