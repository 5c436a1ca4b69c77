"""Check queries: every operator run on the applicant table, with the SQL that must agree with it."""

from __future__ import annotations

import importlib

MODULES = ("primitives", "rows", "tables", "quality", "fitted", "models", "selection", "explanation", "flows", "governance")


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"catalog.{module}")


def all_queries() -> dict:
    _load()
    from catalog.registry import QUERIES

    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    from catalog.registry import ORACLES

    return dict(ORACLES)
