"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = [f"loomgraph.llm.{m}" for m in ("ledger", "springrank", "components", "tokenize", "packing", "abuse", "history", "mapping")]


def _modules() -> list:
    found = []
    for m in MODULES:
        found.append(import_module(m))
    return found


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
