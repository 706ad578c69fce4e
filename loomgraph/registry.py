"""All core queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["loomgraph.operators.orphans", "loomgraph.operators.nested", "loomgraph.operators.stats", "loomgraph.functions.scoring", "loomgraph.operators.explore", "loomgraph.operators.resolve", "loomgraph.operators.iterate", "loomgraph.operators.falsify", "loomgraph.operators.rank", "loomgraph.operators.search", "loomgraph.sources.feeds", "loomgraph.streaming.ingest", "loomgraph.streaming.merge", "loomgraph.operators.display", "loomgraph.operators.paths", "loomgraph.operators.reports"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(m).QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(m).SQL.items()}
