"""All queries of the core with their SQL; the optional subpackage adds its own in __spark_entry__.py."""

from __future__ import annotations

from . import graph_data, graph_queries, log_queries, overlay_queries

MODULES = [graph_data, log_queries, graph_queries, overlay_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
