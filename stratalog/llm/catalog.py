"""The queries of this subpackage, with SQL where there is any."""

from __future__ import annotations

from . import file_origin, langid, leaks, source_parse, token_ids

MODULES = [file_origin, source_parse, token_ids, leaks, langid]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
