"""All queries of the core and the SQL they are held against."""

from __future__ import annotations

from loomtime.plans import data_queries, series_queries, verb_queries

_PARTS = (data_queries, series_queries, verb_queries)


def queries() -> dict:
    return {name: q for part in _PARTS for name, q in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for part in _PARTS for name, q in part.oracle_sql().items()}
