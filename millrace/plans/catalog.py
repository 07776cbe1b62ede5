"""Registered queries and the SQL that each is held against."""

from __future__ import annotations

from millrace.plans import conformance, evaluation, graph_queries, search_queries

_PARTS = (search_queries, graph_queries, evaluation, conformance)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracle_sql().items()}
