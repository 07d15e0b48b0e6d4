"""The queries of this subpackage and the SQL forms of those that have one."""

from __future__ import annotations

from lorekiln.llm import bitext_queries, containers_queries, langid_queries, neighbours_queries, private_queries, scans_queries, splitting_queries

MODULES = (scans_queries, bitext_queries, langid_queries, splitting_queries, neighbours_queries, containers_queries, private_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
