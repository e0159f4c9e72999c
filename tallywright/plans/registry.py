"""All registered queries and the SQL they are compared with."""

from __future__ import annotations

from tallywright.plans import (
    document_queries, entry_queries, file_queries, ingest_queries, journal_queries, reconcile_queries, verification_queries,
)

MODULES = [
    journal_queries, entry_queries, file_queries, ingest_queries, document_queries, verification_queries, reconcile_queries,
]


def queries() -> dict:
    return {name: build for module in MODULES for name, build in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
