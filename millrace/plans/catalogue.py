"""All queries of the engine's own operators."""

from __future__ import annotations

from millrace.plans import index_queries, more_queries, registry, retrieval_queries, state_queries, table_queries, text_queries  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
