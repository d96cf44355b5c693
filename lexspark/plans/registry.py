"""All queries over the driver's tables, gathered from the query modules."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None):
    """Decorator: registers a query function under a name, with its DuckDB SQL."""

    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return keep


def queries() -> dict:
    from . import candidate_queries, corpus_queries, lexicon_queries, source_queries, string_queries  # noqa: F401  they register their queries

    return dict(QUERIES)


def oracle_sql() -> dict:
    queries()
    return dict(ORACLE)
