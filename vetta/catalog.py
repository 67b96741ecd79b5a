"""The registered queries and the SQL that gives the same rows.

A query is a function of (spark, sf_dir); @query names the SQL, and the derived
views that it reads, which are put before it.
"""

from __future__ import annotations

from collections.abc import Callable

from vetta.plans.fixtures import duckdb_ctes

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            head = duckdb_ctes(views)
            if body.startswith("with recursive "):
                body, head = f"with {body[15:]}", f"recursive {head}"
            ORACLE[f.__name__] = f"with {head}, {body[5:]}" if body.startswith("with ") and head else f"with {head} {body}" if head else body
        return f

    return register


# Modules that register their queries.
from vetta.plans import code_queries, findings_queries, io_queries, text_queries  # noqa: E402, F401
