"""Registration of queries with the SQL that states them."""

from __future__ import annotations


def registry():
    """(queries, oracles, decorator): the decorator files a query under its function's name."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
