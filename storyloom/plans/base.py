"""Registration of queries beside their SQL."""

from __future__ import annotations

from storyloom.sources.views import with_views


def registry():
    """(queries by name, SQL by name, decorator that adds to both)."""
    queries, sqls = {}, {}

    def query(sql: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = with_views(sql)
            return f

        return register

    return queries, sqls, query
