"""Registry of runnable queries and their oracle statements."""

from __future__ import annotations

from palimpsest.plans.fixtures import Tables, oracle
from palimpsest.session import configure

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional oracle."""
    def register(fn):
        def run(spark, folder):
            return fn(Tables(configure(spark), folder))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = oracle(sql)
        return fn
    return register
