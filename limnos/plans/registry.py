"""Decorator that registers a query with its DuckDB text."""

from __future__ import annotations


def registry():
    queries, oracle = {}, {}

    def query(name: str, sql: str | None = None):
        def add(fn):
            queries[name] = fn
            if sql:
                oracle[name] = sql
            return fn
        return add

    return queries, oracle, query
