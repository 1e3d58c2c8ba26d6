"""Decorator that files a query and its SQL under the function's name."""

from __future__ import annotations


def registry():
    queries, oracles = {}, {}

    def query(sql: str | None = None, name: str | None = None):
        def register(function):
            key = name or function.__name__
            queries[key] = function
            if sql is not None:
                oracles[key] = sql
            return function

        return register

    return queries, oracles, query
