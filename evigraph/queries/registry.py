"""Pairs of a Spark query and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evigraph.sources import star

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def check(views: str, body: str) -> str:
    """SQL with the named views in front. ``body`` may start with its own WITH list."""
    body = body.strip()
    ctes = [f"{v} AS ({star.check_view(v)})" for v in views.split()]
    if body[:5].upper() == "WITH ":
        ctes.append(body[5:])
        return "WITH RECURSIVE " + ",\n".join(ctes)
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(key: str, views: str = "", sql: str | None = None):
    """Register a query; ``sql`` is its check, absent where SQL cannot state it at scale."""

    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            CHECKS[key] = check(views, sql)
        return fn

    return register
