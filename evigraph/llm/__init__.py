"""Operators of a training-data pipeline. Nothing outside this folder imports it, except the guarded entry file."""

from __future__ import annotations

from evigraph.llm import queries as _queries

queries = _queries.all_queries
checks = _queries.all_checks
