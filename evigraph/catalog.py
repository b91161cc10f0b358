"""All registered queries."""

from __future__ import annotations

import importlib

from evigraph.queries.registry import CHECKS, QUERIES, Query

MODULES = ("graph", "storage", "questions", "text", "documents", "curation", "retrieval", "evaluation", "incremental")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"evigraph.queries.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def checks() -> dict[str, str]:
    _load()
    return dict(CHECKS)
