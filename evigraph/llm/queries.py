"""The registered queries of this folder with their check SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (
    "url_reputation",
    "language_id",
    "secret_scan",
    "bpe",
    "toxicity",
    "jaccard_join",
    "decontamination",
    "lm_scoring",
    "vector_search",
    "html_extraction",
    "collocations",
    "sentence_pieces",
    "vector_codes",
)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found |= importlib.import_module(f"evigraph.llm.{name}").QUERIES
    return found


def all_checks() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"evigraph.llm.{name}"), "CHECKS", {})
    return found
