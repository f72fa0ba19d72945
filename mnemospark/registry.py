"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemospark.queries import evaluation, ingestion, monitoring, reconcile, retrieval, scalars, store

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (scalars, retrieval, reconcile, monitoring, evaluation, ingestion, store)
QUERIES: dict[str, Query] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.SQL.items()}
FLAGSHIP = "hybrid_search"
