"""Collects every registered query (batch, model, streaming)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _load():
    from . import catalog, model_queries  # noqa: F401  (importing registers)
    from ..streaming import stream_queries  # noqa: F401
    return catalog.REGISTRY


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in _load().items()}


def all_oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in _load().items() if q.sql is not None}
