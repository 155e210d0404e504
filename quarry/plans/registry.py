"""Registry of named queries: a Spark builder plus (optionally) its DuckDB SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    ops: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, ops: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ops)
        return fn
    return deco


_INDEX_CACHE: dict[tuple[str, str, str], object] = {}


def cached(spark: SparkSession, sf_dir: str, key: str, make: Callable[[], object]) -> object:
    """Per-session memo for expensive derived tables (e.g. a written index)."""
    k = (spark.sparkContext.applicationId, sf_dir, key)
    if k not in _INDEX_CACHE:
        _INDEX_CACHE[k] = make()
    return _INDEX_CACHE[k]
