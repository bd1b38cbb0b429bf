"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperweir.plans import answers, corpus, flows, search, tables, texts

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (corpus, texts, search, answers, tables, flows)


def queries() -> dict[str, Query]:
    """Name to query."""
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {name: q for part in _PARTS for name, q in part.SQL.items()}
