"""Every registered query of the library and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import command_queries, document_queries, text_queries

_MODULES = (text_queries, command_queries, document_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["line_kind_counts"](spark, sf_dir)
