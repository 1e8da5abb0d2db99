"""All named queries outside the text subpackage: name -> (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyloom.plans import changes, context, functions, governance, ingest, lookups, predicates, records, references, retrieval, storage, timeline, vectors

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (references, predicates, lookups, timeline, functions, context, retrieval, changes, ingest, governance, vectors, records, storage)


def queries() -> dict[str, Query]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
