"""The queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from viaduct.plans import extra_queries, graph_queries, route_queries, table_queries, user_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**graph_queries.QUERIES, **table_queries.QUERIES, **user_queries.QUERIES, **extra_queries.QUERIES, **route_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**graph_queries.ORACLE_SQL, **table_queries.ORACLE_SQL, **user_queries.ORACLE_SQL, **extra_queries.ORACLE_SQL, **route_queries.ORACLE_SQL}
