"""All named queries of the library and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import analysis_queries, extra_queries, model_queries, panel_queries

FLAGSHIP = "p01_cluster_median_growth"
ALL = {q.name: q for q in (*panel_queries.QUERIES, *analysis_queries.QUERIES, *extra_queries.QUERIES, *model_queries.QUERIES)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, q in ALL.items() if (sql := q.oracle()) is not None}
