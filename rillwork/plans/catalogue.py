"""All queries over the driver's tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import candidate_queries, evaluation_queries, kernel_queries, network_queries, point_queries, raster_queries, scalar_queries

PARTS = [point_queries.C, raster_queries.C, candidate_queries.C, network_queries.C, scalar_queries.C, kernel_queries.C, evaluation_queries.C]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per council: positives, those among the 100 best candidates of their tile, and recall, with the labels that have no
    candidate counted as missed."""
    return candidate_queries.recall_at_k(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for part in PARTS for n, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for part in PARTS for n, s in part.sql.items()}
