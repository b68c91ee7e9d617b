"""All queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import analysis_queries, matching_queries, relational_queries, source_queries, stream_queries, timeline_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, watermark decisions, gate, time cost, cheapest slot, run metrics."""
    return QUERIES["a1g_run_metrics"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
