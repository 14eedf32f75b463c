"""The registered queries, their SQL and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltrail.plans import catalog_plans, comparison_plans, curve_plans, cycle_plans, feature_plans, retrieval_plans, summary_plans, window_plans  # noqa: F401
from voltrail.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rag_forecast"](spark, sf_dir)
