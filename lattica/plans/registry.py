"""All queries of the analytics engine by name, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.plans.queries_core import flagship as _flagship
from lattica.plans.registration import ORACLES, QUERIES

from lattica.plans import queries_data, queries_handles, queries_models, queries_stats, queries_more  # noqa: E402, F401  they register theirs


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagship(spark, sf_dir)
