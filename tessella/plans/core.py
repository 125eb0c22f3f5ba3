"""All queries of the engine's own operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import arrays, labels, relational, scalar, statistics  # noqa: F401  (they register themselves)
from tessella.plans.registry import ORACLE, QUERIES, Query


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.q_pricing_summary(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
