"""All queries of the core, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dyadica.plans import problems, reference

QUERIES = reference.QUERIES | problems.QUERIES
ORACLE = reference.ORACLE | problems.ORACLE


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["combine_sparse"](spark, d)
