"""Readers for the Parquet tables that the queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Register the tables as temporary views, so that users can query them by SQL."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
