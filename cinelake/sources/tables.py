"""Parquet tables of a library directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; columns are pruned by what the caller selects."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
