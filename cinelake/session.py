"""Session settings that every operator of this library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build(master: str | None = None, **extra: str) -> SparkSession:
    """A session with this library's settings; ``extra`` wins over them."""
    builder = SparkSession.builder.appName("cinelake")
    if master:
        builder = builder.master(master)
    return builder.config(map={**SETTINGS, **extra}).getOrCreate()
