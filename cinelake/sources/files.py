"""Files of a media folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions.scalars import is_video


def listing(spark: SparkSession, folder: str, videos_only: bool = True) -> DataFrame:
    """(file_path, file_size_bytes, modified_at) of all files below ``folder``; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    out = files.select(F.col("path").alias("file_path"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("modified_at"))
    return out.filter(is_video(F.col("file_path"))) if videos_only else out


def folder_size(spark: SparkSession, folder: str) -> DataFrame:
    """(files, bytes) of all files below ``folder``."""
    return listing(spark, folder, videos_only=False).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("bytes"))
