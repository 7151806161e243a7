"""Tables to JSON lines and back, and rows waiting in a queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

SECRET = {"users": ("password_hash",)}
#: Tables in an order in which every reference is to a table before it.
ORDER = (
    "users", "watched_directories", "videos", "creators", "studios", "tags", "platforms", "playlists", "video_tags", "video_creators", "video_studios", "creator_studios", "creator_platforms", "social_links", "playlist_videos", "favorites", "bookmarks", "ratings",
    "thumbnails", "storyboards", "video_stats", "conversion_jobs", "scan_logs", "tagging_rules", "triage_progress", "creator_face_embeddings", "video_face_detections",
)


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as JSON lines in a folder of its own; secret columns stay out."""
    for name, df in tables.items():
        df.drop(*SECRET.get(name, ())).write.mode("overwrite").json(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """Exported tables read with their schemas, never inferred, parents before children; flags written as 0 and 1 are read as such."""
    place = {name: k for k, name in enumerate(ORDER)}
    out = {}
    for name, schema in sorted(schemas.items(), key=lambda x: (place.get(x[0], len(place)), x[0])):
        flags = [f.name for f in schema.fields if isinstance(f.dataType, BooleanType)]
        loose = StructType([StructField(f.name, StringType()) if f.name in flags else f for f in schema.fields])
        rows = spark.read.schema(loose).json(f"{folder}/{name}")
        out[name] = rows.withColumns({c: F.when(F.lower(c).isin("1", "true"), True).when(F.lower(c).isin("0", "false"), False) for c in flags}) if flags else rows
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of every table, in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def next_id(df: DataFrame, id: str = "id") -> DataFrame:
    return df.agg((F.coalesce(F.max(id), F.lit(0)) + 1).alias("next_id"))


def runnable(jobs: DataFrame, slots: int, bucket: str | None = None) -> DataFrame:
    """The first ``slots`` waiting rows by age (of every ``bucket``), as a pruned top-k."""
    waiting = jobs.filter(F.col("status") == "pending")
    if bucket is None:
        return waiting.orderBy("created_at", "id").limit(slots)
    w = W.partitionBy(bucket).orderBy("created_at", "id")
    return waiting.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= slots)
