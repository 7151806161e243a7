"""The rows of periodical snapshots: totals, and breakdowns as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.operators import statistics as S
from cinelake.sources.library import Library


def _json(rows: DataFrame, label: str, order: Column, *columns: str) -> DataFrame:
    """One row: the few ``rows`` as a JSON array in the given order."""
    ranked = F.sort_array(F.collect_list(F.struct(order.alias("_o"), F.struct(*columns).alias("r"))))
    return rows.agg(F.to_json(F.transform(ranked, lambda x: x["r"])).alias(label))


def content(lib: Library, most: int = 10) -> DataFrame:
    """(without_tags, tags, top_tags): videos without a tag, all tags, and the ``most`` used ones."""
    top = S.top_linked(lib.tags, lib.video_tags, "tag_id", most)
    return S.side_by_side(
        S.without(lib.rows("videos"), lib.video_tags, "without_tags"), lib.tags.agg(F.count(F.lit(1)).alias("tags")), _json(top, "top_tags", F.struct(-F.col("video_count"), "id"), "id", "name", "video_count")
    )


def usage(lib: Library) -> DataFrame:
    """(plays, seconds, activity_by_hour): a JSON object with all 24 hours."""
    hours = S.hourly(lib.video_stats, "last_played_at")
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("hour", "events"))))
    sums = lib.video_stats.agg(F.sum("play_count").alias("plays"), F.round(F.sum("total_watch_seconds"), 2).alias("seconds"))
    return S.side_by_side(sums, hours.agg(F.to_json(entries).alias("activity_by_hour")))


def storage(lib: Library) -> DataFrame:
    """(video_bytes, directories): one entry for each watched directory, which are few."""
    videos = lib.rows("videos", "directory_id", "file_size_bytes", "is_available")
    by = S.by_directory(lib.rows("watched_directories", "path"), videos).select(F.col("id").alias("directory_id"), F.col("bytes").alias("size_bytes"), F.col("videos").alias("video_count"))
    return S.side_by_side(videos.agg(F.sum("file_size_bytes").alias("video_bytes")), _json(by, "directories", F.struct("directory_id"), "directory_id", "size_bytes", "video_count"))
