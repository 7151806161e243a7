"""Library, content, usage and storage statistics, compression candidates and duplicate groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions.scalars import js_round, ladder, percent, resolution_class
from cinelake.plans.skew import salted_join
from cinelake.sources.library import Library, as_of


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row frames as one row."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rows)


def totals(videos: DataFrame) -> DataFrame:
    """Counts, sizes, durations and rounded means of all videos, in one pass."""
    when = lambda c: F.sum(F.when(c, 1).otherwise(0))
    mean = lambda c: js_round(F.coalesce(F.avg(c), F.lit(0.0)))
    return videos.agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(when(F.col("is_available")), F.lit(0)).alias("available"), F.coalesce(when(~F.col("is_available")), F.lit(0)).alias("unavailable"),
        F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("total_size"), F.round(F.coalesce(F.sum("duration_seconds"), F.lit(0.0)), 2).alias("total_duration"), mean("file_size_bytes").alias("mean_size"), mean("duration_seconds").alias("mean_duration"),
    )


def breakdown(videos: DataFrame, by: Column, label: str) -> DataFrame:
    """(label, count, percentage): groups of ``by`` with their whole per cent of all; null groups stay apart from equal labels."""
    counts = videos.groupBy(by.alias("_by")).agg(F.count(F.lit(1)).alias("count"))
    whole = counts.agg(F.sum("count").alias("_all"))
    return counts.crossJoin(F.broadcast(whole)).select(F.coalesce("_by", F.lit("Unknown")).alias(label), "count", percent(F.col("count"), F.col("_all")).alias("percentage"))


def without(videos: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """One row: the number of videos that ``links`` has none of."""
    return videos.select(F.col("id").alias("video_id")).join(links.select("video_id"), "video_id", "left_anti").agg(F.count(F.lit(1)).alias(label))


def top_linked(entities: DataFrame, links: DataFrame, key: str, n: int = 10) -> DataFrame:
    counts = links.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("video_count"))
    return entities.select("id", "name").join(counts, "id").orderBy(F.desc("video_count"), "id").limit(n)


def hourly(events: DataFrame, ts: str) -> DataFrame:
    """(hour, events) with all 24 hours."""
    hours = events.sparkSession.range(24).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("hour"))
    seen = events.groupBy(F.date_format(ts, "HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.join(F.broadcast(seen), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("events"))  # at most 24 rows


def by_directory(directories: DataFrame, videos: DataFrame) -> DataFrame:
    """Videos and bytes of every directory, empty ones too."""
    sums = videos.groupBy(F.col("directory_id").alias("id")).agg(F.count(F.lit(1)).alias("videos"), F.sum("file_size_bytes").alias("bytes"), F.count(F.when(F.col("is_available"), 1)).alias("available"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return directories.select("id", "path").join(sums, "id", "left").select("id", "path", zero("videos"), zero("bytes"), zero("available"))


def _keyed(rows: DataFrame, key: Column, id: str, size: str, at: str) -> DataFrame:
    return rows.filter(key.isNotNull() & (key != "")).select(key.alias("file_hash"), F.col(id).alias("id"), F.col(size).alias("size"), F.col(at).alias("at"))


def duplicates(rows: DataFrame, key: Column, id: str, size: str, at: str) -> DataFrame:
    """(file_hash, copies, bytes, first_id) of every non-empty key with more than one row; the first by time and id.

    The members of a group may be any number; ``duplicate_members`` has a row for each.
    """
    groups = _keyed(rows, key, id, size, at).groupBy("file_hash")
    return groups.agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes"), F.min_by("id", F.struct("at", "id")).alias("first_id")).filter("copies > 1")


def duplicate_members(rows: DataFrame, key: Column, id: str, size: str, at: str) -> DataFrame:
    """(file_hash, id, first_id): every row whose key another row has too; a key of very many rows is split."""
    keyed = _keyed(rows, key, id, size, at)
    groups = duplicates(rows, key, id, size, at).select("file_hash", "first_id", F.col("copies").alias("n"))
    return salted_join(keyed, groups.select("file_hash", "first_id"), ["file_hash"], groups, F.col("id")).select("file_hash", "id", "first_id")


def suggestions(lib: Library, limit: int = 20, offset: int = 0, most: int = 200, inactive_days: int = 90, min_watch: float = 60.0) -> DataFrame:
    """Videos worth compressing: the largest available ones, scored on technique and use.

    Fixed values: the points, thresholds and names of reasons and actions. Takes the min(3 * limit, most) largest, as a top-k, then scores these only.
    """
    use = lib.video_stats.groupBy("video_id").agg(F.sum("play_count").alias("plays"), F.sum("total_watch_seconds").alias("seconds"), F.max("last_played_at").alias("last"))
    large = lib.rows("videos", "codec", "file_size_bytes", "bitrate", "height", "fps", "is_available").filter("is_available").orderBy(F.desc("file_size_bytes"), "id").offset(offset).limit(min(3 * limit, most))
    rows = large.join(use, large["id"] == use["video_id"], "left")
    plays, seconds = F.coalesce("plays", F.lit(0)), F.coalesce("seconds", F.lit(0.0))
    codec, gib, kbps, height = F.lower(F.coalesce("codec", F.lit(""))), F.col("file_size_bytes") / float(1 << 30), F.col("bitrate") / 1000, F.col("height")
    days = (F.unix_micros(as_of("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 86_400e6
    never, stale = F.col("last").isNull(), days >= inactive_days
    av1, rate = codec.contains("av1"), F.when(F.coalesce(F.col("bitrate"), F.lit(0)) > 0, kbps)
    h265, h264 = codec.contains("hevc") | codec.contains("h265"), codec.contains("h264") | codec.contains("avc")
    points = lambda steps: ladder([(c, F.lit(v)) for c, v in steps], F.lit(0))
    technique = points([(av1, 0), (h265, 20), (h264, 40), (F.lit(True), 30)]) + points([(gib >= 20, 30), (gib >= 10, 20), (gib >= 5, 12)]) + points([(rate >= 20_000, 15), (rate >= 12_000, 8)])
    technique += points([(height >= 2160, 20), (height >= 1440, 10)]) + points([(F.col("fps") >= 60, 6)])
    usage = points([(plays <= 1, 15), (plays <= 3, 8)]) + points([(seconds < min_watch, 8)]) + points([(never, 20), (stale, 12)])
    reasons = F.array_compact(
        F.array(
            F.when(~av1, "codec-inefficient"), F.when(gib >= 5, "large-file"), F.when(rate >= 12_000, "high-bitrate"), ladder([(height >= 2160, F.lit("ultra-hd")), (height >= 1440, F.lit("high-resolution"))]), F.when(F.col("fps") >= 60, "high-fps"),
            F.when(plays <= 3, "low-play-count"), F.when(seconds < min_watch, "low-watch-time"), ladder([(never, F.lit("never-played")), (stale, F.lit("stale-playback"))]),
        )
    )
    actions = F.array_compact(F.array(F.when(~av1, "reencode_av1"), F.when((height >= 2160) & (never | stale), "downscale_1080p")))
    scored = rows.select("id", "file_size_bytes", technique.alias("technical_score"), usage.alias("usage_score"), F.array_join(reasons, ",").alias("reasons"), F.array_join(actions, ",").alias("actions"))
    return scored.filter("actions <> ''").withColumn("total_score", F.col("technical_score") + F.col("usage_score")).orderBy(F.desc("total_score"), F.desc("file_size_bytes"), "id").limit(limit)


def resolution_breakdown(videos: DataFrame) -> DataFrame:
    return breakdown(videos, resolution_class(F.col("height")), "resolution")
