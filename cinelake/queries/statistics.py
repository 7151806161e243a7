"""Statistics over the whole library."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinelake.functions.scalars import js_round, percent
from cinelake.operators import statistics as S
from cinelake.sources.library import AS_OF, Library, as_of, sql

QUERIES: dict = {}
SQL: dict = {}


def _query(sql_text: str):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, directory: fn(Library(spark, directory))
        if sql_text:
            SQL[fn.__name__] = sql(sql_text)
        return fn

    return add


_TOTALS = """count(*) AS total, count(*) FILTER (is_available) AS available, count(*) FILTER (NOT is_available) AS unavailable, CAST(coalesce(sum(file_size_bytes), 0) AS BIGINT) AS total_size,
    round(coalesce(sum(duration_seconds), 0), 2) AS total_duration, CAST(floor(coalesce(avg(file_size_bytes), 0) + 0.5e0) AS BIGINT) AS mean_size, CAST(floor(coalesce(avg(duration_seconds), 0) + 0.5e0) AS BIGINT) AS mean_duration"""
_CLASS = "CASE WHEN height IS NULL THEN 'Unknown' WHEN height >= 2160 THEN '4K' WHEN height >= 1440 THEN '1440p' WHEN height >= 1080 THEN '1080p' WHEN height >= 720 THEN '720p' WHEN height >= 480 THEN '480p' ELSE 'Other' END"


@_query(f"SELECT {_TOTALS} FROM v_videos")
def a1_library_totals(lib):
    return S.totals(lib.rows("videos", "is_available", "file_size_bytes", "duration_seconds"))


@_query(f"SELECT {_CLASS} AS resolution, count(*) AS count, CAST(floor(100e0 * count(*) / (SELECT count(*) FROM v_videos) + 0.5e0) AS BIGINT) AS percentage FROM v_videos GROUP BY 1")
def a2_resolutions(lib):
    return S.resolution_breakdown(lib.rows("videos", "height"))


@_query(f"""WITH t AS (SELECT {_TOTALS} FROM v_videos), b AS (SELECT {_CLASS} AS resolution, count(*) AS count FROM v_videos GROUP BY 1)
SELECT b.resolution, b.count, CAST(floor(100e0 * b.count / t.total + 0.5e0) AS BIGINT) AS percentage, t.* FROM b, t""")
def a2_resolution_with_totals(lib):
    videos = lib.rows("videos", "height", "is_available", "file_size_bytes", "duration_seconds")  # one exchange for both
    return S.side_by_side(S.resolution_breakdown(videos), S.totals(videos))


@_query("SELECT coalesce(codec, 'Unknown') AS codec, count(*) AS count, CAST(floor(100e0 * count(*) / (SELECT count(*) FROM v_videos) + 0.5e0) AS BIGINT) AS percentage FROM v_videos GROUP BY v_videos.codec")
def a3_codecs(lib):
    return S.breakdown(lib.rows("videos", "codec"), F.col("codec"), "codec")


@_query("SELECT " + ", ".join(f"(SELECT count(*) FROM v_videos v WHERE v.id NOT IN (SELECT video_id FROM {t})) AS {n}" for n, t in (("without_tags", "v_video_tags"), ("without_creators", "v_video_creators"), ("without_ratings", "v_ratings"), ("without_thumbnails", "v_thumbnails"), ("without_storyboards", "v_storyboards"))))
def a4_gaps(lib):
    return S.side_by_side(*(S.without(lib.rows("videos"), getattr(lib, t), f"without_{n}") for n, t in (("tags", "video_tags"), ("creators", "video_creators"), ("ratings", "ratings"), ("thumbnails", "thumbnails"), ("storyboards", "storyboards"))))


@_query("SELECT (SELECT count(*) FROM v_tags) AS tags, (SELECT count(*) FROM v_creators) AS creators, (SELECT count(*) FROM v_studios) AS studios, (SELECT count(*) FROM v_playlists) AS playlists")
def a5_entities(lib):
    return S.side_by_side(*(lib.keys(t).agg(F.count(F.lit(1)).alias(t)) for t in ("tags", "creators", "studios", "playlists")))


@_query("SELECT t.id, t.name, count(*) AS video_count FROM v_tags t JOIN v_video_tags v ON v.tag_id = t.id GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10")
def a6_top_tags(lib):
    return S.top_linked(lib.tags, lib.video_tags, "tag_id")


@_query("SELECT c.id, c.name, count(*) AS video_count FROM v_creators c JOIN v_video_creators v ON v.creator_id = c.id GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10")
def a7_top_creators(lib):
    return S.top_linked(lib.rows("creators", "name"), lib.video_creators, "creator_id")


@_query("SELECT round(sum(total_watch_seconds), 2) AS seconds, CAST(sum(play_count) AS BIGINT) AS plays, count(DISTINCT CASE WHEN play_count > 0 THEN video_id END) AS videos FROM v_video_stats")
def a8_watch_totals(lib):
    return lib.video_stats.agg(F.round(F.sum("total_watch_seconds"), 2).alias("seconds"), F.sum("play_count").alias("plays"), F.count_distinct(F.when(F.col("play_count") > 0, F.col("video_id"))).alias("videos"))


@_query("SELECT count(*) AS never_watched FROM v_videos WHERE id NOT IN (SELECT video_id FROM v_video_stats WHERE play_count > 0)")
def a9_never_watched(lib):
    return S.without(lib.rows("videos"), lib.video_stats.filter("play_count > 0"), "never_watched")


@_query("SELECT floor(avg(least(s.total_watch_seconds / v.duration_seconds, 1) * 100) * 100 + 0.5e0) / 100 AS completion FROM v_video_stats s JOIN v_videos v ON v.id = s.video_id WHERE v.duration_seconds > 0 AND s.total_watch_seconds > 0")
def a10_completion(lib):
    rows = lib.video_stats.join(lib.rows("videos", "duration_seconds").select(F.col("id").alias("video_id"), "duration_seconds"), "video_id").filter("duration_seconds > 0 and total_watch_seconds > 0")
    return rows.agg((F.floor(F.avg(F.least(F.col("total_watch_seconds") / F.col("duration_seconds"), F.lit(1.0)) * 100) * 100 + 0.5) / 100).alias("completion"))


@_query("SELECT s.user_id, s.video_id, v.file_name, s.play_count FROM v_video_stats s JOIN v_videos v ON v.id = s.video_id ORDER BY s.play_count DESC, s.total_watch_seconds DESC, s.video_id, s.user_id LIMIT 10")
def a11_top_watched(lib):
    rows = lib.video_stats.join(lib.rows("videos", "file_name").select(F.col("id").alias("video_id"), "file_name"), "video_id")
    return rows.orderBy(F.desc("play_count"), F.desc("total_watch_seconds"), "video_id", "user_id").limit(10).select("user_id", "video_id", "file_name", "play_count")


@_query("SELECT lpad(CAST(h AS VARCHAR), 2, '0') AS hour, (SELECT count(*) FROM v_video_stats WHERE extract(hour FROM last_played_at) = h) AS events FROM range(24) r(h)")
def a12_activity_by_hour(lib):
    return S.hourly(lib.video_stats, "last_played_at")


@_query("""SELECT d.id, d.path, count(v.id) AS videos, CAST(coalesce(sum(v.file_size_bytes), 0) AS BIGINT) AS bytes, count(v.id) FILTER (v.is_available) AS available FROM v_directories d LEFT JOIN v_videos v ON v.directory_id = d.id GROUP BY 1, 2""")
def a13_storage_by_directory(lib):
    return S.by_directory(lib.rows("watched_directories", "path"), lib.rows("videos", "directory_id", "file_size_bytes", "is_available"))


@_query("SELECT count(*) AS videos, CAST(sum(file_size_bytes) AS BIGINT) AS bytes, CAST(sum(CASE WHEN is_available THEN 1 ELSE 0 END) AS BIGINT) AS available, CAST(sum(CASE WHEN is_available THEN 0 ELSE 1 END) AS BIGINT) AS unavailable FROM v_videos WHERE directory_id = 7")
def a15_directory(lib):
    return lib.rows("videos", "directory_id", "file_size_bytes", "is_available").filter("directory_id = 7").agg(F.count(F.lit(1)).alias("videos"), F.sum("file_size_bytes").alias("bytes"), F.sum(F.col("is_available").cast("long")).alias("available"), F.sum((~F.col("is_available")).cast("long")).alias("unavailable"))


@_query("SELECT v.id, CAST(coalesce(sum(s.play_count), 0) AS BIGINT) AS plays, round(coalesce(sum(s.total_watch_seconds), 0), 4) AS seconds, max(s.last_played_at) AS last_played_at FROM v_videos v LEFT JOIN v_video_stats s ON s.video_id = v.id GROUP BY 1")
def a16_watch_by_video(lib):
    sums = lib.video_stats.groupBy(F.col("video_id").alias("id")).agg(F.sum("play_count").alias("plays"), F.sum("total_watch_seconds").alias("seconds"), F.max("last_played_at").alias("last_played_at"))
    return lib.rows("videos").select("id").join(sums, "id", "left").select("id", F.coalesce("plays", F.lit(0)).alias("plays"), F.round(F.coalesce("seconds", F.lit(0.0)), 4).alias("seconds"), "last_played_at")


@_query("SELECT video_id, round(avg(rating), 6) AS mean, count(*) AS ratings FROM v_ratings GROUP BY 1")
def a17_ratings(lib):
    return lib.ratings.groupBy("video_id").agg(F.round(F.avg("rating"), 6).alias("mean"), F.count(F.lit(1)).alias("ratings"))


@_query("SELECT file_hash, count(*) AS copies, CAST(sum(file_size_bytes) AS BIGINT) AS bytes, min_by(id, (indexed_at, id)) AS first_id FROM v_videos WHERE file_hash <> '' GROUP BY 1 HAVING count(*) > 1")
def a18_duplicates(lib):
    return S.duplicates(lib.rows("videos", "file_hash", "file_size_bytes", "indexed_at"), F.col("file_hash"), "id", "file_size_bytes", "indexed_at")


@_query("WITH g AS (SELECT file_hash, min_by(id, (indexed_at, id)) AS first_id FROM v_videos WHERE file_hash <> '' GROUP BY 1 HAVING count(*) > 1) SELECT v.file_hash, v.id, g.first_id FROM v_videos v JOIN g USING (file_hash)")
def a18_members(lib):
    return S.duplicate_members(lib.rows("videos", "file_hash", "file_size_bytes", "indexed_at"), F.col("file_hash"), "id", "file_size_bytes", "indexed_at")


@_query("WITH d AS (SELECT doc_id, md5(text) AS h, n_chars, created_at FROM documents WHERE text <> '') SELECT h AS file_hash, count(*) AS copies, CAST(sum(n_chars) AS BIGINT) AS bytes, min_by(doc_id, (created_at, doc_id)) AS first_id FROM d GROUP BY 1 HAVING count(*) > 1")
def dup_documents(lib):
    rows = lib.raw("documents").filter("text <> ''")
    return S.duplicates(rows, F.md5(F.col("text")), "doc_id", "n_chars", "created_at")


@_query("SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('pending', 'processing')) AS open FROM v_jobs GROUP BY 1")
def a19_batches(lib):
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return lib.jobs.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"), n("completed").alias("completed"), n("failed").alias("failed"), n("pending", "processing").alias("open"))


@_query("""WITH t AS (SELECT (SELECT count(*) FROM v_videos WHERE is_available) AS available, (SELECT count(DISTINCT video_id) FROM v_video_tags) AS tagged)
SELECT available, tagged, available - tagged AS untagged, CAST(coalesce(floor(100e0 * tagged / nullif(available, 0) + 0.5e0), 100) AS BIGINT) AS tagged_percent FROM t""")
def a20_tagging_progress(lib):
    both = S.side_by_side(lib.rows("videos", "is_available").filter("is_available").agg(F.count(F.lit(1)).alias("available")), lib.video_tags.agg(F.count_distinct("video_id").alias("tagged")))
    share = F.when(F.col("available") == 0, 100).otherwise(percent(F.col("tagged"), F.col("available")))
    return both.select("available", "tagged", (F.col("available") - F.col("tagged")).alias("untagged"), share.cast("long").alias("tagged_percent"))


@_query("SELECT v.directory_id, count(*) AS untagged FROM v_videos v WHERE is_available AND NOT EXISTS (SELECT 1 FROM v_video_tags t WHERE t.video_id = v.id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a20_untagged_directories(lib):
    rows = lib.rows("videos", "is_available", "directory_id").filter("is_available").join(lib.video_tags.select(F.col("video_id").alias("id")), "id", "left_anti")
    return rows.groupBy("directory_id").agg(F.count(F.lit(1)).alias("untagged")).orderBy(F.desc("untagged"), "directory_id").limit(10)


@_query("SELECT c_mktsegment AS filter_key, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS processed, CAST(round_even(100e0 * count(*) FILTER (c_acctbal > 0) / count(*), 0) AS BIGINT) AS progress FROM customer GROUP BY 1")
def a21_filter_progress(lib):
    rows = lib.raw("customer").groupBy(F.col("c_mktsegment").alias("filter_key")).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("c_acctbal") > 0, 1)).alias("processed"))
    return rows.withColumn("progress", F.bround(F.col("processed") * 100.0 / F.col("total"), 0).cast("long"))


_SUGGESTED = f"""WITH u AS (SELECT video_id, sum(play_count) AS plays, sum(total_watch_seconds) AS seconds, max(last_played_at) AS last FROM v_video_stats GROUP BY 1),
b AS (SELECT * FROM v_videos WHERE is_available ORDER BY file_size_bytes DESC, id LIMIT 60),
r AS (SELECT id, file_size_bytes, lower(coalesce(codec, '')) AS c, file_size_bytes / 1073741824e0 AS g, CASE WHEN coalesce(bitrate, 0) > 0 THEN bitrate / 1000e0 END AS k, height AS h, fps, coalesce(plays, 0) AS p, coalesce(seconds, 0) AS s,
      last IS NULL AS never, coalesce((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last)) / 86400e6 >= 90, false) AS stale FROM b LEFT JOIN u ON u.video_id = b.id),
x AS (SELECT id, file_size_bytes,
  CASE WHEN contains(c, 'av1') THEN 0 WHEN contains(c, 'hevc') OR contains(c, 'h265') THEN 20 WHEN contains(c, 'h264') OR contains(c, 'avc') THEN 40 ELSE 30 END + CASE WHEN g >= 20 THEN 30 WHEN g >= 10 THEN 20 WHEN g >= 5 THEN 12 ELSE 0 END
  + CASE WHEN k >= 20000 THEN 15 WHEN k >= 12000 THEN 8 ELSE 0 END + CASE WHEN h >= 2160 THEN 20 WHEN h >= 1440 THEN 10 ELSE 0 END + CASE WHEN fps >= 60 THEN 6 ELSE 0 END AS technical_score,
  CASE WHEN p <= 1 THEN 15 WHEN p <= 3 THEN 8 ELSE 0 END + CASE WHEN s < 60 THEN 8 ELSE 0 END + CASE WHEN never THEN 20 WHEN stale THEN 12 ELSE 0 END AS usage_score,
  concat_ws(',', CASE WHEN NOT contains(c, 'av1') THEN 'codec-inefficient' END, CASE WHEN g >= 5 THEN 'large-file' END, CASE WHEN k >= 12000 THEN 'high-bitrate' END, CASE WHEN h >= 2160 THEN 'ultra-hd' WHEN h >= 1440 THEN 'high-resolution' END,
    CASE WHEN fps >= 60 THEN 'high-fps' END, CASE WHEN p <= 3 THEN 'low-play-count' END, CASE WHEN s < 60 THEN 'low-watch-time' END, CASE WHEN never THEN 'never-played' WHEN stale THEN 'stale-playback' END) AS reasons,
  concat_ws(',', CASE WHEN NOT contains(c, 'av1') THEN 'reencode_av1' END, CASE WHEN h >= 2160 AND (never OR stale) THEN 'downscale_1080p' END) AS actions FROM r)
SELECT id, file_size_bytes, technical_score, usage_score, reasons, actions, technical_score + usage_score AS total_score FROM x WHERE actions <> '' ORDER BY total_score DESC, file_size_bytes DESC, id LIMIT 20"""


@_query(_SUGGESTED)
def pipe1_suggestions(lib):
    return S.suggestions(lib)


@_query("SELECT CAST(day AS VARCHAR) AS day, total_videos, total_size_bytes FROM v_snapshots ORDER BY v_snapshots.day DESC LIMIT 10")
def t7_history(lib):
    return lib.snapshots.orderBy(F.desc("day")).limit(10).select(F.col("day").cast("string").alias("day"), "total_videos", "total_size_bytes")


@_query("SELECT count(*) FILTER (created_at >= TIMESTAMP '2026-01-01' - INTERVAL 1 DAY) AS day, count(*) FILTER (created_at >= TIMESTAMP '2026-01-01' - INTERVAL 7 DAY) AS week, count(*) FILTER (created_at >= TIMESTAMP '2026-01-01' - INTERVAL 90 DAY) AS quarter FROM v_videos")
def f22_recent_counts(lib):
    since = lambda d: F.count(F.when(F.col("created_at") >= as_of() - F.expr(f"INTERVAL '{d}' DAY"), 1))
    return lib.rows("videos", "created_at").agg(since(1).alias("day"), since(7).alias("week"), since(90).alias("quarter"))


@_query("SELECT CAST(coalesce(sum(file_size_bytes), 0) + (SELECT count(*) FROM v_thumbnails) * 20480 + (SELECT count(*) FROM v_storyboards) * 102400 AS BIGINT) AS managed_bytes FROM v_videos")
def a14_managed_size(lib):
    parts = S.side_by_side(lib.rows("videos", "file_size_bytes").agg(F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("v")), lib.thumbnails.agg(F.count(F.lit(1)).alias("t")), lib.storyboards.agg(F.count(F.lit(1)).alias("s")))
    return parts.select((F.col("v") + F.col("t") * 20_480 + F.col("s") * 102_400).alias("managed_bytes"))


@_query("SELECT playlist_id, max(position) + 1 AS next_position FROM v_playlist_videos GROUP BY 1")
def a24_next_position(lib):
    return lib.playlist_videos.groupBy("playlist_id").agg((F.max("position") + 1).alias("next_position"))


@_query("SELECT video_id, bool_and(lower(trim(match_status)) = 'rejected') AS all_rejected FROM (SELECT DISTINCT id, video_id, match_status FROM video_face_detections) GROUP BY 1")
def a28_all_rejected(lib):
    rows = lib.raw("video_face_detections").select("id", "video_id", "match_status").distinct()
    return rows.groupBy("video_id").agg(F.bool_and(F.lower(F.trim("match_status")) == "rejected").alias("all_rejected"))


@_query("SELECT matched_creator_id AS creator_id, video_id, count(*) AS detections, round(avg(match_confidence), 6) AS mean_confidence FROM (SELECT DISTINCT id, video_id, matched_creator_id, match_confidence, match_status FROM video_face_detections) WHERE lower(trim(match_status)) IN ('confirmed', 'pending') AND match_confidence >= 0.65e0 AND matched_creator_id IS NOT NULL GROUP BY 1, 2")
def a22_videos_by_face(lib):
    rows = lib.raw("video_face_detections").select("id", "video_id", "matched_creator_id", "match_confidence", "match_status").distinct()
    rows = rows.filter(F.lower(F.trim("match_status")).isin("confirmed", "pending") & (F.col("match_confidence") >= 0.65) & F.col("matched_creator_id").isNotNull())
    return rows.groupBy(F.col("matched_creator_id").alias("creator_id"), "video_id").agg(F.count(F.lit(1)).alias("detections"), F.round(F.avg("match_confidence"), 6).alias("mean_confidence"))
