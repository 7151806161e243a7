"""Reports on the library: storage, scans, orphans, trends and sets of faces."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinelake.operators import hierarchy
from cinelake.operators.merging import retain
from cinelake.sources.library import Library, sql

QUERIES: dict = {}
SQL: dict = {}


def _query(sql_text: str):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, directory: fn(Library(spark, directory))
        if sql_text:
            SQL[fn.__name__] = sql(sql_text)
        return fn

    return add


@_query("SELECT is_available, count(*) AS videos, CAST(sum(file_size_bytes) AS BIGINT) AS bytes, round(sum(file_size_bytes) / 1073741824e0, 4) AS gib, round(avg(file_size_bytes) / 1048576e0, 4) AS mean_mib FROM v_videos GROUP BY 1")
def q1_storage(lib):
    return lib.rows("videos", "is_available", "file_size_bytes").groupBy("is_available").agg(F.count(F.lit(1)).alias("videos"), F.sum("file_size_bytes").alias("bytes"), F.round(F.sum("file_size_bytes") / float(1 << 30), 4).alias("gib"), F.round(F.avg("file_size_bytes") / float(1 << 20), 4).alias("mean_mib"))


@_query("SELECT id, file_name, file_size_bytes // 1048576 AS mib FROM v_videos ORDER BY file_size_bytes DESC, id LIMIT 10")
def q2_largest(lib):
    return lib.rows("videos", "file_name", "file_size_bytes").orderBy(F.desc("file_size_bytes"), "id").limit(10).select("id", "file_name", F.expr("file_size_bytes div 1048576").alias("mib"))


@_query("SELECT round(avg(epoch_us(completed_at) - epoch_us(started_at)) / 1e6, 4) AS seconds, round(avg(files_found), 4) AS found, round(avg(files_added), 4) AS added FROM v_scan_logs WHERE completed_at IS NOT NULL")
def q3_scan_times(lib):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return lib.scan_logs.filter("completed_at is not null").agg(F.round(F.avg(us("completed_at") - us("started_at")) / 1e6, 4).alias("seconds"), F.round(F.avg("files_found"), 4).alias("found"), F.round(F.avg("files_added"), 4).alias("added"))


@_query("SELECT id, errors, CAST(json_array_length(errors) AS INTEGER) AS n FROM v_scan_logs WHERE errors <> '[]' ORDER BY started_at DESC, id DESC LIMIT 10")
def q4_failed_scans(lib):
    return lib.scan_logs.filter("errors is not null and errors <> '[]'").orderBy(F.desc("started_at"), F.desc("id")).limit(10).select("id", "errors", F.size(F.from_json("errors", "array<string>")).alias("n"))


@_query("SELECT id FROM v_scan_logs WHERE directory_id NOT IN (SELECT id FROM v_directories)")
def q5_scans_without_directory(lib):
    return lib.scan_logs.join(lib.rows("watched_directories").select(F.col("id").alias("directory_id")), "directory_id", "left_anti").select("id")


_LINKS = (("video_tags", "video_id", "videos"), ("video_creators", "video_id", "videos"), ("video_creators", "creator_id", "creators"), ("video_studios", "studio_id", "studios"), ("playlist_videos", "video_id", "videos"), ("favorites", "video_id", "videos"))


@_query(" UNION ALL ".join(f"SELECT '{t}.{k}' AS reference, count(*) AS orphans FROM v_{t} WHERE {k} NOT IN (SELECT id FROM v_{p})" for t, k, p in _LINKS))
def q6_orphan_report(lib):
    out = None
    for t, k, p in _LINKS:
        n = lib.keys(t).select(k).join(lib.keys(p).select(F.col("id").cast("long").alias(k)), k, "left_anti").agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(f"{t}.{k}").alias("reference"), "orphans")
        out = n if out is None else out.unionByName(n)
    return out


_TABLES = ("videos", "creators", "studios", "tags", "video_tags", "video_creators", "playlists", "favorites")


@_query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM v_{t}" for t in _TABLES))
def q7_row_counts(lib):
    out = None
    for t in _TABLES:
        n = lib.keys(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@_query("""WITH RECURSIVE d AS (SELECT id, 0 AS depth FROM v_tags WHERE parent_id IS NULL UNION ALL SELECT t.id, d.depth + 1 FROM v_tags t JOIN d ON t.parent_id = d.id) SELECT max(depth) AS depth FROM d""")
def q8_tag_depth(lib):
    return hierarchy.depths(lib.tags, paths=False).agg(F.max("depth").cast("int").alias("depth"))


@_query("SELECT id, name FROM v_creators WHERE id NOT IN (SELECT creator_id FROM v_video_creators)")
def q9_creators_without_videos(lib):
    return lib.rows("creators", "name").join(lib.video_creators.select(F.col("creator_id").alias("id")), "id", "left_anti").select("id", "name")


@_query("SELECT count(DISTINCT video_id) AS videos, CAST(sum(play_count) AS BIGINT) AS plays, round(sum(total_watch_seconds) / 3600, 6) AS hours, round(avg(play_count), 6) AS mean_plays FROM v_video_stats")
def q10_watch_summary(lib):
    return lib.video_stats.agg(F.count_distinct("video_id").alias("videos"), F.sum("play_count").alias("plays"), F.round(F.sum("total_watch_seconds") / 3600, 6).alias("hours"), F.round(F.avg("play_count"), 6).alias("mean_plays"))


@_query("SELECT id FROM v_videos WHERE is_available AND id NOT IN (SELECT video_id FROM v_video_stats)")
def q11_never_watched(lib):
    return lib.rows("videos", "is_available").filter("is_available").join(lib.video_stats.select(F.col("video_id").alias("id")), "id", "left_anti").select("id")


@_query("SELECT s.user_id, s.video_id, round(coalesce(least(1, s.total_watch_seconds / nullif(v.duration_seconds, 0)), 0), 6) AS completion FROM v_video_stats s JOIN v_videos v ON v.id = s.video_id")
def q13_completion(lib):
    rows = lib.video_stats.join(lib.rows("videos", "duration_seconds").select(F.col("id").alias("video_id"), "duration_seconds"), "video_id")
    return rows.select("user_id", "video_id", F.round(F.coalesce(F.least(F.lit(1.0), F.try_divide("total_watch_seconds", "duration_seconds")), F.lit(0.0)), 6).alias("completion"))


@_query("SELECT id FROM v_videos v WHERE is_available AND id NOT IN (SELECT video_id FROM v_thumbnails) AND id NOT IN (SELECT video_id FROM v_storyboards)")
def q14_without_pictures(lib):
    out = lib.rows("videos", "is_available").filter("is_available").select("id")
    for t in (lib.thumbnails, lib.storyboards):
        out = out.join(t.select(F.col("video_id").alias("id")), "id", "left_anti")
    return out


@_query("SELECT status, count(*) AS jobs, round(sum(output_size_bytes) / 1073741824e0, 6) AS gib FROM v_jobs GROUP BY 1")
def q15_jobs(lib):
    return lib.jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.round(F.sum("output_size_bytes") / float(1 << 30), 6).alias("gib"))


@_query("SELECT 'videos' AS part, count(*) AS items, CAST(sum(file_size_bytes) AS BIGINT) AS bytes FROM v_videos UNION ALL SELECT 'conversions', count(*), CAST(sum(output_size_bytes) AS BIGINT) FROM v_jobs WHERE status = 'completed' UNION ALL SELECT 'thumbnails', count(*), count(*) * 20480 FROM v_thumbnails")
def q16_storage_breakdown(lib):
    part = lambda name, df, size: df.agg(F.count(F.lit(1)).alias("items"), F.sum(size).cast("long").alias("bytes")).select(F.lit(name).alias("part"), "items", "bytes")
    return part("videos", lib.rows("videos", "file_size_bytes"), F.col("file_size_bytes")).unionByName(part("conversions", lib.jobs.filter("status = 'completed'"), F.col("output_size_bytes"))).unionByName(part("thumbnails", lib.thumbnails, F.lit(20_480)))


_DATED = (("videos", "created_at"), ("ratings", "rated_at"), ("jobs", "created_at"), ("bookmarks", None))


@_query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, min({c}) AS first_at, max({c}) AS last_at FROM v_{t}" for t, c in _DATED if c))
def q17_spans(lib):
    out = None
    for t, c in _DATED:
        if c:
            n = getattr(lib, t).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("first_at"), F.max(c).alias("last_at")).select(F.lit(t).alias("name"), "n", "first_at", "last_at")
            out = n if out is None else out.unionByName(n)
    return out


@_query("SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day, count(*) AS videos, CAST(sum(file_size_bytes) AS BIGINT) AS bytes FROM v_videos GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def q18_growth(lib):
    return lib.rows("videos", "created_at", "file_size_bytes").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("videos"), F.sum("file_size_bytes").alias("bytes")).orderBy(F.desc("day")).limit(30)


@_query("SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week, round(avg(total_size_bytes), 4) AS mean, max(total_size_bytes) - min(total_size_bytes) AS spread FROM v_snapshots GROUP BY 1")
def q19_weekly(lib):
    return lib.snapshots.groupBy(F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")).agg(F.round(F.avg("total_size_bytes"), 4).alias("mean"), (F.max("total_size_bytes") - F.min("total_size_bytes")).alias("spread"))


@_query("SELECT event_type AS resolution, round(avg(n), 6) AS mean FROM v_snapshots0 GROUP BY 1")
def q20_breakdown_means(lib):
    """Mean counts from the JSON text of snapshots."""
    rows = lib.snapshots.select(F.explode(F.from_json("breakdown", "array<struct<resolution: string, count: bigint>>")).alias("b"))
    return rows.groupBy(F.col("b.resolution").alias("resolution")).agg(F.round(F.avg("b.count"), 6).alias("mean"))


@_query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY AND (ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY OR hour(ts) = 0)")
def q21_retention(lib):
    return retain(lib.raw("events"), "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 20, 7).select("event_id")


@_query("SELECT c_mktsegment AS filter_key, round(count(*) FILTER (c_acctbal > 0) * 100e0 / nullif(count(*), 0), 2) AS share, count(*) FILTER (c_acctbal > 0) < count(*) AS open FROM customer GROUP BY 1")
def q22_open_filters(lib):
    n = F.count(F.when(F.col("c_acctbal") > 0, 1))
    return lib.raw("customer").groupBy(F.col("c_mktsegment").alias("filter_key")).agg(F.round(n * 100.0 / F.count(F.lit(1)), 2).alias("share"), (n < F.count(F.lit(1))).alias("open"))


@_query("SELECT (SELECT count(DISTINCT video_id) FROM v_video_tags) AS tagged, total_videos FROM v_snapshots ORDER BY day DESC LIMIT 1")
def q23_tagged_against_snapshot(lib):
    last = lib.snapshots.orderBy(F.desc("day")).limit(1).select("total_videos")
    return lib.video_tags.agg(F.count_distinct("video_id").alias("tagged")).crossJoin(F.broadcast(last))


_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@_query(f"""WITH r AS (SELECT embedding::DOUBLE[] AS e FROM creator_face_embeddings WHERE creator_id = (SELECT min(creator_id) FROM creator_face_embeddings WHERE is_primary AND {_USABLE}) AND is_primary AND {_USABLE} ORDER BY det_score DESC NULLS LAST, id LIMIT 1)
SELECT DISTINCT d.video_id FROM (SELECT * FROM video_face_detections WHERE {_USABLE}) d, r WHERE list_cosine_similarity(d.embedding::DOUBLE[], r.e) > 0.6e0""")
def q24_videos_of_creator(lib):
    """Videos with a face like the best reference of one creator; a single probe vector."""
    from cinelake.functions.scalars import cosine

    usable = "size(embedding) = 64 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(embedding, x -> x <> 0)"
    refs = lib.raw("creator_face_embeddings").filter("is_primary").filter(usable)
    first = refs.agg(F.min("creator_id").alias("creator_id"))
    best = refs.join(F.broadcast(first), "creator_id").orderBy(F.col("det_score").desc_nulls_last(), "id").limit(1).select(F.col("embedding").alias("p"))
    rows = lib.raw("video_face_detections").filter(usable).crossJoin(F.broadcast(best))  # one row
    return rows.filter(cosine(F.col("embedding"), F.col("p")) > 0.6).select("video_id").distinct()


@_query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
    WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3e0 ORDER BY 3 DESC, 1, 2 LIMIT 100""")
def q25_similar_pairs(lib):
    from cinelake.operators.vectors import top_k

    e = lib.raw("embeddings").withColumnRenamed("vec_id", "id")
    found = top_k(e, e, 100, 0.3, 64, later_only=True)
    return found.orderBy(F.desc("similarity"), "query_id", "match_id").limit(100).select(F.col("query_id").alias("a"), F.col("match_id").alias("b"), "similarity")


@_query(f"""WITH r AS (SELECT embedding::DOUBLE[] AS e FROM creator_face_embeddings WHERE creator_id = (SELECT min(creator_id) FROM creator_face_embeddings) AND {_USABLE}),
d AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM video_face_detections WHERE lower(trim(match_status)) = 'pending' AND {_USABLE}), m AS (SELECT d.id, round(max(list_cosine_similarity(d.e, r.e)), 6) AS similarity FROM d, r GROUP BY 1)
SELECT id, similarity, CASE WHEN similarity >= 0.75e0 THEN 'confirmed' ELSE 'pending' END AS match_status FROM m WHERE similarity >= 0.5e0""")
def q26_rematch(lib):
    """Pending detections like any reference face of one creator, with the best similarity."""
    from cinelake.operators.vectors import top_k

    usable = "size(embedding) = 64 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(embedding, x -> x <> 0)"
    refs = lib.raw("creator_face_embeddings")
    refs = refs.join(F.broadcast(refs.agg(F.min("creator_id").alias("creator_id"))), "creator_id").filter(usable)
    pending = lib.raw("video_face_detections").filter(F.lower(F.trim("match_status")) == "pending").filter(usable)
    found = top_k(pending, refs, 1, 0.5, 64).select("query_id", "similarity").distinct()
    return found.select(F.col("query_id").alias("id"), "similarity", F.when(F.col("similarity") >= 0.75, "confirmed").otherwise("pending").alias("match_status"))
