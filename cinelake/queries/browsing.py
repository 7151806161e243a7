"""Filters, facets, pages and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions import scalars
from cinelake.operators import filters, listing
from cinelake.operators.filters import VideoFilter
from cinelake.sources.library import Library, sql

QUERIES: dict = {}
SQL: dict = {}


def _filter(name: str, f: VideoFilter, where: str) -> None:
    def query(spark: SparkSession, directory: str) -> DataFrame:
        return filters.apply(Library(spark, directory), f).select("id")

    QUERIES[name] = query
    SQL[name] = sql(f"SELECT v.id FROM v_videos v WHERE {where}")


_EXISTS = "EXISTS (SELECT 1 FROM {} x WHERE x.video_id = v.id{})"
_MEAN = "(SELECT avg(rating) FROM v_ratings r WHERE r.video_id = v.id)"
for _name, _f, _where in (
    ("f1_available", VideoFilter(), "is_available"),
    ("f1_hidden", VideoFilter(available=False), "NOT is_available"),
    ("f2_directories", VideoFilter(directory_ids=(3, 4, 7)), "is_available AND directory_id IN (3, 4, 7)"),
    ("f3_search", VideoFilter(search="harb_r"), "is_available AND (title ILIKE '%harb_r%' OR description ILIKE '%harb_r%' OR file_name ILIKE '%harb_r%')"),
    ("f4_dimensions", VideoFilter(min_width=1280, max_width=2560, min_height=720), "is_available AND width BETWEEN 1280 AND 2560 AND height >= 720"),
    ("f5_size", VideoFilter(min_file_size_bytes=50_000_000, max_file_size_bytes=400_000_000), "is_available AND file_size_bytes BETWEEN 50000000 AND 400000000"),
    ("f6_duration", VideoFilter(min_duration_seconds=60, max_duration_seconds=600), "is_available AND duration_seconds BETWEEN 60 AND 600"),
    ("f7_codec", VideoFilter(codec="H264", audio_codec="AAC"), "is_available AND lower(codec) = 'h264' AND lower(audio_codec) = 'aac'"),
    ("f8_bitrate_fps", VideoFilter(min_bitrate=1_000_000, max_fps=30), "is_available AND bitrate >= 1000000 AND fps <= 30"),
    ("f9_linked", VideoFilter(has_tags=True, has_creator=True, has_studio=True, has_rating=True), "is_available AND " + " AND ".join(_EXISTS.format(t, "") for t in ("v_video_tags", "v_video_creators", "v_video_studios", "v_ratings"))),
    ("f10_unlinked", VideoFilter(has_tags=False), "is_available AND NOT " + _EXISTS.format("v_video_tags", "")),
    ("f10_no_creator", VideoFilter(has_creator=False, include_hidden=True), "NOT " + _EXISTS.format("v_video_creators", "")),
    ("f11_rating", VideoFilter(min_rating=2.8, max_rating=3.2), f"is_available AND {_MEAN} BETWEEN 2.8e0 AND 3.2e0"),
    ("f12_favorite", VideoFilter(user_id=7, favorite=True), "is_available AND " + _EXISTS.format("v_favorites", " AND x.user_id = 7")),
    ("f12_not_favorite", VideoFilter(user_id=7, favorite=False), "is_available AND NOT " + _EXISTS.format("v_favorites", " AND x.user_id = 7")),
    ("f13_thumbnail", VideoFilter(has_thumbnail=False), "is_available AND NOT " + _EXISTS.format("v_thumbnails", "")),
    ("j2_any_tag", VideoFilter(tag_ids=(5, 12, 40, 77)), "is_available AND " + _EXISTS.format("v_video_tags", " AND x.tag_id IN (5, 12, 40, 77)")),
    ("j3_all_tags", VideoFilter(tag_ids=(1, 2), creator_ids=(), match_all=True), "is_available AND (SELECT count(DISTINCT tag_id) FROM v_video_tags x WHERE x.video_id = v.id AND x.tag_id IN (1, 2)) = 2"),
    ("j3_all_tags_of_two", VideoFilter(tag_ids=(3, 83), match_all=True, include_hidden=True), "(SELECT count(DISTINCT tag_id) FROM v_video_tags x WHERE x.video_id = v.id AND x.tag_id IN (3, 83)) = 2"),
    ("j3_all_creators", VideoFilter(creator_ids=(138, 214), match_all=True, include_hidden=True), "(SELECT count(DISTINCT creator_id) FROM v_video_creators x WHERE x.video_id = v.id AND x.creator_id IN (138, 214)) = 2"),
    ("f13_with_thumbnail", VideoFilter(has_thumbnail=True), "is_available AND " + _EXISTS.format("v_thumbnails", "")),
    ("j3_all_facets", VideoFilter(creator_ids=(5,), studio_ids=(1, 2), match_all=True, include_hidden=True), "(SELECT count(DISTINCT creator_id) FROM v_video_creators x WHERE x.video_id = v.id AND x.creator_id IN (5)) = 1 AND (SELECT count(DISTINCT studio_id) FROM v_video_studios x WHERE x.video_id = v.id AND x.studio_id IN (1, 2)) = 2"),
):
    _filter(_name, _f, _where)


def _query(sql_text: str):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, directory: fn(Library(spark, directory))
        if sql_text:
            SQL[fn.__name__] = sql(sql_text)
        return fn

    return add


@_query("SELECT v.id FROM v_videos v JOIN v_video_studios s ON s.video_id = v.id WHERE is_available AND s.studio_id IN (1, 2, 3)")
def j2_any_studio_fanout(lib):
    return filters.apply(lib, VideoFilter(studio_ids=(1, 2, 3), dedupe=False)).select("id")


@_query("SELECT directory_id, count(*) AS videos, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v_video_tags t WHERE t.video_id = v.id)) AS tagged FROM v_videos v GROUP BY 1")
def j15_exists_by_directory(lib):
    tagged = lib.video_tags.select(F.col("video_id").alias("id")).distinct().withColumn("t", F.lit(1))
    return lib.rows("videos", "directory_id").join(tagged, "id", "left").groupBy("directory_id").agg(F.count(F.lit(1)).alias("videos"), F.count("t").alias("tagged"))


@_query("SELECT id, file_size_bytes FROM v_videos WHERE is_available ORDER BY file_size_bytes DESC NULLS FIRST, id DESC LIMIT 20 OFFSET 20")
def t1_page(lib):
    return listing.page(lib, VideoFilter(), "file_size_bytes", True, 2, 20).select("id", "file_size_bytes")


@_query("SELECT id, bitrate FROM v_videos WHERE is_available ORDER BY bitrate NULLS LAST, id LIMIT 50")
def f14_sort_nulls_last(lib):
    return listing.page(lib, VideoFilter(), "bitrate", False, 1, 50).select("id", "bitrate")


@_query("SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM v_videos WHERE is_available AND height >= 720")
def a25_envelope(lib):
    return listing.envelope(filters.apply(lib, VideoFilter(min_height=720)))


@_query("""SELECT v.id, v.file_name, CASE WHEN t.id IS NOT NULL THEN '/api/thumbnails/' || t.id || '/image' END AS thumbnail_url, f.video_id IS NOT NULL AS is_favorite, strftime(v.created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_iso
    FROM v_videos v LEFT JOIN v_thumbnails t ON t.video_id = v.id LEFT JOIN v_favorites f ON f.video_id = v.id AND f.user_id = 3""")
def f23_presented(lib):
    return listing.presented(lib, lib.rows("videos", "file_name", "created_at"), 3)


_NEXT = """WITH l AS (SELECT id, {c} AS v FROM v_videos WHERE is_available), h AS (SELECT v FROM l WHERE id = {i}),
a AS (SELECT l.id, l.v, (l.v {op} h.v OR (l.v = h.v AND l.id {op} {i})) AS after FROM l, h)
SELECT id, NOT after AS has_wrapped, greatest((SELECT count(*) FROM a WHERE after) - 1, 0) AS remaining, (SELECT count(*) FROM l) AS total FROM a WHERE id <> {i} ORDER BY after DESC, v {way}, id {way} LIMIT 1"""


@_query(_NEXT.format(c="created_at", i=10, op="<", way="DESC"))
def t2_next(lib):
    return listing.neighbour(filters.apply(lib, VideoFilter(), "created_at"), 10, "created_at", True)


@_query("""WITH m AS (SELECT id FROM v_videos WHERE is_available ORDER BY file_size_bytes DESC, id DESC LIMIT 1), l AS (SELECT id, file_size_bytes AS v FROM v_videos WHERE is_available)
SELECT id, true AS has_wrapped, CAST(0 AS BIGINT) AS remaining, (SELECT count(*) FROM l) AS total FROM m WHERE id <> (SELECT id FROM l ORDER BY v, id LIMIT 1)""")
def t2_wraps(lib):
    rows = filters.apply(lib, VideoFilter(), "file_size_bytes")
    last = rows.agg(F.min_by("id", F.struct("file_size_bytes", "id")).alias("id"))  # the end of the list, one row
    return listing.neighbour(rows, last, "file_size_bytes", True)


@_query("SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM v_videos WINDOW w AS (PARTITION BY directory_id ORDER BY created_at, id)")
def w6_neighbours(lib):
    return listing.neighbours_of_all(lib.rows("videos", "directory_id", "created_at"), F.col("directory_id"), "created_at", F.date_trunc("month", "created_at"))


@_query("SELECT id FROM v_videos v WHERE is_available AND NOT EXISTS (SELECT 1 FROM v_video_tags t WHERE t.video_id = v.id) ORDER BY created_at, id LIMIT 1000")
def t3_untagged_queue(lib):
    return filters.apply(lib, VideoFilter(has_tags=False), "created_at").orderBy(*filters.order("created_at", False)).limit(1000).select("id")


@_query("")
def t4_random(lib):
    return listing.random_row(lib.rows("videos", "file_name"), 11).select("id", "file_name")


@_query("SELECT id, created_at FROM v_creators ORDER BY created_at DESC, id DESC LIMIT 10")
def t5_recent_creators(lib):
    return listing.recent(lib.rows("creators", "created_at")).select("id", "created_at")


@_query("SELECT id, name FROM v_creators WHERE name ILIKE '%an%' ORDER BY name, id LIMIT 10")
def t6_autocomplete(lib):
    return listing.autocomplete(lib.rows("creators", "name"), " an ")


@_query("SELECT id, name FROM v_studios WHERE name LIKE '%Films%' ORDER BY name, id LIMIT 10")
def f20_case_sensitive(lib):
    return listing.autocomplete(lib.rows("studios", "name"), "Films", ignore_case=False)


@_query("SELECT id, video_id, timestamp_seconds FROM v_bookmarks WHERE user_id = 5 ORDER BY timestamp_seconds, id")
def t11_bookmarks(lib):
    return lib.bookmarks.filter("user_id = 5").orderBy("timestamp_seconds", "id").select("id", "video_id", "timestamp_seconds")


@_query("SELECT id, CASE WHEN regexp_extract(file_path, '\\.([^./]+)$', 1) <> '' THEN lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) ELSE '' END AS extension, lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) IN ('mp4','mkv','avi','mov','wmv','flv','webm','m4v','mpg','mpeg') AS is_video FROM v_videos")
def s4_is_video(lib):
    return lib.rows("videos", "file_path").select("id", scalars.extension(F.col("file_path")).alias("extension"), scalars.is_video(F.col("file_path")).alias("is_video"))
