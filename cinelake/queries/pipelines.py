"""Sessions, path rules, scalar planners, vector matching and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinelake.functions import scalars as X
from cinelake.operators import merging as M
from cinelake.operators import paths, vectors
from cinelake.operators.paths import Condition, Rule
from cinelake.operators.sessions import plays, sessions, threshold
from cinelake.sources.library import Library, sql
from cinelake.streaming.watching import session_windows, tumbling

QUERIES: dict = {}
SQL: dict = {}


def _query(sql_text: str):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, directory: fn(Library(spark, directory))
        if sql_text:
            SQL[fn.__name__] = sql(sql_text)
        return fn

    return add


_SESSIONS = """WITH e AS (SELECT w.*, CASE WHEN v.duration_seconds <= 60 THEN 10 ELSE 60 END AS lim FROM v_watch_events w LEFT JOIN v_videos v ON v.id = w.video_id WHERE watched_seconds > 0),
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, video_id ORDER BY ts, event_id)) > 43200000000 THEN 1 ELSE 0 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, video_id ORDER BY ts, event_id) AS session FROM g),
r AS (SELECT *, sum(watched_seconds) OVER (PARTITION BY user_id, video_id, session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM s)
"""


def _events(lib):
    limit = lib.rows("videos", "duration_seconds").select(F.col("id").alias("video_id"), threshold(F.col("duration_seconds")).alias("lim"))
    return lib.watch_events.join(limit, "video_id", "left").withColumn("lim", F.coalesce("lim", F.lit(60.0)))


@_query(_SESSIONS + """SELECT user_id, video_id, count(*) FILTER (running >= lim AND running - watched_seconds < lim) AS play_count, round(sum(watched_seconds), 4) AS total_watch_seconds, round(max_by(running, (ts, event_id)), 4) AS session_watch_seconds,
    max(ts) FILTER (running >= lim AND running - watched_seconds < lim) AS last_played_at, max(ts) AS last_watch_at FROM r GROUP BY 1, 2""")
def pipe2_play_counts(lib):
    out = plays(_events(lib), F.col("lim"), 720)
    return out.withColumn("total_watch_seconds", F.round("total_watch_seconds", 4)).withColumn("session_watch_seconds", F.round("session_watch_seconds", 4))


@_query(_SESSIONS + "SELECT user_id, video_id, CAST(session AS BIGINT) AS session, count(*) AS events, round(sum(watched_seconds), 4) AS seconds FROM r GROUP BY 1, 2, 3")
def w4_sessions(lib):
    return sessions(lib.watch_events, 720).groupBy("user_id", "video_id", "session").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("watched_seconds"), 4).alias("seconds"))


@_query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def st_hourly(lib):
    out = tumbling(lib.raw("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000 THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM s GROUP BY user_id, k""")
def st_sessions(lib):
    out = session_windows(lib.raw("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


_HIGH = r"'/(?:onlyfans|OF)/([^/]+)/?'", r"'/(?:fansly|FS)/([^/]+)/?'", r"'/([^/]+)/([^/]+)/(?:[Ee]p?[-_]?(\d+)|(\d+))'", r"'/videos/([^/]+)/?'", r"'/([^/]+)/([^/]+)/?'"


@_query(
    f"""WITH p AS (SELECT id, file_path AS f, CASE WHEN regexp_matches(file_path, {_HIGH[0]}) THEN 0 WHEN regexp_matches(file_path, {_HIGH[1]}) THEN 1 WHEN regexp_matches(file_path, {_HIGH[2]}) THEN 2 WHEN regexp_matches(file_path, {_HIGH[3]}) THEN 3 ELSE 4 END AS k FROM v_videos)
SELECT id, CASE k WHEN 0 THEN regexp_extract(f, {_HIGH[0]}, 1) WHEN 1 THEN regexp_extract(f, {_HIGH[1]}, 1) WHEN 2 THEN regexp_extract(f, {_HIGH[2]}, 1) WHEN 3 THEN regexp_extract(f, {_HIGH[3]}, 1) ELSE regexp_extract(f, {_HIGH[4]}, 2) END AS creator,
  CASE WHEN k = 4 THEN regexp_extract(f, {_HIGH[4]}, 1) END AS studio, CASE WHEN k = 2 THEN regexp_extract(f, {_HIGH[2]}, 2) END AS series,
  CASE WHEN k = 2 THEN coalesce(nullif(regexp_extract(f, {_HIGH[2]}, 3), ''), nullif(regexp_extract(f, {_HIGH[2]}, 4), '')) END AS episode,
  list_extract(string_split(f, '/'), -1) AS file_name, list_extract(string_split(f, '/'), -2) AS parent FROM p"""
)
def pipe5_paths(lib):
    p = paths.parse(F.col("file_path"))
    return lib.rows("videos", "file_path").select("id", *(p[k].alias(k) for k in ("creator", "studio", "series", "episode", "file_name", "parent")))


RULES = [
    Rule(1, "greenhouse", 10, (Condition("path_pattern", "matches", "/greenhouse/"), Condition("codec", "contains", "TUTORIAL")), (("add_tag", "5"),)),
    Rule(2, "not handheld", 20, (Condition("file_pattern", "not_matches", "handheld|review"),), (("add_tag", "6"), ("add_studio", "2"))),
    Rule(3, "broken", 5, (Condition("path_pattern", "matches", "(["), Condition("duration_range", "equals", "60")), (("add_tag", "7"),)),
    Rule(4, "off", 50, (Condition("path_pattern", "matches", "."),), (("add_tag", "8"),), enabled=False),
    Rule(5, "flag", 5, (Condition("path_pattern", "matches", "(?i)GREENHOUSE"),), (("add_tag", "9"),)),
]


@_query("""WITH f AS (SELECT id, contains(file_path, '/greenhouse/') AS a, contains(lower(file_path), 'tutorial') AS b, regexp_matches(file_path, 'handheld|review') AS c FROM v_videos),
r AS (SELECT id AS video_id, CAST(1 AS BIGINT) AS rule_id, concat_ws('; ', CASE WHEN a THEN 'path_pattern matches /greenhouse/' END, CASE WHEN b THEN 'codec contains TUTORIAL' END) AS matched, 'add_tag' AS action, '5' AS target FROM f WHERE a OR b
UNION ALL SELECT id, 2, 'file_pattern not_matches handheld|review', x.action, x.target FROM f, (VALUES ('add_tag', '6'), ('add_studio', '2')) x(action, target) WHERE NOT c) SELECT * FROM r""")
def pipe3_rules(lib):
    return paths.evaluate(lib.rows("videos", "file_path"), RULES)


@_query("""SELECT id, CASE WHEN coalesce(width, 0) = 0 OR coalesce(height, 0) = 0 THEN '1280x-2' WHEN height < 720 OR width <= 1280 THEN 'original' ELSE '1280x-2' END AS resolution FROM v_videos""")
def u1_target_resolution(lib):
    return lib.rows("videos", "width", "height").select("id", X.target_resolution(F.col("width"), F.col("height"), F.lit(1280)).alias("resolution"))


_CAP = "CASE WHEN width >= 3840 THEN 35 WHEN width >= 2560 THEN 20 WHEN width >= 1920 THEN 15 WHEN width >= 1280 THEN 8 ELSE 4 END"


@_query(f"""WITH c AS (SELECT id, {_CAP} AS cap, CAST(floor(bitrate / 1e6 + 0.5e0) AS BIGINT) AS src FROM v_videos WHERE width IS NOT NULL),
t AS (SELECT id, cap, greatest(CASE WHEN src > 0 THEN least(cap, CAST(floor(src * 1.1e0 + 0.5e0) AS BIGINT)) ELSE cap END, 1) AS target FROM c)
SELECT id, CAST(target AS BIGINT) AS target, CAST(least(cap, greatest(target, CAST(floor(target * 1.2e0 + 0.5e0) AS BIGINT))) AS BIGINT) AS most, CAST(2 * least(cap, greatest(target, CAST(floor(target * 1.2e0 + 0.5e0) AS BIGINT))) AS BIGINT) AS buffer FROM t""")
def u2_bitrates(lib):
    target, most, buffer = X.target_bitrate("hevc", F.col("bitrate"), F.col("width"))
    return lib.rows("videos", "bitrate", "width").filter("width is not null").select("id", target.alias("target"), most.alias("most"), buffer.alias("buffer"))


@_query("""WITH g AS (SELECT id, duration_seconds AS d, CAST(ceil(duration_seconds / 30) AS BIGINT) AS n FROM v_videos WHERE duration_seconds > 0), h AS (SELECT *, CAST(ceil(sqrt(n * 2)) AS BIGINT) AS c FROM g)
SELECT id, CAST(i AS BIGINT) AS tile, CAST(i % c * 160 AS BIGINT) AS x, CAST(i // c * 90 AS BIGINT) AS y, CAST(i * 30 AS BIGINT) AS start FROM h, unnest(range(n)) t(i)""")
def u4_tiles(lib):
    """Tiles of storyboards: one every 30 seconds, in a grid with more columns than rows."""
    n = F.ceil(F.col("duration_seconds") / 30).cast("long")
    rows = lib.rows("videos", "duration_seconds").filter("duration_seconds > 0").select("id", n.alias("n"), F.ceil(F.sqrt(n * 2)).cast("long").alias("c"))
    tiles = rows.select("id", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("tile"))
    return tiles.select("id", "tile", (F.col("tile") % F.col("c") * 160).alias("x"), (F.floor(F.col("tile") / F.col("c")) * 90).alias("y"), (F.col("tile") * 30).alias("start"))


@_query("""WITH f AS (SELECT b.id, b.timestamp_seconds AS t, CAST(i AS BIGINT) AS frame, abs(b.timestamp_seconds - i * 10) AS d FROM v_bookmarks b, range(20) r(i))
SELECT id, min_by(frame, (d, frame)) AS frame FROM f WHERE d <= 5 GROUP BY 1""")
def u6_closest_frame(lib):
    """The frame nearest to a bookmark, of frames every 10 seconds and not more than 5 away; the earlier of two."""
    t = F.col("timestamp_seconds")
    k = F.greatest(F.lit(0), F.least(F.lit(19), F.ceil(t / 10 - 0.5))).cast("long")
    return lib.bookmarks.select("id", k.alias("frame"), F.abs(t - k * 10).alias("d")).filter("d <= 5").select("id", "frame")


@_query("SELECT id, round(CASE WHEN coalesce(duration_seconds, 0) > 0 THEN greatest(0, least(duration_seconds * 0.2e0, duration_seconds - 1)) ELSE 5 END, 6) AS second FROM v_videos")
def u7_thumbnail_second(lib):
    return lib.rows("videos", "duration_seconds").select("id", F.round(X.thumbnail_second(F.col("duration_seconds")), 6).alias("second"))


@_query("""WITH h AS (SELECT id, file_size_bytes AS n, CASE id % 5 WHEN 0 THEN 'bytes=' || id || '-' WHEN 1 THEN 'bytes=-' || id * 100 WHEN 2 THEN 'bytes=' || id || '-' || id * 2000000 WHEN 3 THEN 'bytes=-' ELSE 'items=1-2' END AS r FROM v_videos),
p AS (SELECT id, n, TRY_CAST(regexp_extract(r, 'bytes=(\\d*)-(\\d*)', 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(r, 'bytes=(\\d*)-(\\d*)', 2) AS BIGINT) AS b FROM h),
s AS (SELECT id, n, CASE WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL THEN greatest(0, n - b) END AS s, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b WHEN a IS NOT NULL OR b IS NOT NULL THEN n - 1 END AS e FROM p)
SELECT id, s AS first_byte, e AS last_byte FROM s WHERE s <= e AND s < n AND e < n""")
def u8_byte_ranges(lib):
    i = F.col("id")
    header = F.when(i % 5 == 0, F.concat(F.lit("bytes="), i, F.lit("-"))).when(i % 5 == 1, F.concat(F.lit("bytes=-"), i * 100)).when(i % 5 == 2, F.concat(F.lit("bytes="), i, F.lit("-"), i * 2_000_000)).when(i % 5 == 3, "bytes=-").otherwise("items=1-2")
    first, last = X.byte_range(header, F.col("file_size_bytes"))
    return lib.rows("videos", "file_size_bytes").select("id", first.alias("first_byte"), last.alias("last_byte")).filter("first_byte is not null")


@_query("""WITH b AS (SELECT id, bbox_x1 * 1920 AS x1, bbox_y1 * 1080 AS y1, bbox_x2 * 1920 AS x2, bbox_y2 * 1080 AS y2 FROM (SELECT DISTINCT id, bbox_x1, bbox_y1, bbox_x2, bbox_y2 FROM video_face_detections)),
s AS (SELECT *, least(greatest(greatest(greatest(0, x2 - x1), greatest(0, y2 - y1)) * 1.6e0, 1), 1080) AS side FROM b)
SELECT id, CAST(floor(greatest(0, least(x1 + greatest(0, x2 - x1) / 2 - side / 2, 1920 - side)) + 0.5e0) AS BIGINT) AS x, CAST(floor(greatest(0, least(y1 + greatest(0, y2 - y1) / 2 - side / 2, 1080 - side)) + 0.5e0) AS BIGINT) AS y, CAST(floor(side + 0.5e0) AS BIGINT) AS side FROM s""")
def u10_face_crops(lib):
    rows = lib.raw("video_face_detections").select("id", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2").distinct()
    x, y, side = X.crop_square(F.col("bbox_x1") * 1920, F.col("bbox_y1") * 1080, F.col("bbox_x2") * 1920, F.col("bbox_y2") * 1080, F.lit(1920), F.lit(1080))
    return rows.select("id", x.alias("x"), y.alias("y"), side.alias("side"))


@_query("SELECT id, CASE WHEN scan_interval_minutes < 60 THEN '*/' || scan_interval_minutes || ' * * * *' WHEN scan_interval_minutes // 60 < 24 THEN '0 */' || scan_interval_minutes // 60 || ' * * *' ELSE '0 0 * * *' END AS cron FROM v_directories")
def u_cron(lib):
    return lib.rows("watched_directories", "scan_interval_minutes").select("id", X.minutes_to_cron(F.col("scan_interval_minutes")).alias("cron"))


@_query("""SELECT id, round(file_size_bytes / CASE WHEN file_size_bytes >= 1073741824 THEN 1073741824e0 WHEN file_size_bytes >= 1048576 THEN 1048576e0 WHEN file_size_bytes >= 1024 THEN 1024e0 ELSE 1e0 END, 2) AS number,
    CASE WHEN file_size_bytes >= 1073741824 THEN 'GB' WHEN file_size_bytes >= 1048576 THEN 'MB' WHEN file_size_bytes >= 1024 THEN 'KB' ELSE 'Bytes' END AS unit FROM v_videos""")
def u_format_bytes(lib):
    text = F.split(X.format_bytes(F.col("file_size_bytes")), " ")
    return lib.rows("videos", "file_size_bytes").select("id", text[0].cast("double").alias("number"), text[1].alias("unit"))


@_query("SELECT id, md5(file_name || '|' || file_size_bytes) AS fingerprint FROM v_videos")
def u_fingerprints(lib):
    return lib.rows("videos", "file_name", "file_size_bytes").select("id", F.md5(F.concat("file_name", F.lit("|"), "file_size_bytes")).alias("fingerprint"))


_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_V = f"""WITH q AS (SELECT DISTINCT id, video_id, embedding::DOUBLE[] AS e FROM video_face_detections WHERE {_USABLE}), r AS (SELECT DISTINCT id, creator_id, embedding::DOUBLE[] AS e FROM creator_face_embeddings WHERE {_USABLE}),
s AS (SELECT q.id AS query_id, q.video_id, r.id AS match_id, r.creator_id, round(list_cosine_similarity(q.e, r.e), 6) AS similarity FROM q, r),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, match_id) AS INTEGER) AS rank FROM s WHERE similarity >= 0.65e0)
"""


def _faces(lib):
    return lib.raw("video_face_detections").select("id", "video_id", "embedding"), lib.raw("creator_face_embeddings").select("id", "creator_id", "embedding")


@_query("""WITH p AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id AS id, round(list_cosine_similarity(x.embedding::DOUBLE[], p.e), 6) AS similarity FROM embeddings x, p WHERE vec_id <> 7 ORDER BY 2 DESC, 1 LIMIT 10""")
def v2_probe(lib):
    e = lib.raw("embeddings")
    probe = e.filter("vec_id = 7").select(F.col("embedding").alias("p")).limit(1)
    rows = e.filter("vec_id <> 7").crossJoin(F.broadcast(probe))  # one row
    return rows.select(F.col("vec_id").alias("id"), F.round(X.cosine(F.col("embedding"), F.col("p")), 6).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(10)


@_query(_V + "SELECT query_id, match_id, similarity, rank FROM t WHERE rank <= 3")
def v3_top_matches(lib):
    return vectors.top_k(*_faces(lib), 3, 0.65, 64)


@_query(_V + "SELECT video_id, creator_id, count(*) AS detections, max(similarity) AS best, CASE WHEN max(similarity) >= 0.75e0 THEN 'tag' ELSE 'pending' END AS decision FROM t WHERE rank = 1 GROUP BY 1, 2")
def pipe8_match_videos(lib):
    q, c = _faces(lib)
    found = vectors.top_k(q, c, 1, 0.65, 64).join(c.select(F.col("id").alias("match_id"), "creator_id").distinct(), "match_id")
    return vectors.decide(found, q.select(F.col("id").alias("query_id"), "video_id").distinct(), "creator_id", "video_id", 0.75)


@_query("""WITH l AS (SELECT file_path, file_size_bytes + CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS s FROM v_videos WHERE id % 11 <> 0 UNION ALL SELECT file_path || '.new', 1 FROM v_videos WHERE id % 50 = 0)
SELECT CASE WHEN v.file_path IS NULL THEN 'new' WHEN l.file_path IS NULL THEN 'missing' WHEN l.s = v.file_size_bytes THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS files FROM l FULL JOIN v_videos v ON l.file_path = v.file_path GROUP BY 1""")
def pipe7_reconcile(lib):
    v = lib.rows("videos", "file_path", "file_size_bytes")
    listed = v.filter("id % 11 <> 0").select("file_path", (F.col("file_size_bytes") + F.when(F.col("id") % 9 == 0, 1).otherwise(0)).alias("file_size_bytes"))
    listed = listed.unionByName(v.filter("id % 50 = 0").select(F.concat("file_path", F.lit(".new")).alias("file_path"), F.lit(1).cast("long").alias("file_size_bytes")))
    return M.reconcile(listed, v).groupBy("state").agg(F.count(F.lit(1)).alias("files"))


@_query("""WITH w AS (SELECT v.id AS video_id, t.tag_id FROM v_videos v, (VALUES (1), (2), (3)) t(tag_id) WHERE v.directory_id = 4), a AS (SELECT * FROM w WHERE (video_id, tag_id) NOT IN (SELECT (video_id, tag_id) FROM v_video_tags))
SELECT (SELECT count(*) FROM a) AS added, (SELECT count(*) FROM v_video_tags) + (SELECT count(*) FROM a) AS links""")
def pipe9_bulk_add(lib):
    links, added = M.add_links(lib.video_tags, lib.rows("videos", "directory_id").filter("directory_id = 4").select(F.col("id").alias("video_id")), "video_id", "tag_id", (1, 2, 3))
    return added.agg(F.count(F.lit(1)).alias("added")).crossJoin(links.agg(F.count(F.lit(1)).alias("links")))


@_query("SELECT count(*) AS removed FROM v_video_tags WHERE tag_id IN (10, 20, 30, 40) AND video_id IN (SELECT id FROM v_videos WHERE directory_id <= 20)")
def pipe9_bulk_remove(lib):
    _, gone = M.remove_links(lib.video_tags, lib.rows("videos", "directory_id").filter("directory_id <= 20").select(F.col("id").alias("video_id")), "video_id", "tag_id", (10, 20, 30, 40))
    return gone.agg(F.count(F.lit(1)).alias("removed"))


@_query("""WITH w AS (SELECT creator_id, platform_id + (creator_id % 3 = 0)::INT AS platform_id, username || CASE WHEN creator_id % 4 = 0 THEN 'x' ELSE '' END AS username FROM v_creator_platforms WHERE creator_id % 2 = 1 AND creator_id % 7 <> 0),
b AS (SELECT coalesce(w.creator_id, s.creator_id) AS creator_id, w.creator_id AS w, s.creator_id AS s, w.username AS nu, s.username AS su FROM w FULL JOIN (SELECT * FROM v_creator_platforms WHERE creator_id IN (SELECT creator_id FROM w)) s ON s.creator_id = w.creator_id AND s.platform_id = w.platform_id)
SELECT creator_id, count(*) FILTER (s IS NULL) AS added, count(*) FILTER (w IS NOT NULL AND s IS NOT NULL AND nu IS DISTINCT FROM su) AS updated, count(*) FILTER (w IS NULL) AS removed FROM b GROUP BY 1""")
def pipe10_import_preview(lib):
    p = lib.creator_platforms
    wanted = p.filter("creator_id % 2 = 1 and creator_id % 7 <> 0").select("creator_id", (F.col("platform_id") + (F.col("creator_id") % 3 == 0).cast("int")).alias("platform_id"), F.concat("username", F.when(F.col("creator_id") % 4 == 0, "x").otherwise("")).alias("username"))
    return M.child_changes(p, wanted, "creator_id", ["platform_id"], "username", True)


@_query("""WITH n AS (SELECT o_orderkey AS playlist_id, 3 AS video_id, 0 AS n FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT o_orderkey, 9, 1 FROM orders WHERE o_orderkey % 100 = 0),
f AS (SELECT n.* FROM n LEFT JOIN v_playlist_videos p USING (playlist_id, video_id) WHERE p.playlist_id IS NULL), l AS (SELECT playlist_id, max(position) AS last FROM v_playlist_videos GROUP BY 1)
SELECT f.playlist_id, CAST(f.video_id AS BIGINT) AS video_id, CAST(coalesce(l.last, -1) + row_number() OVER (PARTITION BY f.playlist_id ORDER BY n, f.video_id) AS INTEGER) AS position FROM f LEFT JOIN l ON l.playlist_id = f.playlist_id""")
def pipe15_append(lib):
    lists = lib.playlists.filter("id % 100 = 0").select(F.col("id").alias("playlist_id"))
    new = lists.select("playlist_id", F.lit(3).cast("long").alias("video_id"), F.lit(0).alias("n")).unionByName(lists.select("playlist_id", F.lit(9).cast("long").alias("video_id"), F.lit(1).alias("n")))
    items = lib.playlist_videos
    return M.append_items(items, new).join(items.select("playlist_id", "video_id"), ["playlist_id", "video_id"], "left_anti").select("playlist_id", "video_id", "position")


@_query("SELECT id, CASE WHEN id % 4 = 0 THEN upper(name) ELSE name END AS name FROM v_tags UNION ALL SELECT 1000000 + id, 'new ' || name FROM v_tags WHERE id <= 5")
def s12_upsert(lib):
    t = lib.tags.select("id", "name")
    new = t.filter("id % 4 = 0").select("id", F.upper("name").alias("name")).unionByName(t.filter("id <= 5").select((F.col("id") + 1_000_000).alias("id"), F.concat(F.lit("new "), "name").alias("name")))
    return M.upsert(t, new, ["id"])


@_query("SELECT count(*) AS links, count(DISTINCT video_id) AS videos FROM (SELECT * FROM v_video_tags UNION SELECT video_id, CAST(1 AS BIGINT) FROM v_video_creators)")
def s11_insert_ignore(lib):
    new = lib.video_creators.select("video_id", F.lit(1).cast("long").alias("tag_id"))
    return M.insert_ignore(lib.video_tags, new, ["video_id", "tag_id"]).agg(F.count(F.lit(1)).alias("links"), F.count_distinct("video_id").alias("videos"))


@_query("SELECT id, CASE WHEN file_size_bytes < 30000000 THEN false ELSE is_available END AS is_available FROM v_videos WHERE NOT coalesce(duration_seconds < 30, false)")
def s13_update_delete(lib):
    marked = M.update(lib.rows("videos", "file_size_bytes", "is_available", "duration_seconds"), F.col("file_size_bytes") < 30_000_000, {"is_available": F.lit(False)})
    return M.delete(marked, F.col("duration_seconds") < 30).select("id", "is_available")


@_query("SELECT v.id AS video_id, CAST(t.id AS BIGINT) AS target_id FROM v_videos v, (VALUES (1), (2)) t(id) WHERE v.directory_id = 3")
def j21_product(lib):
    return lib.rows("videos", "directory_id").filter("directory_id = 3").select(F.col("id").alias("video_id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("target_id"))


@_query("SELECT s.user_id, s.video_id, v.codec FROM v_video_stats s JOIN v_videos v ON v.id = s.video_id WHERE s.play_count > 1")
def j12_stats_videos(lib):
    return lib.video_stats.filter("play_count > 1").join(lib.rows("videos", "codec").select(F.col("id").alias("video_id"), "codec"), "video_id").select("user_id", "video_id", "codec")


@_query("SELECT id FROM v_playlists WHERE id IN (10, 20, 30, 40, 50, 60) AND user_id = (SELECT user_id FROM v_playlists WHERE id = 30)")
def f25_owned(lib):
    """Of the playlists asked for, those of the owner of one of them."""
    owner = lib.playlists.filter("id = 30").select("user_id").limit(1)
    return lib.playlists.filter(F.col("id").isin(10, 20, 30, 40, 50, 60)).join(F.broadcast(owner), "user_id", "left_semi").select("id")  # one row


@_query("""WITH b AS (SELECT codec, count(*) AS n FROM v_videos GROUP BY 1), o AS (SELECT coalesce(codec, 'Unknown') AS codec, n FROM b)
SELECT (SELECT count(*) FROM v_videos) AS total_videos, '[' || string_agg('{"codec":"' || codec || '","count":' || n || '}', ',' ORDER BY codec, n) || ']' AS codecs FROM o""")
def pipe12_snapshot(lib):
    """The row of a library snapshot: a total, and the codec breakdown as JSON text."""
    by = lib.rows("videos", "codec").groupBy("codec").agg(F.count(F.lit(1)).alias("count")).select(F.coalesce("codec", F.lit("Unknown")).alias("codec"), "count")
    return by.agg(F.sum("count").alias("total_videos"), F.to_json(F.sort_array(F.collect_list(F.struct("codec", "count")))).alias("codecs"))


@_query("SELECT c_mktsegment AS filter_key, CASE WHEN c_mktsegment LIKE '%A%' THEN count(*) ELSE 0 END AS processed FROM customer GROUP BY 1 UNION ALL SELECT 'NEW', 1")
def pipe16_progress(lib):
    """Progress by filter, set where it was sent anew and kept where not."""
    keys = lib.raw("customer").groupBy(F.col("c_mktsegment").alias("filter_key")).agg(F.count(F.lit(1)).alias("n"))
    sent = keys.filter("filter_key like '%A%'").select("filter_key", F.col("n").alias("processed"))
    sent = sent.unionByName(keys.limit(1).select(F.lit("NEW").alias("filter_key"), F.lit(1).cast("long").alias("processed")))
    return M.upsert(keys.select("filter_key", F.lit(0).cast("long").alias("processed")), sent, ["filter_key"])


@_query("SELECT id, CASE id % 4 WHEN 0 THEN 29.97 WHEN 1 THEN 25.0 WHEN 2 THEN 24.0 END AS fps FROM v_videos")
def u9_frame_rates(lib):
    text = F.element_at(F.array(F.lit("30000/1001"), F.lit("25/1"), F.lit("24"), F.lit("0/0")), (F.col("id") % 4 + 1).cast("int"))
    return lib.rows("videos").select("id", X.frames_per_second(text).alias("fps"))


@_query("SELECT id, CASE lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) WHEN 'mp4' THEN 'video/mp4' WHEN 'mkv' THEN 'video/x-matroska' WHEN 'avi' THEN 'video/x-msvideo' WHEN 'mov' THEN 'video/quicktime' WHEN 'wmv' THEN 'video/x-ms-wmv' WHEN 'flv' THEN 'video/x-flv' WHEN 'webm' THEN 'video/webm' WHEN 'm4v' THEN 'video/x-m4v' WHEN 'mpg' THEN 'video/mpeg' WHEN 'mpeg' THEN 'video/mpeg' ELSE 'application/octet-stream' END AS media_type FROM v_videos")
def u13_media_types(lib):
    return lib.rows("videos", "file_path").select("id", X.media_type(F.col("file_path")).alias("media_type"))


@_query("SELECT user_id, video_id, CAST(least(99, floor(100e0 * total_watch_seconds / 300 + 0.5e0)) AS BIGINT) AS percent FROM v_video_stats")
def u11_progress(lib):
    return lib.video_stats.select("user_id", "video_id", X.progress(F.col("total_watch_seconds"), F.lit(300.0)).alias("percent"))


@_query("SELECT batch_id, min(CASE WHEN status = 'pending' THEN id END) AS first_pending FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, status ORDER BY created_at, id) AS k FROM v_jobs) WHERE k = 1 AND status = 'pending' GROUP BY 1")
def s16_next_in_queue(lib):
    from cinelake.sources.exchange import runnable

    return runnable(lib.jobs, 1, "batch_id").select("batch_id", F.col("id").alias("first_pending"))


@_query("SELECT e.vec_id AS id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings e")
def v5_stored_vectors(lib):
    """Vectors through their JSON text and back."""
    text = F.to_json(F.struct(F.col("embedding").alias("v")))
    back = F.from_json(text, "v array<float>")["v"]
    return lib.raw("embeddings").filter(back == F.col("embedding")).select(F.col("vec_id").alias("id"), F.size(back).alias("n"))
