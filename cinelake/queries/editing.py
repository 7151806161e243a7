"""Changes in bulk, imports, sessions, planners and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinelake.functions import hashing
from cinelake.functions import scalars as X
from cinelake.operators import accounts as A
from cinelake.operators import merging as M
from cinelake.operators import paths
from cinelake.operators import snapshots as N
from cinelake.operators.paths import Condition, Rule
from cinelake.sources.library import AS_OF, Library, sql

QUERIES: dict = {}
SQL: dict = {}


def _query(sql_text: str):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, directory: fn(Library(spark, directory))
        if sql_text:
            SQL[fn.__name__] = sql(sql_text)
        return fn

    return add


@_query("SELECT (SELECT count(*) FROM v_creators WHERE id % 2 = 0) AS conflicts, (SELECT count(*) FROM v_creators) + (SELECT count(*) FROM v_creators WHERE id % 2 = 1) AS rows_after")
def s10_insert_conflicts(lib):
    old = lib.rows("creators", "name")
    new = old.select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 10_000_000).alias("id"), "name")
    table, conflicts = M.insert_new(old, new, ["id"])
    return conflicts.agg(F.count(F.lit(1)).alias("conflicts")).crossJoin(F.broadcast(table.agg(F.count(F.lit(1)).alias("rows_after"))))


@_query("SELECT 4 AS requested, (SELECT count(*) FROM v_playlists WHERE id NOT IN (1, 2, 3, -5)) AS rows_after")
def s15_delete_requested(lib):
    left, requested = M.delete_ids(lib.playlists, "id", (1, 2, 3, -5))
    return left.agg(F.count(F.lit(1)).alias("rows_after")).select(F.lit(requested).alias("requested"), "rows_after")


_SESSIONS = "SELECT event_id AS id, user_id, ts + INTERVAL 30 DAY AS expires_at FROM events"


@_query(f"WITH s AS ({_SESSIONS}) SELECT id, user_id FROM s WHERE expires_at > TIMESTAMP '2024-02-20'")
def f26_valid_sessions(lib):
    return A.valid(lib.sessions, F.lit("2024-02-20").cast("timestamp_ntz")).select("id", "user_id")


@_query(f"WITH s AS ({_SESSIONS}) SELECT id FROM s WHERE NOT coalesce(expires_at <= TIMESTAMP '2024-02-20', false)")
def f26_cleaned_sessions(lib):
    return A.cleaned(lib.sessions, F.lit("2024-02-20").cast("timestamp_ntz")).select("id")


@_query(f"WITH s AS ({_SESSIONS}) SELECT s.id, u.c_name AS username FROM s JOIN customer u ON u.c_custkey = s.user_id WHERE expires_at > TIMESTAMP '2024-02-10'")
def j23_session_users(lib):
    return A.with_users(A.valid(lib.sessions, F.lit("2024-02-10").cast("timestamp_ntz")), lib.users)


@_query("SELECT count(*) AS users, count(*) = 0 AS may_register FROM customer")
def a30_user_guard(lib):
    return A.guard(lib.users)


@_query(f"WITH s AS ({_SESSIONS}) SELECT count(*) AS total, count(u.c_custkey) AS authenticated FROM s LEFT JOIN customer u ON u.c_custkey = s.user_id")
def a31_connections(lib):
    return A.connections(lib.sessions, lib.users)


@_query(f"WITH s AS ({_SESSIONS}) SELECT count(*) AS orphans FROM s WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def q5_sessions_without_user(lib):
    return lib.sessions.join(lib.users.select(F.col("id").alias("user_id")), "user_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


_AUTO = [
    Rule(1, "greenhouse", 10, (Condition("path_pattern", "not_matches", "/greenhouse/"), Condition("codec", "equals", "TUTORIAL")), (("add_tag", "5"), ("set_rating", "4"))),
    Rule(2, "studio", 20, (Condition("file_pattern", "matches", "handheld|review"),), (("add_creator", "$creator"), ("add_studio", "$studio"))),
]


@_query(r"""WITH f AS (SELECT id, file_path AS p, contains(file_path, '/greenhouse/') AS a, contains(lower(file_path), 'tutorial') AS b, regexp_matches(file_path, 'handheld|review') AS c FROM v_videos),
s AS (SELECT *, CASE WHEN regexp_matches(p, '/(?:onlyfans|OF)/([^/]+)/?') OR regexp_matches(p, '/(?:fansly|FS)/([^/]+)/?') OR regexp_matches(p, '/([^/]+)/([^/]+)/(?:[Ee]p?[-_]?(\d+)|(\d+))') OR regexp_matches(p, '/videos/([^/]+)/?') THEN NULL ELSE nullif(regexp_extract(p, '/([^/]+)/([^/]+)/?', 1), '') END AS studio,
  CASE WHEN regexp_matches(p, '/(?:onlyfans|OF)/([^/]+)/?') THEN regexp_extract(p, '/(?:onlyfans|OF)/([^/]+)/?', 1) WHEN regexp_matches(p, '/(?:fansly|FS)/([^/]+)/?') THEN regexp_extract(p, '/(?:fansly|FS)/([^/]+)/?', 1)
    WHEN regexp_matches(p, '/([^/]+)/([^/]+)/(?:[Ee]p?[-_]?(\d+)|(\d+))') THEN regexp_extract(p, '/([^/]+)/([^/]+)/(?:[Ee]p?[-_]?(\d+)|(\d+))', 1) WHEN regexp_matches(p, '/videos/([^/]+)/?') THEN regexp_extract(p, '/videos/([^/]+)/?', 1)
    ELSE nullif(regexp_extract(p, '/([^/]+)/([^/]+)/?', 2), '') END AS creator FROM f)
SELECT id AS video_id, CAST(1 AS BIGINT) AS rule_id, 'add_tag' AS action, '5' AS target FROM s WHERE a OR b UNION ALL SELECT id, 2, 'add_creator', creator FROM s WHERE c AND creator IS NOT NULL UNION ALL SELECT id, 2, 'add_studio', studio FROM s WHERE c AND studio IS NOT NULL""")
def pipe4_auto_tagging(lib):
    """Rules as automatic tagging reads them: operators ignored, only additions, $names taken from the path."""
    return paths.auto_tags(lib.rows("videos", "file_path"), _AUTO)


@_query("""WITH f AS (SELECT id, contains(file_path, '/greenhouse/') AS a, contains(lower(file_path), 'tutorial') AS b FROM v_videos), m AS (SELECT id AS video_id, CAST(5 AS BIGINT) AS tag_id FROM f WHERE a OR b)
SELECT CAST(1 AS BIGINT) AS rule_id, count(*) AS matched, count(*) FILTER ((video_id, tag_id) NOT IN (SELECT (video_id, tag_id) FROM v_video_tags)) AS applied FROM m""")
def pipe3_applied(lib):
    """Videos that rules match, and the tag links that applying them adds."""
    rule = Rule(1, "greenhouse", 10, (Condition("path_pattern", "matches", "/greenhouse/"), Condition("codec", "contains", "TUTORIAL")), (("add_tag", "5"),))
    return paths.applied(paths.evaluate(lib.rows("videos", "file_path"), [rule]), lib.video_tags)


_ACTIONS = M.BulkActions(add={"tags": (1, 2), "creators": (5, 6), "studios": (3,)}, remove={"tags": (3,), "creators": (4,), "studios": (1, 2)})
_BULK = {"tags": ("v_video_tags", "tag_id", "(1), (2)", "3"), "creators": ("v_video_creators", "creator_id", "(5), (6)", "4"), "studios": ("v_video_studios", "studio_id", "(3)", "1, 2")}
_W = "SELECT id FROM v_videos WHERE directory_id IN (3, 4)"


@_query("SELECT " + ", ".join(f"(SELECT count(*) FROM ({_W}) v, (VALUES {add}) x(k) WHERE (v.id, x.k) NOT IN (SELECT (video_id, {key}) FROM {t})) AS {n}_added, (SELECT count(*) FROM {t} WHERE {key} IN ({rem}) AND video_id IN ({_W})) AS {n}_removed" for n, (t, key, add, rem) in _BULK.items()))
def pipe9_bulk_apply(lib):
    """All six actions on the videos of two directories: links really added and removed."""
    chosen = lib.rows("videos", "directory_id").filter("directory_id in (3, 4)").select(F.col("id").alias("video_id"))
    return M.bulk_counts(chosen, lib.links, _ACTIONS)


@_query("SELECT " + ", ".join(f"(SELECT count(*) FROM ({_W})) * {add.count('(')} AS {n}_added, (SELECT count(*) FROM ({_W})) * {rem.count(',') + 1} AS {n}_removed" for n, (t, key, add, rem) in _BULK.items()))
def pipe9b_bulk_attempts(lib):
    """The same counted by attempts: every link asked for, whether it was there or not."""
    chosen = lib.rows("videos", "directory_id").filter("directory_id in (3, 4)").select(F.col("id").alias("video_id"))
    return M.bulk_attempts(chosen, _ACTIONS)


_ITEMS = "SELECT id AS item, CASE WHEN id % 3 = 0 THEN id WHEN id % 3 = 1 THEN id + 90000000 END AS id, CASE WHEN id % 3 = 2 AND id % 2 = 0 THEN name WHEN id % 3 = 2 THEN 'new ' || id END AS name FROM v_creators"


@_query(f"""WITH i AS ({_ITEMS}), n AS (SELECT name, min(id) AS id FROM v_creators GROUP BY 1)
SELECT i.item, CASE WHEN i.id IS NOT NULL THEN c.id ELSE n.id END AS entity_id, CASE WHEN i.id IS NOT NULL AND c.id IS NULL THEN 'unknown id' WHEN i.id IS NOT NULL OR n.id IS NOT NULL THEN 'update' ELSE 'create' END AS action
FROM i LEFT JOIN v_creators c ON c.id = i.id LEFT JOIN n ON i.id IS NULL AND n.name = i.name""")
def pipe10_resolve(lib):
    """Imported items found by id, else by name; an id that is not there is an error, a name that is not there a new row."""
    c = lib.rows("creators", "name")
    k = F.col("id") % 3
    items = c.select(
        F.col("id").alias("item"), F.when(k == 0, F.col("id")).when(k == 1, F.col("id") + 90_000_000).alias("id"), F.when((k == 2) & (F.col("id") % 2 == 0), F.col("name")).when(k == 2, F.concat(F.lit("new "), "id")).alias("name")
    )
    return M.resolve(items, c, "item")


@_query("SELECT playlist_id, video_id, CASE WHEN video_id % 2 = 0 THEN 100 - position ELSE position END AS position FROM v_playlist_videos")
def pipe15_reorder(lib):
    items = lib.playlist_videos
    moved = items.filter("video_id % 2 = 0").select("playlist_id", "video_id", (F.lit(100) - F.col("position")).cast("int").alias("position"))
    return M.reorder(items, moved.unionByName(moved.limit(1).select(F.lit(-1).cast("long").alias("playlist_id"), "video_id", "position")))


@_query("""WITH w AS (SELECT creator_id, url || CASE WHEN creator_id % 2 = 0 THEN '/x' ELSE '' END AS url, 'p' || creator_id % 3 AS platform FROM v_social_links), s AS (SELECT creator_id, url, 'p' || creator_id % 3 AS platform FROM v_social_links WHERE creator_id % 5 <> 0)
SELECT w.creator_id, CASE WHEN s.url = w.url THEN 'same' WHEN s.creator_id IS NOT NULL THEN 'update' ELSE 'create' END AS action FROM w LEFT JOIN s USING (creator_id, platform)""")
def pipe11_social_links(lib):
    """Links sent in bulk: equal ones stay, one of the platform gets the new address, others are new."""
    at = F.concat(F.lit("p"), F.col("creator_id") % 3)
    wanted = lib.social_links.select("creator_id", F.concat("url", F.when(F.col("creator_id") % 2 == 0, "/x").otherwise("")).alias("url"), at.alias("platform"))
    stored = lib.social_links.filter("creator_id % 5 <> 0").select("creator_id", "url", at.alias("platform"))
    return M.match_children(wanted, stored, ["creator_id", "platform"], "url").select("creator_id", "action")


@_query("""SELECT (SELECT count(*) FROM v_videos v WHERE v.id NOT IN (SELECT video_id FROM v_video_tags)) AS without_tags, (SELECT count(*) FROM v_tags) AS tags,
(SELECT '[' || string_agg('{"id":' || id || ',"name":"' || replace(name, '"', '\\"') || '","video_count":' || n || '}', ',' ORDER BY n DESC, id) || ']' FROM (SELECT t.id, t.name, count(*) AS n FROM v_tags t JOIN v_video_tags v ON v.tag_id = t.id GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10)) AS top_tags""")
def pipe12_content(lib):
    """The row of a content snapshot: gaps, totals and the most used tags as JSON text."""
    return N.content(lib)


@_query("""SELECT CAST(sum(play_count) AS BIGINT) AS plays, round(sum(total_watch_seconds), 2) AS seconds,
(SELECT '{' || string_agg('"' || lpad(CAST(h AS VARCHAR), 2, '0') || '":' || n, ',' ORDER BY h) || '}' FROM (SELECT h, (SELECT count(*) FROM v_video_stats WHERE extract(hour FROM last_played_at) = h) AS n FROM range(24) r(h))) AS activity_by_hour FROM v_video_stats""")
def pipe12_usage(lib):
    """The row of a usage snapshot, with the plays of every hour as a JSON object."""
    return N.usage(lib)


@_query("""SELECT CAST((SELECT sum(file_size_bytes) FROM v_videos) AS BIGINT) AS video_bytes, (SELECT '[' || string_agg('{"directory_id":' || id || ',"size_bytes":' || b || ',"video_count":' || n || '}', ',' ORDER BY id) || ']'
FROM (SELECT d.id, CAST(coalesce(sum(v.file_size_bytes), 0) AS BIGINT) AS b, count(v.id) AS n FROM v_directories d LEFT JOIN v_videos v ON v.directory_id = d.id GROUP BY 1)) AS directories""")
def pipe12_storage(lib):
    """The row of a storage snapshot, with the directories as JSON text."""
    return N.storage(lib)


@_query("SELECT CAST(height AS VARCHAR) || 'p_' || c AS id, w AS target_width, c || '_vaapi' AS x FROM (SELECT 1 AS height, 2 AS w, 'a' AS c) WHERE false UNION ALL " + " UNION ALL ".join(f"SELECT '{p.id}', {p.target_width or 'NULL'}, '{p.codec}'" for p in X.PRESETS))
def u3_presets(lib):
    """The conversion presets with what each asks of the encoder."""
    return X.presets(lib.spark).select("id", "target_width", F.col("codec").alias("x"))


@_query("SELECT id, CAST(ceil(duration_seconds / 30) AS BIGINT) AS frames, CAST(i * 30 AS DOUBLE) AS second FROM v_videos, unnest(range(CAST(ceil(duration_seconds / 30) AS BIGINT))) t(i) WHERE duration_seconds > 0")
def u5_frame_times(lib):
    n, times = X.frame_times(F.col("duration_seconds"), 30)
    return lib.rows("videos", "duration_seconds").filter("duration_seconds > 0").select("id", n.alias("frames"), F.explode(times).alias("second"))


@_query("SELECT id, CAST(floor(CAST(files_found AS DOUBLE) * 1000 / (files_added + 1) * (files_found - files_added - 1) / 1000 + 0.5e0) AS BIGINT) AS seconds_left FROM v_scan_logs WHERE files_found > files_added")
def u12_scan_eta(lib):
    rows = lib.scan_logs.filter("files_found > files_added")
    return rows.select("id", X.seconds_left(F.col("files_found") * 1000.0, F.col("files_added") + 1, F.col("files_found")).alias("seconds_left"))


@_query("""WITH p AS (SELECT user_id, event_id, ts, CAST(least(99, floor(value / 5 + 0.5e0)) AS BIGINT) AS percent FROM events WHERE event_type = 'view'), m AS (SELECT *, max(percent) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p)
SELECT event_id, percent FROM m WHERE seen IS NULL OR percent > seen""")
def u11_new_heights(lib):
    """Progress reports that are above all before them."""
    rows = lib.raw("events").filter("event_type = 'view'").select("user_id", "event_id", "ts", X.progress(F.col("value"), F.lit(500.0)).alias("percent"))
    return X.rising(rows, ["user_id"], ["ts", "event_id"], "percent", 0).select("event_id", "percent")


@_query("SELECT video_id, string_agg(c.name, ', ' ORDER BY c.name, c.id) AS creators FROM v_video_creators v JOIN v_creators c ON c.id = v.creator_id GROUP BY 1")
def j6_creators_of_videos(lib):
    return M.names_of(lib.video_creators, lib.rows("creators", "name"), "video_id", "creator_id", "creators")


@_query("SELECT video_id, string_agg(c.name, ', ' ORDER BY c.name, c.id) AS studios FROM v_video_studios v JOIN v_studios c ON c.id = v.studio_id GROUP BY 1")
def j6_studios_of_videos(lib):
    return M.names_of(lib.video_studios, lib.rows("studios", "name"), "video_id", "studio_id", "studios")


@_query("SELECT creator_id, string_agg(c.name, ', ' ORDER BY c.name, c.id) AS studios FROM (SELECT DISTINCT * FROM v_creator_studios) v JOIN v_studios c ON c.id = v.studio_id GROUP BY 1")
def j6_studios_of_creators(lib):
    return M.names_of(lib.creator_studios.distinct(), lib.rows("studios", "name"), "creator_id", "studio_id", "studios")


@_query("SELECT v.id, v.file_name, t.file_path AS picture FROM v_videos v JOIN v_video_studios s ON s.video_id = v.id LEFT JOIN v_thumbnails t ON t.video_id = v.id WHERE s.studio_id = 2")
def j6_videos_of_studio(lib):
    ids = lib.video_studios.filter("studio_id = 2").select(F.col("video_id").alias("id"))
    picture = lib.thumbnails.select(F.col("video_id").alias("id"), F.col("file_path").alias("picture"))
    return lib.rows("videos", "file_name").join(ids, "id").join(picture, "id", "left").select("id", "file_name", "picture")


@_query(f"SELECT status, count(*) AS jobs, round(avg(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 1e6, 2) AS mean_age FROM v_jobs GROUP BY 1")
def q15_job_ages(lib):
    age = F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    return lib.jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.round(F.avg(age) / 1e6, 2).alias("mean_age"))


@_query("SELECT video_id, rating, rated_at FROM v_ratings WHERE video_id = 1 ORDER BY rated_at DESC, rating LIMIT 20")
def t11_ratings(lib):
    return lib.ratings.filter("video_id = 1").orderBy(F.desc("rated_at"), "rating").limit(20)


@_query("SELECT DISTINCT id, is_primary FROM creator_face_embeddings WHERE creator_id = (SELECT min(creator_id) FROM creator_face_embeddings) ORDER BY is_primary DESC, id")
def t11_reference_faces(lib):
    faces = lib.raw("creator_face_embeddings").select("id", "creator_id", "is_primary").distinct()
    first = faces.agg(F.min("creator_id").alias("creator_id"))
    return faces.join(F.broadcast(first), "creator_id", "left_semi").orderBy(F.desc("is_primary"), "id").select("id", "is_primary")  # one row


@_query("SELECT id, CAST(row_number() OVER (ORDER BY priority DESC, name) AS INTEGER) AS place FROM (VALUES (1, 'b', 5), (2, 'a', 5), (3, 'c', 9)) r(id, name, priority)")
def t10_rule_order(lib):
    rules = [Rule(1, "b", 5, (), ()), Rule(2, "a", 5, (), ()), Rule(3, "c", 9, (), ())]
    return lib.spark.createDataFrame([(r.id, k + 1) for k, r in enumerate(paths.in_order(rules))], "id int, place int")


_SIZE, _DAY = r"'(?:^|[_\-\s])(4K|1080p|720p|480p|360p)(?:[_\-\s]|$)'", r"'(\d{4})[-_](\d{2})[-_](\d{2})'"


@_query(f"""WITH n AS (SELECT id, CASE id % 4 WHEN 0 THEN 'clip_4K_' WHEN 1 THEN '2021-03-04_' WHEN 2 THEN 'a-hdr-b_720p_' ELSE '' END || file_name AS f FROM v_videos)
SELECT id, CASE WHEN regexp_matches(f, {_SIZE}) THEN 'Resolution Tag' WHEN regexp_matches(f, {_DAY}) THEN 'Date Pattern' END AS pattern, CASE WHEN regexp_matches(f, {_SIZE}) THEN 'medium' ELSE 'low' END AS confidence,
  concat_ws(',', nullif(upper(regexp_extract(f, {_SIZE}, 1)), ''), CASE WHEN regexp_matches(f, '(?i)[._\\-]hdr[._\\-]') THEN 'HDR' END, CASE WHEN regexp_matches(f, '(?i)[._\\-]vr[._\\-]') THEN 'VR' END) AS tags,
  lower(regexp_extract(f, '\\.([^./]+)$', 1)) AS extension FROM n""")
def pipe5_names(lib):
    """What bare file names say: patterns of medium and low confidence, tags and extension."""
    i = F.col("id") % 4
    name = F.concat(F.when(i == 0, "clip_4K_").when(i == 1, "2021-03-04_").when(i == 2, "a-hdr-b_720p_").otherwise(""), F.col("file_name"))
    p = paths.parse(name)
    return lib.rows("videos", "file_name").select("id", *(p[k].alias(k) for k in ("pattern", "confidence", "tags", "extension")))


@_query("SELECT id, list_extract(string_split(file_path, '/'), -3) AS grandparent, 'high' AS confidence, CASE WHEN regexp_matches(file_path, '/([^/]+)/([^/]+)/(?:[Ee]p?[-_]?(\\d+)|(\\d+))') THEN 'Creator Series Episode' ELSE 'Studio Creator Folder' END AS pattern FROM v_videos")
def pipe5_folders(lib):
    p = paths.parse(F.col("file_path"))
    return lib.rows("videos", "file_path").select("id", *(p[k].alias(k) for k in ("grandparent", "confidence", "pattern")))


@_query("SELECT DISTINCT id, timestamp_seconds FROM video_face_detections WHERE video_id = (SELECT min(video_id) FROM video_face_detections) ORDER BY timestamp_seconds, id")
def t11_detections(lib):
    rows = lib.raw("video_face_detections").select("id", "video_id", "timestamp_seconds").distinct()
    first = rows.agg(F.min("video_id").alias("video_id"))
    return rows.join(F.broadcast(first), "video_id", "left_semi").orderBy("timestamp_seconds", "id").select("id", "timestamp_seconds")  # one row


@_query("")
def u_file_fingerprints(lib):
    """Fingerprints of the directory's own files, three samples of the large ones, never a whole large file in memory."""
    files = lib.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(lib.directory).select("path")
    return hashing.of_files(files).select(F.element_at(F.split("path", "/"), -1).alias("file"), "fingerprint")
