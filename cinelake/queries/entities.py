"""Creators, studios, tags, favourites and playlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinelake.operators import entities as E
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


_CREATORS = """WITH o AS (SELECT id, name, (SELECT count(*) FROM v_video_creators x WHERE x.creator_id = c.id) AS video_count, (SELECT count(*) FROM v_creator_platforms x WHERE x.creator_id = c.id) AS platform_count,
  (SELECT count(*) FROM v_social_links x WHERE x.creator_id = c.id) AS social_count, profile_picture_path IS NULL AS np FROM v_creators c),
f AS (SELECT *, concat_ws(',', CASE WHEN np THEN 'picture' END, CASE WHEN platform_count + social_count = 0 THEN 'account' END, CASE WHEN video_count = 0 THEN 'videos' END) AS missing FROM o)
"""
_STUDIOS = """WITH o AS (SELECT CAST(id AS BIGINT) AS id, name, (SELECT count(*) FROM v_video_studios x WHERE x.studio_id = c.id) AS video_count, (SELECT count(*) FROM v_creator_studios x WHERE x.studio_id = c.id) AS creator_count, profile_picture_path IS NULL AS np FROM v_studios c),
f AS (SELECT *, concat_ws(',', CASE WHEN np THEN 'picture' END, CASE WHEN video_count + creator_count = 0 THEN 'links' END) AS missing FROM o)
"""


@_query(_CREATORS + "SELECT id, name, video_count, platform_count, social_count, missing, missing = '' AS is_complete FROM f")
def j4_creators(lib):
    return E.creators_overview(lib)


@_query(_STUDIOS + "SELECT id, name, video_count, creator_count, missing, missing = '' AS is_complete FROM f")
def a23_studios(lib):
    return E.studios_overview(lib)


@_query(_CREATORS + "SELECT id FROM f WHERE contains(missing, 'picture') AND video_count BETWEEN 1 AND 30")
def f16_missing_picture(lib):
    return E.creators_overview(lib).filter(F.col("missing").contains("picture") & F.col("video_count").between(1, 30)).select("id")


@_query(_STUDIOS + "SELECT id FROM f WHERE missing = ''")
def f17_complete_studios(lib):
    return E.studios_overview(lib).filter("is_complete").select("id")


@_query(_CREATORS + "SELECT id, video_count FROM f WHERE video_count <= 5")
def f18_few_videos(lib):
    return E.creators_overview(lib).filter("video_count <= 5").select("id", "video_count")


@_query("SELECT id FROM v_creators WHERE name ILIKE '%ma%' UNION SELECT c.id FROM v_creators c JOIN v_creator_platforms p ON p.creator_id = c.id WHERE p.username ILIKE '%ma%'")
def f19_name_or_account(lib):
    return E.search(lib.rows("creators", "name"), lib.creator_platforms, "ma")


@_query("SELECT c.id, c.name FROM v_creators c JOIN v_creator_studios s ON s.creator_id = c.id WHERE s.studio_id = 1")
def j5_creators_of_studio(lib):
    return lib.rows("creators", "name").join(lib.creator_studios.filter("studio_id = 1").select(F.col("creator_id").alias("id")), "id").select("id", "name")


@_query("SELECT id, file_name FROM v_videos WHERE id IN (SELECT video_id FROM v_video_tags WHERE tag_id = (SELECT tag_id FROM v_video_tags GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))")
def j6_videos_of_top_tag(lib):
    top = E.counts(lib.video_tags, "tag_id", "n").orderBy(F.desc("n"), "id").limit(1).select(F.col("id").alias("tag_id"))
    ids = lib.video_tags.join(F.broadcast(top), "tag_id").select(F.col("video_id").alias("id"))  # one row
    return lib.rows("videos", "file_name").join(ids, "id", "left_semi").select("id", "file_name")


@_query("SELECT id FROM v_videos WHERE id IN (SELECT video_id FROM v_video_creators WHERE creator_id = 5)")
def j6_videos_of_creator(lib):
    return E.linked_videos(lib, lib.video_creators, "creator_id", 5).select("id")


@_query("SELECT v.id, string_agg(t.name, ', ' ORDER BY t.name, t.id) AS tags FROM v_videos v JOIN v_video_tags b ON b.video_id = v.id JOIN v_tags t ON t.id = b.tag_id GROUP BY 1")
def j6_tags_of_videos(lib):
    rows = lib.video_tags.join(lib.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").join(lib.rows("videos").select(F.col("id").alias("video_id")), "video_id", "left_semi")
    names = F.transform(F.sort_array(F.collect_list(F.struct("name", "tag_id"))), lambda x: x["name"])
    return rows.groupBy(F.col("video_id").alias("id")).agg(F.array_join(names, ", ").alias("tags"))


@_query("SELECT f.video_id, v.file_name, t.file_path AS picture, f.added_at FROM v_favorites f JOIN v_videos v ON v.id = f.video_id LEFT JOIN v_thumbnails t ON t.video_id = f.video_id WHERE f.user_id = 12 ORDER BY f.added_at DESC, f.video_id")
def j7_favorites(lib):
    rows = lib.favorites.filter("user_id = 12").join(lib.rows("videos", "file_name").select(F.col("id").alias("video_id"), "file_name"), "video_id").join(lib.thumbnails.select("video_id", F.col("file_path").alias("picture")), "video_id", "left")
    return rows.orderBy(F.desc("added_at"), "video_id").select("video_id", "file_name", "picture", "added_at")


@_query("SELECT p.video_id, p.position, v.file_name, t.file_path AS picture FROM v_playlist_videos p JOIN v_videos v ON v.id = p.video_id LEFT JOIN v_thumbnails t ON t.video_id = v.id WHERE p.playlist_id = 77 ORDER BY p.position, p.video_id")
def j8_playlist(lib):
    rows = lib.playlist_videos.filter("playlist_id = 77").join(lib.rows("videos", "file_name").select(F.col("id").alias("video_id"), "file_name"), "video_id").join(lib.thumbnails.select("video_id", F.col("file_path").alias("picture")), "video_id", "left")
    return rows.orderBy("position", "video_id").select("video_id", "position", "file_name", "picture")


@_query("SELECT playlist_id, p.video_id, t.file_path AS picture FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY position, video_id) AS k FROM v_playlist_videos) p LEFT JOIN v_thumbnails t ON t.video_id = p.video_id WHERE k = 1")
def j9_covers(lib):
    return E.covers(lib)


@_query("SELECT c.id, c.name, count(p.platform_id) AS accounts, coalesce(string_agg(p.username, ',' ORDER BY p.platform_id), '') AS usernames FROM v_creators c LEFT JOIN v_creator_platforms p ON p.creator_id = c.id GROUP BY 1, 2")
def j10_accounts(lib):
    by = lib.creator_platforms.groupBy(F.col("creator_id").alias("id")).agg(F.count(F.lit(1)).alias("accounts"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("platform_id", "username"))), lambda x: x["username"]), ",").alias("usernames"))
    return lib.rows("creators", "name").select("id", "name").join(by, "id", "left").select("id", "name", F.coalesce("accounts", F.lit(0)).alias("accounts"), F.coalesce("usernames", F.lit("")).alias("usernames"))


@_query("SELECT j.id, j.status, coalesce(v.title, v.file_name) AS title FROM v_jobs j LEFT JOIN v_videos v ON v.id = j.video_id WHERE j.status IN ('pending', 'processing')")
def j11_open_jobs(lib):
    title = lib.rows("videos", "title", "file_name").select(F.col("id").alias("video_id"), F.coalesce("title", "file_name").alias("title"))
    return lib.jobs.filter(F.col("status").isin("pending", "processing")).join(title, "video_id", "left").select("id", "status", "title")


@_query("WITH o AS (SELECT DISTINCT v.id, v.file_path, d.path, row_number() OVER (PARTITION BY v.id ORDER BY d.added_at DESC, d.id) AS k, d.id AS directory_id FROM v_videos v JOIN v_directories d ON starts_with(v.file_path, d.path || '/')) SELECT id, directory_id FROM o WHERE k = 1")
def j18_directory_by_prefix(lib):
    """The watched directory that a path lies in, most recently added first; the prefix of each depth is joined by equality."""
    parts = F.split("file_path", "/")
    prefixes = lib.rows("videos", "file_path").select("id", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path"))
    hits = prefixes.distinct().join(lib.rows("watched_directories", "path", "added_at").select("path", "added_at", F.col("id").alias("directory_id")), "path")
    return hits.groupBy("id").agg(F.max_by("directory_id", F.struct("added_at", -F.col("directory_id"))).alias("directory_id"))


@_query("SELECT playlist_id, video_id, position, before FROM (SELECT *, lag(position) OVER (PARTITION BY playlist_id ORDER BY position, video_id) AS before FROM v_playlist_videos) WHERE position - before > 1")
def q12_position_gaps(lib):
    return E.position_gaps(lib.playlist_videos)


_ROOT = "(SELECT min(parent_id) FROM v_tags WHERE parent_id IS NOT NULL)"


def _root(lib):
    return lib.tags.filter("parent_id is not null").agg(F.min("parent_id").alias("id")).filter("id is not null")


@_query(f"""WITH RECURSIVE d AS (SELECT id, name, 0 AS depth, name AS path, [id] AS seen FROM v_tags WHERE id = {_ROOT}
    UNION ALL SELECT t.id, t.name, d.depth + 1, d.path || ' > ' || t.name, list_append(d.seen, t.id) FROM v_tags t JOIN d ON t.parent_id = d.id WHERE NOT list_contains(d.seen, t.id)) SELECT id, name, depth, path FROM d""")
def r2_descendants(lib):
    return E.descendants(lib.tags, _root(lib))


_LEAF = "(SELECT max(id) FROM v_tags WHERE parent_id IS NOT NULL)"


def _leaf(lib):
    return lib.tags.filter("parent_id is not null").agg(F.max("id").alias("id")).filter("id is not null")


@_query(f"""WITH RECURSIVE a AS (SELECT id, parent_id, name, 0 AS steps, [id] AS seen FROM v_tags WHERE id = {_LEAF}
    UNION ALL SELECT t.id, t.parent_id, t.name, a.steps + 1, list_append(a.seen, t.id) FROM v_tags t JOIN a ON t.id = a.parent_id WHERE NOT list_contains(a.seen, t.id)) SELECT id, name, steps FROM a""")
def r1_ancestors(lib):
    return E.ancestors(lib.tags, _leaf(lib))


@_query(f"SELECT id, name FROM v_tags WHERE parent_id = {_ROOT} ORDER BY name, id")
def r6_children(lib):
    parent = _root(lib).withColumnRenamed("id", "parent_id")
    return lib.tags.join(F.broadcast(parent), "parent_id", "left_semi").orderBy("name", "id").select("id", "name")  # one row


@_query(f"""WITH RECURSIVE d AS (SELECT id FROM v_tags WHERE id = {_ROOT} UNION SELECT t.id FROM v_tags t JOIN d ON t.parent_id = d.id) SELECT id FROM v_tags WHERE id NOT IN (SELECT id FROM d)""")
def r5_valid_parents(lib):
    return E.valid_parents(lib.tags, _root(lib))


@_query(f"""WITH RECURSIVE d AS (SELECT id FROM v_tags WHERE id = {_ROOT} UNION SELECT t.id FROM v_tags t JOIN d ON t.parent_id = d.id) SELECT (SELECT count(*) FROM v_tags WHERE id NOT IN (SELECT id FROM d)) AS tags, (SELECT count(*) FROM v_video_tags WHERE tag_id NOT IN (SELECT id FROM d)) AS links""")
def r7_delete_subtree(lib):
    tags, links = E.delete_subtree(lib.tags, lib.video_tags, _root(lib))
    return tags.agg(F.count(F.lit(1)).alias("tags")).crossJoin(links.agg(F.count(F.lit(1)).alias("links")))


@_query("SELECT DISTINCT directory_id FROM v_videos")
def r8_distinct_directories(lib):
    return lib.rows("videos", "directory_id").select("directory_id").distinct()


@_query("""WITH RECURSIVE p AS (SELECT id, name FROM v_tags WHERE parent_id IS NULL ORDER BY name, id LIMIT 20 OFFSET 20),
d AS (SELECT id AS root_id, id, name, 0 AS depth, name AS path FROM p UNION ALL SELECT d.root_id, t.id, t.name, d.depth + 1, d.path || ' > ' || t.name FROM v_tags t JOIN d ON t.parent_id = d.id)
SELECT root_id, id, name, depth, path, (SELECT count(*) FROM v_tags c WHERE c.parent_id = d.id) AS children FROM d""")
def r4_tree(lib):
    return E.tree_page(lib.tags, 2, 20)


@_query("SELECT t.id, t.name, count(c.id) AS children FROM v_tags t LEFT JOIN v_tags c ON c.parent_id = t.id GROUP BY 1, 2")
def r4_children_counts(lib):
    return E.with_counts(lib.tags.select("id", "name"), (lib.tags.filter("parent_id is not null"), "parent_id", "children"))
