"""The media library as DataFrames, from the tables of a directory, and the same views in SQL.

Repeated rows count once. Views that the directory has no table for (ratings, playlists, watch statistics, jobs,
...) are derived from its star schema by exact integer rules, written once in each language.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.operators import hierarchy
from cinelake.sources.tables import table

#: The moment "now" means in every query.
AS_OF = "2026-01-01 00:00:00"
#: Tables with wide rows.
WIDE = ("videos", "creators", "studios", "watched_directories")


def as_of(spark_type: str = "timestamp_ntz"):
    return F.lit(AS_OF).cast(spark_type)


def _video(key: str):
    """A video id for a key of the star schema."""
    return F.floor(F.col(key) * 2 / 5).cast("long") + 1


class Library:
    """Lazy DataFrames; nothing is read before a query needs it."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)

    def rows(self, name: str, *columns: str) -> DataFrame:
        """id and ``columns`` of a table, repeated rows once; only these columns are read and shuffled.

        An id is never in two rows that differ, so rows are told apart by any columns that include it. All columns are
        grouping keys, hence filters on the result reach the scan.
        """
        return self.raw(name).select("id", *columns).distinct()

    def keys(self, name: str) -> DataFrame:
        """The rows of a view, of the wide tables only their ids."""
        return self.rows(name) if name in WIDE else getattr(self, name)

    @cached_property
    def videos(self) -> DataFrame:
        """Whole rows, for exports; queries ask for their columns by ``rows``."""
        return self.raw("videos").distinct()

    @cached_property
    def tags(self) -> DataFrame:
        """The valid row of every tag; the parent is null where no such tag exists."""
        rows = hierarchy.valid(self.raw("tags"), "id", "parent_id", "name", "updated_at")
        known = rows.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
        return rows.join(known, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("parent_id"), "name")

    @cached_property
    def video_tags(self) -> DataFrame:
        return self.raw("video_tags").select("video_id", F.col("tag_id").cast("long").alias("tag_id")).distinct()

    @cached_property
    def video_creators(self) -> DataFrame:
        return self.raw("video_creators").distinct()

    @cached_property
    def video_studios(self) -> DataFrame:
        rows = self.raw("lineitem").filter("l_linenumber = 3")
        return rows.select(_video("l_partkey").alias("video_id"), (F.floor(F.col("l_suppkey") * 4 / 5).cast("long") + 1).alias("studio_id")).distinct()

    @cached_property
    def creator_studios(self) -> DataFrame:
        return self.raw("supplier").select((F.col("s_suppkey") * 2 + 1).alias("creator_id"), (F.floor(F.col("s_suppkey") * 4 / 5).cast("long") + 1).alias("studio_id"))

    @cached_property
    def ratings(self) -> DataFrame:
        rows = self.raw("lineitem").filter("l_returnflag = 'R' and l_partkey % 6 <> 0")
        return rows.select(_video("l_partkey").alias("video_id"), ((F.col("l_quantity").cast("int") - 1) % 5 + 1).alias("rating"), F.col("l_shipdate").alias("rated_at"))

    @cached_property
    def favorites(self) -> DataFrame:
        urgent = self.raw("orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_orderdate")
        rows = urgent.join(self.raw("lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        return rows.groupBy(F.col("o_custkey").alias("user_id"), _video("l_partkey").alias("video_id")).agg(F.max("o_orderdate").alias("added_at"))

    @cached_property
    def playlists(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"))

    @cached_property
    def playlist_videos(self) -> DataFrame:
        rows = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("playlist_id"), _video("l_partkey").alias("video_id"))
        return rows.agg(F.min("l_linenumber").alias("position"))

    @cached_property
    def video_stats(self) -> DataFrame:
        rows = self.raw("events").filter("event_type in ('view', 'click')")
        plays = F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).cast("long")
        return rows.groupBy("user_id", (F.col("event_id") % 800 + 1).alias("video_id")).agg(plays.alias("play_count"), F.sum("value").alias("total_watch_seconds"), F.max("ts").alias("last_played_at"))

    @cached_property
    def watch_events(self) -> DataFrame:
        rows = self.raw("events")
        return rows.select("event_id", "user_id", (F.col("event_id") % 2).alias("video_id"), (F.col("value") / 2).alias("watched_seconds"), "ts")

    @cached_property
    def thumbnails(self) -> DataFrame:
        return self.rows("videos").filter("id % 7 <> 0").select("id", F.col("id").alias("video_id"), F.concat(F.lit("/thumbnails/"), F.col("id"), F.lit(".jpg")).alias("file_path"))

    @cached_property
    def storyboards(self) -> DataFrame:
        return self.rows("videos").filter("id % 3 = 0").select("id", F.col("id").alias("video_id"))

    @cached_property
    def jobs(self) -> DataFrame:
        status = F.when(F.col("o_orderkey") % 17 == 0, "failed").when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "processing").otherwise("completed")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 800 + 1).alias("video_id"), status.alias("status"), F.col("o_orderpriority").alias("batch_id"),
            F.col("o_orderdate").alias("created_at"), F.floor(F.col("o_totalprice")).cast("long").alias("output_size_bytes"),
        )

    @cached_property
    def creator_platforms(self) -> DataFrame:
        return self.raw("supplier").select((F.col("s_suppkey") * 2 + 1).alias("creator_id"), (F.col("s_suppkey") % 4).alias("platform_id"), F.lower("s_name").alias("username"))

    @cached_property
    def social_links(self) -> DataFrame:
        return self.raw("supplier").filter("s_suppkey % 3 = 0").select((F.col("s_suppkey") * 2 + 1).alias("creator_id"), F.concat(F.lit("https://social.example/"), F.col("s_suppkey")).alias("url"))

    @cached_property
    def bookmarks(self) -> DataFrame:
        rows = self.raw("events").filter("event_type = 'click'")
        return rows.select(F.col("event_id").alias("id"), (F.col("event_id") % 800 + 1).alias("video_id"), "user_id", F.col("value").alias("timestamp_seconds"))

    @cached_property
    def sessions(self) -> DataFrame:
        return self.raw("events").select(F.col("event_id").alias("id"), "user_id", (F.col("ts") + F.expr("INTERVAL '30' DAY")).alias("expires_at"))

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))

    @property
    def links(self) -> dict[str, tuple[DataFrame, str]]:
        """The link tables of videos and the key of the other side."""
        return {"tags": (self.video_tags, "tag_id"), "creators": (self.video_creators, "creator_id"), "studios": (self.video_studios, "studio_id")}

    @cached_property
    def scan_logs(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("id"), (k % 50 + 1).cast("int").alias("directory_id"), (k % 151).cast("int").alias("files_found"), (k % 13).cast("int").alias("files_added"), (k % 5).cast("int").alias("files_removed"),
            F.when(k % 10 == 0, F.concat(F.lit('["unreadable '), k, F.lit('"]'))).otherwise("[]").alias("errors"), F.col("o_orderdate").alias("started_at"),
            F.when(k % 7 != 0, F.col("o_orderdate") + F.make_dt_interval(secs=(k % 600).cast("decimal(18,6)"))).alias("completed_at"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """Per day: counters, and a breakdown as JSON text."""
        by = self.raw("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        part = F.sort_array(F.collect_list(F.struct(F.col("event_type").alias("resolution"), F.col("n").alias("count"))))
        return by.groupBy("day").agg(F.sum("n").alias("total_videos"), (F.sum("n") * 1_000_000).alias("total_size_bytes"), F.to_json(part).alias("breakdown"))


#: The same views for SQL; each may use those before it.
VIEWS = {
    "v_videos": "SELECT DISTINCT * FROM videos",
    "v_creators": "SELECT DISTINCT * FROM creators",
    "v_studios": "SELECT DISTINCT * FROM studios",
    "v_tags0": "SELECT id, parent_id, trim(name) AS name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, parent_id DESC NULLS LAST, trim(name) DESC) AS k FROM tags) WHERE k = 1",
    "v_tags": "SELECT CAST(id AS BIGINT) AS id, CAST(CASE WHEN parent_id IN (SELECT id FROM v_tags0) THEN parent_id END AS BIGINT) AS parent_id, name FROM v_tags0",
    "v_video_tags": "SELECT DISTINCT video_id, CAST(tag_id AS BIGINT) AS tag_id FROM video_tags",
    "v_video_creators": "SELECT DISTINCT * FROM video_creators",
    "v_directories": "SELECT DISTINCT * FROM watched_directories",
    "v_video_studios": "SELECT DISTINCT l_partkey * 2 // 5 + 1 AS video_id, l_suppkey * 4 // 5 + 1 AS studio_id FROM lineitem WHERE l_linenumber = 3",
    "v_creator_studios": "SELECT s_suppkey * 2 + 1 AS creator_id, s_suppkey * 4 // 5 + 1 AS studio_id FROM supplier",
    "v_ratings": "SELECT l_partkey * 2 // 5 + 1 AS video_id, (CAST(l_quantity AS INTEGER) - 1) % 5 + 1 AS rating, l_shipdate AS rated_at FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 6 <> 0",
    "v_favorites": "SELECT o_custkey AS user_id, l_partkey * 2 // 5 + 1 AS video_id, max(o_orderdate) AS added_at FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2",
    "v_playlists": "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at FROM orders",
    "v_playlist_videos": "SELECT l_orderkey AS playlist_id, l_partkey * 2 // 5 + 1 AS video_id, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2",
    "v_video_stats": "SELECT user_id, event_id % 800 + 1 AS video_id, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS play_count, sum(value) AS total_watch_seconds, max(ts) AS last_played_at FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2",
    "v_watch_events": "SELECT event_id, user_id, event_id % 2 AS video_id, value / 2 AS watched_seconds, ts FROM events",
    "v_thumbnails": "SELECT id, id AS video_id, '/thumbnails/' || id || '.jpg' AS file_path FROM v_videos WHERE id % 7 <> 0",
    "v_storyboards": "SELECT id, id AS video_id FROM v_videos WHERE id % 3 = 0",
    "v_jobs": "SELECT o_orderkey AS id, o_orderkey % 800 + 1 AS video_id, CASE WHEN o_orderkey % 17 = 0 THEN 'failed' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'completed' END AS status, o_orderpriority AS batch_id, o_orderdate AS created_at, CAST(floor(o_totalprice) AS BIGINT) AS output_size_bytes FROM orders",
    "v_creator_platforms": "SELECT s_suppkey * 2 + 1 AS creator_id, s_suppkey % 4 AS platform_id, lower(s_name) AS username FROM supplier",
    "v_social_links": "SELECT s_suppkey * 2 + 1 AS creator_id, 'https://social.example/' || s_suppkey AS url FROM supplier WHERE s_suppkey % 3 = 0",
    "v_bookmarks": "SELECT event_id AS id, event_id % 800 + 1 AS video_id, user_id, value AS timestamp_seconds FROM events WHERE event_type = 'click'",
    "v_scan_logs": "SELECT o_orderkey AS id, CAST(o_orderkey % 50 + 1 AS INTEGER) AS directory_id, CAST(o_orderkey % 151 AS INTEGER) AS files_found, CAST(o_orderkey % 13 AS INTEGER) AS files_added, CAST(o_orderkey % 5 AS INTEGER) AS files_removed, CASE WHEN o_orderkey % 10 = 0 THEN '[\"unreadable ' || o_orderkey || '\"]' ELSE '[]' END AS errors, o_orderdate AS started_at, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + to_seconds(o_orderkey % 600) END AS completed_at FROM orders",
    "v_snapshots0": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "v_snapshots": "SELECT day, CAST(sum(n) AS BIGINT) AS total_videos, CAST(sum(n) * 1000000 AS BIGINT) AS total_size_bytes FROM v_snapshots0 GROUP BY 1",
}


def sql(body: str, recursive: bool = False) -> str:
    """``body`` with the views it names, and those they need, before it; a WITH of its own joins them."""
    names = list(VIEWS)
    used: set[str] = set()

    def need(text: str) -> None:
        import re

        for n in names:
            if n not in used and re.search(rf"\b{n}\b", text):
                used.add(n)
                need(VIEWS[n])

    need(body)
    parts = [f"{n} AS ({VIEWS[n]})" for n in names if n in used]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        recursive, body = True, body[15:]
        head = ", ".join(parts)
        return f"WITH RECURSIVE {head}{', ' if parts else ''}{body}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}{', ' if parts else ''}{body[5:]}"
    return (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} " if parts else "") + body
