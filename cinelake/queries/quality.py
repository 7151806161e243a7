"""Queries on references and hierarchies of the library tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.operators import hierarchy, integrity
from cinelake.sources.tables import table


def _references(spark: SparkSession, directory: str) -> list[integrity.Reference]:
    t = lambda name: table(spark, directory, name)
    return [
        integrity.Reference("video_face_detections", t("video_face_detections"), "id", "matched_creator_id", "creators", t("creators"), created="created_at"),
        integrity.Reference("creator_face_embeddings", t("creator_face_embeddings"), "id", "source_video_id", "videos", t("videos"), created="created_at"),
        integrity.Reference("videos", t("videos"), "id", "directory_id", "watched_directories", t("watched_directories"), created="created_at"),
    ]


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return integrity.orphans(_references(spark, directory)).select("table_name", "row_id")


def p5_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Orphan references by table and month."""
    return integrity.orphan_counts(_references(spark, directory))


def _tags(spark: SparkSession, directory: str, paths: bool) -> hierarchy.Hierarchy:
    return hierarchy.build(table(spark, directory, "tags"), updated="updated_at", paths=paths)


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return _tags(spark, directory, False).flat().select(F.col("id").alias("tag_id"), "root_id", "depth")


def p7_paths(spark: SparkSession, directory: str) -> DataFrame:
    """Root, depth, path of names and number of tags below, for every tag."""
    return _tags(spark, directory, True).flat().withColumnRenamed("id", "tag_id")


def p7_below(spark: SparkSession, directory: str) -> DataFrame:
    """Every pair of a tag and a tag below it."""
    return _tags(spark, directory, False).below().withColumnRenamed("id", "tag_id")


QUERIES = {f.__name__: f for f in (p5_found, p5_counts, p7_found, p7_paths, p7_below)}

_ORPHANS = """
WITH o AS (
  SELECT DISTINCT 'video_face_detections' AS table_name, id AS row_id, strftime(created_at, '%Y-%m') AS month, matched_creator_id NOT IN (SELECT id FROM creators) AS orphan
    FROM video_face_detections WHERE matched_creator_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'creator_face_embeddings', id, strftime(created_at, '%Y-%m'), source_video_id NOT IN (SELECT id FROM videos)
    FROM creator_face_embeddings WHERE source_video_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'videos', id, strftime(created_at, '%Y-%m'), directory_id NOT IN (SELECT id FROM watched_directories)
    FROM videos WHERE directory_id IS NOT NULL)
"""

_TREE = """
WITH RECURSIVE v AS (SELECT id, parent_id, trim(name) AS name FROM
    (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, parent_id DESC NULLS LAST, trim(name) DESC) AS k FROM tags) WHERE k = 1),
p AS (SELECT id, CASE WHEN parent_id IN (SELECT id FROM v) THEN parent_id END AS parent, name FROM v),
w AS (SELECT id, parent AS above FROM p WHERE parent IS NOT NULL UNION SELECT w.id, p.parent FROM w JOIN p ON p.id = w.above WHERE p.parent IS NOT NULL),
ring AS (SELECT id FROM w WHERE id = above),
lost AS (SELECT w.id, min(w.above) AS root FROM w JOIN ring ON ring.id = w.above GROUP BY 1),
deep AS (SELECT p.id, count(w.above) AS depth FROM p LEFT JOIN w ON w.id = p.id WHERE p.id NOT IN (SELECT id FROM lost) GROUP BY 1),
top AS (SELECT d.id, d.depth, coalesce(max(CASE WHEN r.parent IS NULL THEN r.id END), d.id) AS root
        FROM deep d LEFT JOIN w ON w.id = d.id LEFT JOIN p r ON r.id = w.above GROUP BY 1, 2)
"""

SQL = {
    "p5_found": _ORPHANS + "SELECT table_name, row_id FROM o WHERE orphan",
    "p5_counts": _ORPHANS + "SELECT table_name, month, count(*) FILTER (orphan) AS orphans, count(*) AS \"references\" FROM o GROUP BY ALL",
    "p7_found": _TREE + "SELECT id AS tag_id, root AS root_id, depth FROM top UNION ALL SELECT id, root, -1 FROM lost",
    "p7_paths": _TREE
    + """, above AS (SELECT id, above FROM w WHERE id NOT IN (SELECT id FROM lost) UNION ALL SELECT id, id FROM top),
named AS (SELECT a.id, string_agg(p.name, ' > ' ORDER BY t.depth) AS path FROM above a JOIN p ON p.id = a.above JOIN top t ON t.id = a.above GROUP BY 1),
under AS (SELECT above AS id, count(*) - 1 AS n FROM above GROUP BY 1)
SELECT t.id AS tag_id, t.root AS root_id, t.depth, named.path, under.n AS descendants FROM top t JOIN named USING (id) JOIN under USING (id)
UNION ALL SELECT id, root, -1, NULL, -1 FROM lost""",
    "p7_below": _TREE + "SELECT above AS tag_id, id AS descendant_id FROM w WHERE id NOT IN (SELECT id FROM lost)",
}
