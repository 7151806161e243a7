"""Creators, studios, tags and playlists: linked counts, completeness, traversals and tag trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.operators import hierarchy
from cinelake.plans.scratch import checkpoint
from cinelake.sources.library import Library

SEPARATOR = " > "


def counts(links: DataFrame, key: str, label: str) -> DataFrame:
    return links.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias(label))


def with_counts(entities: DataFrame, *parts: tuple[DataFrame, str, str]) -> DataFrame:
    """Entities with the number of rows of each link table; every link table is aggregated before it is joined."""
    out = entities
    for links, key, label in parts:
        out = out.join(counts(links, key, label), "id", "left").withColumn(label, F.coalesce(label, F.lit(0)))
    return out


def creators_overview(lib: Library) -> DataFrame:
    """Creators with linked counts, missing parts and whether they are complete (picture, an account, a video)."""
    rows = with_counts(lib.rows("creators", "name", "profile_picture_path").select("id", "name", "profile_picture_path"), (lib.video_creators, "creator_id", "video_count"), (lib.creator_platforms, "creator_id", "platform_count"), (lib.social_links, "creator_id", "social_count"))
    return _complete(rows, {"picture": F.col("profile_picture_path").isNull(), "account": F.col("platform_count") + F.col("social_count") == 0, "videos": F.col("video_count") == 0})


def studios_overview(lib: Library) -> DataFrame:
    """Studios with linked counts; complete with a picture and any link."""
    rows = with_counts(lib.rows("studios", "name", "profile_picture_path").select(F.col("id").cast("long").alias("id"), "name", "profile_picture_path"), (lib.video_studios, "studio_id", "video_count"), (lib.creator_studios, "studio_id", "creator_count"))
    return _complete(rows, {"picture": F.col("profile_picture_path").isNull(), "links": F.col("video_count") + F.col("creator_count") == 0})


def _complete(rows: DataFrame, lacks: dict[str, Column]) -> DataFrame:
    missing = F.array_compact(F.array(*(F.when(c, name) for name, c in lacks.items())))
    return rows.withColumn("missing", F.array_join(missing, ",")).withColumn("is_complete", F.col("missing") == "").drop("profile_picture_path")


def search(entities: DataFrame, accounts: DataFrame, text: str) -> DataFrame:
    """Entities whose name or any account name has ``text``, once each."""
    by_account = accounts.filter(F.col("username").ilike(f"%{text}%")).select(F.col("creator_id").alias("id"))
    by_name = entities.filter(F.col("name").ilike(f"%{text}%")).select("id")
    return by_name.unionByName(by_account.join(entities.select("id"), "id", "left_semi")).distinct()


def linked_videos(lib: Library, links: DataFrame, key: str, value: int) -> DataFrame:
    ids = links.filter(F.col(key) == value).select(F.col("video_id").alias("id"))
    return lib.rows("videos").join(ids, "id", "left_semi")


def covers(lib: Library) -> DataFrame:
    """(playlist_id, video_id, picture) of the first item of every playlist that has one; the picture may be null.

    First by position and then by id; an aggregate, so a long playlist is never sorted.
    """
    first = lib.playlist_videos.groupBy("playlist_id").agg(F.min_by("video_id", F.struct("position", "video_id")).alias("video_id"))
    return first.join(lib.thumbnails.select("video_id", F.col("file_path").alias("picture")), "video_id", "left").select("playlist_id", "video_id", "picture")


def position_gaps(items: DataFrame) -> DataFrame:
    """Playlist items whose position is more than one past the item before."""
    w = W.partitionBy("playlist_id").orderBy("position", "video_id")
    return items.withColumn("before", F.lag("position").over(w)).filter("position - before > 1").select("playlist_id", "video_id", "position", "before")


def _from(tags: DataFrame, tag: int | DataFrame) -> DataFrame:
    """``tags`` with start: whether a row is the tag asked for, by its id or by a one-row frame with a column id."""
    if isinstance(tag, DataFrame):
        return tags.join(F.broadcast(tag.select("id", F.lit(True).alias("start"))), "id", "left").withColumn("start", F.coalesce("start", F.lit(False)))  # one row
    return tags.withColumn("start", F.col("id") == int(tag))


def descendants(tags: DataFrame, tag: int | DataFrame, paths: bool = True) -> DataFrame:
    """(id, name, depth, path) of a tag and all below it, however deep; a loop ends when it closes.

    The tag is made a root, so a loop it lies on is cut above it. ``paths`` False leaves the paths null. An unknown tag
    has no rows.
    """
    marked = checkpoint(_from(tags.select("id", "parent_id", "name"), tag))
    above = F.when(~F.col("start"), F.col("parent_id")).alias("parent_id")
    flat = hierarchy.depths(marked.select("id", above, "name"), paths)
    below = flat.join(F.broadcast(marked.filter("start").select(F.col("id").alias("root_id"))), "root_id")  # one row
    below = below.select("id", F.col("depth").cast("int").alias("depth"), _path() if paths else F.lit(None).cast("string").alias("path"))
    return below.join(tags.select("id", "name"), "id").select("id", "name", "depth", "path")


def _path() -> Column:
    return F.array_join("path", SEPARATOR, "").alias("path")


def ancestors(tags: DataFrame, tag: int | DataFrame) -> DataFrame:
    """(id, name, steps) of the tags above one, itself at 0, in a number of rounds logarithmic in their number; a loop ends when it closes.

    After k rounds all tags less than 2**k steps above are known and every tag has its ancestor 2**k above.
    """
    rows = checkpoint(_from(tags.select("id", "parent_id", "name"), tag))
    found = checkpoint(rows.filter("start").select("id", F.lit(0).alias("steps")))
    far, known, hop = rows.filter("parent_id is not null").select("id", F.col("parent_id").alias("up")), 0, 1
    while (many := found.count()) > known:
        known = many
        more = found.join(far, "id").select(F.col("up").alias("id"), (F.col("steps") + hop).alias("steps"))
        found = checkpoint(found.unionByName(more).groupBy("id").agg(F.min("steps").alias("steps")))
        far = checkpoint(far.join(far.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")))
        hop *= 2
    return found.join(rows.select("id", "name"), "id").select("id", "name", "steps")


def valid_parents(tags: DataFrame, tag: int | DataFrame) -> DataFrame:
    """Tags that may become the parent of ``tag``: all but itself and those below it."""
    return tags.join(descendants(tags, tag, paths=False).select("id"), "id", "left_anti").select("id")


def delete_subtree(tags: DataFrame, links: DataFrame, tag: int | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags and their links without ``tag`` and everything below it."""
    gone = descendants(tags, tag, paths=False).select("id")
    return tags.join(gone, "id", "left_anti"), links.join(gone.withColumnRenamed("id", "tag_id"), "tag_id", "left_anti")


def tree_page(tags: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """(root_id, id, name, depth, path, children): one page of root tags by name and id, each with its whole tree.

    A tree comes as rows in reading order of ``path`` and with the number of children, from which nesting follows at any
    depth. Tags in loops have no root and are on no page.
    """
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("pages have 1 to 100 rows and count from 1")
    roots = tags.filter("parent_id is null").orderBy("name", "id").offset((number - 1) * size).limit(size).select(F.col("id").alias("root_id"))
    flat = hierarchy.depths(tags.select("id", "parent_id", "name")).select("root_id", "id", "depth", _path())
    shown = flat.join(F.broadcast(roots), "root_id").join(tags.select("id", "name"), "id")  # a page of at most 100
    return with_counts(shown.select("root_id", "id", "name", F.col("depth").cast("int").alias("depth"), "path"), (tags.filter("parent_id is not null"), "parent_id", "children"))
