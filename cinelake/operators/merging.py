"""Changes to tables as pure functions: the new table, or what changed, from the old one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_ignore(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with those rows of ``new`` whose keys it lacks; repeated keys of ``new`` come in once."""
    fresh = new.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(fresh.select(table.columns))


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(Column.__or__, (F.col(k).isNull() for k in keys))


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``table`` with the columns of ``new`` set where keys meet, and the other rows of ``new`` added.

    Of several rows of ``new`` with one key the last holds: the one with the greatest ``order`` columns (which are not
    written), ties by the greatest values, so the result does not hang on the layout. Null keys never meet and are all added.
    """
    values = [c for c in new.columns if c not in keys and c not in order]
    whole = F.col("_r")
    last = new.filter(~_any_null(keys)).groupBy(*keys).agg(F.max(F.struct(*order, *values, F.lit(True).alias("_some"))).alias("_r"))
    new = last.select(*keys, *(whole[c].alias(c) for c in values)).unionByName(new.filter(_any_null(keys)).select(*keys, *values))
    marked = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in values), F.lit(True).alias("_new"))
    both = table.join(marked, list(keys), "full")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) if c in values else F.col(c)
    return both.select(*(pick(c).alias(c) for c in table.columns))


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, where: Column) -> DataFrame:
    """Rows for which ``where`` is not true."""
    return table.filter(~F.coalesce(where, F.lit(False)))


def add_links(links: DataFrame, rows: DataFrame, row_key: str, key: str, values: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(links with every row linked to every one of ``values``, the links that were added); values are few and explicit."""
    wanted = rows.select(F.col(row_key)).distinct().withColumn(key, F.explode(F.array(*(F.lit(v).cast("long") for v in values))))
    added = wanted.join(links, [row_key, key], "left_anti")
    return links.unionByName(added.select(links.columns)), added


def remove_links(links: DataFrame, rows: DataFrame, row_key: str, key: str, values: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(links without the given ones, the links that were removed)."""
    hit = links.filter(F.col(key).isin(*values)).join(rows.select(row_key), row_key, "left_semi")
    return links.join(hit, [row_key, key], "left_anti"), hit


def reconcile(listed: DataFrame, known: DataFrame, key: str = "file_path", size: str = "file_size_bytes") -> DataFrame:
    """(key, state): new, unchanged, changed (another size) or missing, from one full outer join."""
    a = listed.select(key, F.col(size).alias("_now"), F.lit(True).alias("_listed"))
    b = known.select(key, F.col(size).alias("_was"), F.lit(True).alias("_known"))
    state = F.when(F.col("_known").isNull(), "new").when(F.col("_listed").isNull(), "missing").when(F.col("_now").eqNullSafe(F.col("_was")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def child_changes(stored: DataFrame, wanted: DataFrame, parent: str, keys: Sequence[str], value: str, replace: bool) -> DataFrame:
    """(parent, added, updated, removed) counts of the children of every parent in ``wanted``; removed only if ``replace``."""
    on = [parent, *keys]
    a = wanted.select(*on, F.col(value).alias("_new"), F.lit(True).alias("_w"))
    b = stored.join(wanted.select(parent).distinct(), parent, "left_semi").select(*on, F.col(value).alias("_old"), F.lit(True).alias("_s"))
    both = a.join(b, on, "full")
    n = lambda c: F.count(F.when(c, 1))
    gone = n(F.col("_w").isNull()) if replace else F.lit(0).cast("long")
    return both.groupBy(parent).agg(n(F.col("_s").isNull()).alias("added"), n(F.col("_w") & F.col("_s") & ~F.col("_new").eqNullSafe(F.col("_old"))).alias("updated"), gone.alias("removed"))


def append_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """Playlist items with ``new`` (playlist_id, video_id, n) at the end, in order of n; those already there are left out."""
    from pyspark.sql import Window as W

    last = items.groupBy("playlist_id").agg(F.max("position").alias("last"))
    fresh = new.join(items.select("playlist_id", "video_id"), ["playlist_id", "video_id"], "left_anti").join(last, "playlist_id", "left")
    at = F.coalesce("last", F.lit(-1)) + F.row_number().over(W.partitionBy("playlist_id").orderBy("n", "video_id"))
    return items.unionByName(fresh.select("playlist_id", "video_id", at.cast("int").alias("position")).select(items.columns))


def reorder(items: DataFrame, positions: DataFrame) -> DataFrame:
    """Playlist items with the positions given for (playlist_id, video_id); positions of items that are not there change nothing."""
    new = positions.groupBy("playlist_id", "video_id").agg(F.max("position").alias("_to"))
    return items.join(new, ["playlist_id", "video_id"], "left").withColumn("position", F.coalesce("_to", "position")).select(items.columns)


def insert_new(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(``table`` with the rows of ``new`` whose keys it lacks, the rows of ``new`` in conflict with a key that is there)."""
    known = table.select(*keys).distinct()
    return insert_ignore(table, new, keys), new.join(known, list(keys), "left_semi")


def delete_ids(table: DataFrame, key: str, ids: Sequence[int]) -> tuple[DataFrame, int]:
    """(``table`` without the given ids, how many ids were asked for, there or not)."""
    return delete(table, F.col(key).isin(*ids)), len(set(ids))


@dataclass(frozen=True)
class BulkActions:
    """Ids to link with and to unlink from every chosen video, by kind of link."""

    add: dict[str, Sequence[int]] = field(default_factory=dict)
    remove: dict[str, Sequence[int]] = field(default_factory=dict)


def bulk_counts(videos: DataFrame, links: dict[str, tuple[DataFrame, str]], actions: BulkActions) -> DataFrame:
    """One row with KIND_added and KIND_removed: the links that really came and went, for all kinds of ``links``."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = []
    for kind, (table, key) in links.items():
        gone = remove_links(table, videos, "video_id", key, actions.remove[kind])[1] if actions.remove.get(kind) else table.limit(0)
        parts += [count(add_links(table, videos, "video_id", key, actions.add[kind])[1] if actions.add.get(kind) else table.limit(0), f"{kind}_added"), count(gone, f"{kind}_removed")]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each


def bulk_attempts(videos: DataFrame, actions: BulkActions) -> DataFrame:
    """The same columns counted by attempts: one for every chosen video and id asked for."""
    n = videos.agg(F.count_distinct("video_id").alias("n"))
    kinds = list(dict.fromkeys([*actions.add, *actions.remove]))
    return n.select(*((F.col("n") * len(set(ids.get(k, ())))).alias(f"{k}_{what}") for k in kinds for what, ids in (("added", actions.add), ("removed", actions.remove))))


def resolve(items: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(``key``, entity_id, action) of imported items with an id or a name: update, create, or an unknown id.

    An id counts before a name; of several entities of one name the one with the smallest id is meant. Items with neither
    are new rows.
    """
    by_id = entities.select("id", F.col("id").alias("_by_id")).distinct()
    by_name = entities.filter("name is not null").groupBy("name").agg(F.min("id").alias("_by_name"))
    found = items.select(key, "id", F.when(F.col("id").isNull(), F.col("name")).alias("name")).join(by_id, "id", "left").join(by_name, "name", "left")
    given = F.col("id").isNotNull()
    action = F.when(given & F.col("_by_id").isNull(), "unknown id").when(given | F.col("_by_name").isNotNull(), "update").otherwise("create")
    return found.select(key, F.when(given, F.col("_by_id")).otherwise(F.col("_by_name")).alias("entity_id"), action.alias("action"))


def match_children(wanted: DataFrame, stored: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``wanted`` with its action: same (key and value are there), update (the key is there) or create."""
    old = stored.groupBy(*keys).agg(F.collect_set(value).alias("_old"))
    action = F.when(F.array_contains("_old", F.col(value)), "same").when(F.col("_old").isNotNull(), "update").otherwise("create")
    return wanted.join(old, list(keys), "left").withColumn("action", action).drop("_old")


def names_of(links: DataFrame, entities: DataFrame, row: str, key: str, label: str) -> DataFrame:
    """(``row``, ``label``): the names of what each row is linked with, by name and id; lists are as long as a row has links."""
    named = links.join(entities.select(F.col("id").cast("long").alias(key), "name"), key)
    names = F.transform(F.sort_array(F.collect_list(F.struct("name", key))), lambda x: x["name"])
    return named.groupBy(row).agg(F.array_join(names, ", ").alias(label))


def retain(snapshots: DataFrame, at: str, now: Column, days: int, hourly_days: int | None = None) -> DataFrame:
    """Snapshots of the last ``days``; older than ``hourly_days`` only those of midnight."""
    kept = F.col(at) >= now - F.expr(f"INTERVAL '{days}' DAY")
    if hourly_days is not None:
        kept &= (F.col(at) >= now - F.expr(f"INTERVAL '{hourly_days}' DAY")) | (F.hour(at) == 0)
    return snapshots.filter(kept)
