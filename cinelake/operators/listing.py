"""Pages, neighbours and short lists of filtered videos and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.functions.scalars import iso
from cinelake.operators.filters import SORTS, VideoFilter, apply, order
from cinelake.sources.library import Library


def page(lib: Library, f: VideoFilter, sort: str = "created_at", descending: bool = True, number: int = 1, size: int = 20, columns: tuple[str, ...] = ()) -> DataFrame:
    """One page of id, the sort column and ``columns``, as a top-k rather than a full sort."""
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("pages have 1 to 100 rows and count from 1")
    by = sort if sort in SORTS else "created_at"
    return apply(lib, f, by, *columns).orderBy(*order(sort, descending)).offset((number - 1) * size).limit(size)


def envelope(filtered: DataFrame, size: int = 20) -> DataFrame:
    """(total, pages) of the same relation that pages are cut from."""
    return filtered.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("pages"))


def presented(lib: Library, videos: DataFrame, user_id: int) -> DataFrame:
    """id, file_name, picture address, favourite flag of a user and ISO time, by joins instead of lookups per row."""
    picture = lib.thumbnails.select(F.col("video_id").alias("id"), F.concat(F.lit("/api/thumbnails/"), F.col("id"), F.lit("/image")).alias("thumbnail_url"))
    mine = lib.favorites.filter(F.col("user_id") == user_id).select(F.col("video_id").alias("id"), F.lit(True).alias("fav"))
    out = videos.join(picture, "id", "left").join(mine, "id", "left")
    return out.select("id", "file_name", "thumbnail_url", F.coalesce("fav", F.lit(False)).alias("is_favorite"), iso(F.col("created_at")).alias("created_iso"))


def neighbour(videos: DataFrame, current: int | DataFrame, sort: str, descending: bool, strict: bool = True) -> DataFrame:
    """The row after ``current`` in listing order, or the first one after the end, with how many remain.

    Returns id, has_wrapped, remaining and total; no row if ``current`` is not there or is alone. ``strict`` steps
    through ties by id; without it any other row of an equal value is a candidate. Nulls come as ``order`` has them.
    ``current`` is an id, or a one-row frame with a column id.
    """
    c = F.col(sort)
    rank = lambda x: F.when(x.isNull(), 0 if descending else 1).otherwise(1 if descending else 0)
    here = videos.join(F.broadcast(current), "id", "left_semi") if isinstance(current, DataFrame) else videos.filter(F.col("id") == current)
    here = here.select(F.col("id").alias("current"), c.alias("at"), rank(c).alias("at_rank")).limit(1)
    current = F.col("current")
    both = videos.select("id", c.alias("v"), rank(c).alias("r")).crossJoin(F.broadcast(here))  # one row
    equal = (F.col("r") == F.col("at_rank")) & F.col("v").eqNullSafe(F.col("at"))
    past = (F.col("r") > F.col("at_rank")) | ((F.col("r") == F.col("at_rank")) & ((F.col("v") < F.col("at")) if descending else (F.col("v") > F.col("at"))))
    tie = equal & ((F.col("id") < current) if descending else (F.col("id") > current)) if strict else equal & (F.col("id") != current)
    marked = both.withColumn("after", F.coalesce(past, F.lit(False)) | tie)
    counts = marked.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("after"), 1)).alias("remaining"))
    keys = [F.col("r"), F.col("v").desc() if descending else F.col("v").asc(), F.col("id").desc() if descending else F.col("id").asc()]
    first = marked.filter(F.col("id") != current).orderBy(F.col("after").desc(), *keys).limit(1).select("id", (~F.col("after")).alias("has_wrapped"))
    return first.crossJoin(F.broadcast(counts)).select("id", "has_wrapped", F.greatest(F.col("remaining") - 1, F.lit(0)).alias("remaining"), "total")


def neighbours_of_all(videos: DataFrame, bucket: Column, sort: str, chunk: Column) -> DataFrame:
    """(id, previous_id, next_id) of every row within its bucket, ascending by ``sort``, nulls last, then by id.

    ``chunk`` cuts a bucket along its order (a month of ``sort``, say; null exactly where ``sort`` is): rows are sorted chunk by
    chunk, so a very large bucket is not one task, and the ends of neighbouring chunks are joined up.
    """
    rows = videos.select("id", bucket.alias("bucket"), chunk.alias("chunk"), F.col(sort).alias("at"))
    inside = W.partitionBy("bucket", "chunk").orderBy(F.col("at").asc_nulls_last(), F.col("id"))
    marked = rows.withColumn("previous_id", F.lag("id").over(inside)).withColumn("next_id", F.lead("id").over(inside))
    ends = rows.groupBy("bucket", "chunk").agg(F.min_by("id", F.struct("at", "id")).alias("first"), F.max_by("id", F.struct("at", "id")).alias("last"))
    along = W.partitionBy("bucket").orderBy(F.col("chunk").asc_nulls_last())
    ends = ends.select(F.col("bucket").alias("b"), F.col("chunk").alias("c"), F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("after"))
    met = marked.join(ends, F.col("bucket").eqNullSafe(F.col("b")) & F.col("chunk").eqNullSafe(F.col("c")))
    return met.select("id", F.coalesce("previous_id", "before").alias("previous_id"), F.coalesce("next_id", "after").alias("next_id"))


def autocomplete(df: DataFrame, text: str, limit: int = 10, ignore_case: bool = True) -> DataFrame:
    """(id, name) of names with ``text`` in them, by name; nothing for a blank text."""
    text = text.strip()
    like = F.col("name").ilike(f"%{text}%") if ignore_case else F.col("name").like(f"%{text}%")
    return df.filter(like if text else F.lit(False)).select("id", "name").orderBy("name", "id").limit(limit)


def recent(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def random_row(df: DataFrame, seed: int) -> DataFrame:
    """One row by chance: the smallest keyed hash, a top-1 without a sort."""
    return df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1)
