"""Faceted filters on videos: column predicates, and joins that keep or drop whole videos.

Every filter on linked records is a semi or anti join on pre-aggregated keys, so no filter multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.sources.library import Library

SORTS = ("created_at", "file_name", "duration_seconds", "file_size_bytes", "indexed_at", "width", "height", "bitrate", "fps")


@dataclass(frozen=True)
class VideoFilter:
    """What a listing asks for; None asks for nothing. Ranges are inclusive and leave nulls out."""

    available: bool | None = None
    include_hidden: bool = False
    directory_ids: Sequence[int] | None = None
    search: str | None = None
    codec: str | None = None
    audio_codec: str | None = None
    min_width: int | None = None
    max_width: int | None = None
    min_height: int | None = None
    max_height: int | None = None
    min_file_size_bytes: int | None = None
    max_file_size_bytes: int | None = None
    min_duration_seconds: float | None = None
    max_duration_seconds: float | None = None
    min_bitrate: int | None = None
    max_bitrate: int | None = None
    min_fps: float | None = None
    max_fps: float | None = None
    has_tags: bool | None = None
    has_creator: bool | None = None
    has_studio: bool | None = None
    has_rating: bool | None = None
    has_thumbnail: bool | None = None
    min_rating: float | None = None
    max_rating: float | None = None
    user_id: int | None = None
    favorite: bool | None = None
    tag_ids: Sequence[int] = ()
    creator_ids: Sequence[int] = ()
    studio_ids: Sequence[int] = ()
    match_all: bool = False
    dedupe: bool = True

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name.startswith("min_"):
                low, high = getattr(self, f.name), getattr(self, "max_" + f.name[4:])
                if low is not None and high is not None and low > high:
                    raise ValueError(f"{f.name} is above its maximum")
        if self.favorite is not None and self.user_id is None:
            raise ValueError("favorite needs a user_id")


def conditions(f: VideoFilter) -> list[Column]:
    """Predicates on a video's own columns; they reach the scan."""
    out: list[Column] = []
    if f.available is not None:
        out.append(F.col("is_available") == f.available)
    elif not f.include_hidden:
        out.append(F.col("is_available"))
    if f.directory_ids is not None:
        out.append(F.col("directory_id").isin(*f.directory_ids))
    if f.search:
        like = f"%{f.search}%"
        out.append(F.col("title").ilike(like) | F.col("description").ilike(like) | F.col("file_name").ilike(like))
    for name in ("codec", "audio_codec"):
        if getattr(f, name) is not None:
            out.append(F.lower(name) == getattr(f, name).lower())
    for name in ("width", "height", "file_size_bytes", "duration_seconds", "bitrate", "fps"):
        if (low := getattr(f, f"min_{name}")) is not None:
            out.append(F.col(name) >= low)
        if (high := getattr(f, f"max_{name}")) is not None:
            out.append(F.col(name) <= high)
    return out


def divide(links: DataFrame, key: str, ids: Sequence[int]) -> DataFrame:
    """Videos linked with every one of ``ids`` (relational division)."""
    wanted = set(ids)
    return links.filter(F.col(key).isin(*wanted)).groupBy("video_id").agg(F.count_distinct(key).alias("n")).filter(F.col("n") == len(wanted)).select("video_id")


def apply(lib: Library, f: VideoFilter, *columns: str) -> DataFrame:
    """id and ``columns`` of the videos that pass ``f``; one row each unless ``dedupe`` is off, where an any-of facet repeats a video per link.

    Conditions on a video's own columns come before repeated rows are dropped, so they reach the scan, and no other column is read.
    """
    out = lib.raw("videos")
    for c in conditions(f):
        out = out.filter(c)
    kept = out.select("id", *(c for c in dict.fromkeys(columns) if c != "id")).distinct().withColumn("video_id", F.col("id"))

    def exists(df: DataFrame, links: DataFrame, yes: bool) -> DataFrame:
        return df.join(links.select("video_id"), "video_id", "left_semi" if yes else "left_anti")

    for flag, name in ((f.has_tags, "video_tags"), (f.has_creator, "video_creators"), (f.has_studio, "video_studios"), (f.has_rating, "ratings"), (f.has_thumbnail, "thumbnails")):
        if flag is not None:
            kept = exists(kept, getattr(lib, name), flag)
    if f.min_rating is not None or f.max_rating is not None:
        mean = lib.ratings.groupBy("video_id").agg(F.avg("rating").alias("mean"))
        mean = mean.filter((F.col("mean") >= f.min_rating) if f.min_rating is not None else F.lit(True)).filter((F.col("mean") <= f.max_rating) if f.max_rating is not None else F.lit(True))
        kept = exists(kept, mean, True)
    if f.favorite is not None:
        kept = exists(kept, lib.favorites.filter(F.col("user_id") == f.user_id), f.favorite)
    for ids, links, key in ((f.tag_ids, "video_tags", "tag_id"), (f.creator_ids, "video_creators", "creator_id"), (f.studio_ids, "video_studios", "studio_id")):
        if not ids:
            continue
        linked = getattr(lib, links)
        if f.match_all:
            kept = exists(kept, divide(linked, key, ids), True)
        elif f.dedupe:
            kept = exists(kept, linked.filter(F.col(key).isin(*ids)), True)
        else:
            kept = kept.join(linked.filter(F.col(key).isin(*ids)).select("video_id"), "video_id")
    return kept.drop("video_id")


def order(sort: str, descending: bool) -> list[Column]:
    """Listing order: missing values last ascending and first descending, then by id; unknown columns sort by created_at."""
    c = F.col(sort if sort in SORTS else "created_at")
    return [c.desc_nulls_first(), F.col("id").desc()] if descending else [c.asc_nulls_last(), F.col("id").asc()]
