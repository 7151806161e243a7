"""Watch sessions and play counts from watch events, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["user_id", "video_id"]


def threshold(duration: Column, short_duration: float = 60.0, short_seconds: float = 10.0, seconds: float = 60.0) -> Column:
    """Seconds of a session that make a play; fewer for a video known to be short."""
    return F.when(duration <= short_duration, short_seconds).otherwise(seconds)


def sessions(events: DataFrame, gap_minutes: float = 30.0) -> DataFrame:
    """Events with their session: a gap of strictly more than ``gap_minutes`` begins one; 0 or less never does.

    events: user_id, video_id, watched_seconds, ts, event_id (ties of ts). Events without keys, time or positive finite seconds are left out.
    """
    s = F.col("watched_seconds")
    good = F.col("user_id").isNotNull() & F.col("video_id").isNotNull() & F.col("ts").isNotNull() & (s > 0) & (s < float("inf"))
    w = W.partitionBy(*KEYS).orderBy("ts", "event_id")
    since = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    fresh = (since > gap_minutes * 60e6) if gap_minutes > 0 else F.lit(False)
    starts = events.filter(good).withColumn("fresh", F.coalesce(fresh, F.lit(False)).cast("int"))
    return starts.withColumn("session", F.sum("fresh").over(w)).drop("fresh")


def plays(events: DataFrame, limit: Column, gap_minutes: float = 30.0) -> DataFrame:
    """(user_id, video_id, play_count, total_watch_seconds, session_watch_seconds, last_played_at, last_watch_at).

    A play is counted once in a session, at the event with which its seconds reach ``limit`` (a column of events).
    """
    running = F.sum("watched_seconds").over(W.partitionBy(*KEYS, "session").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    rows = sessions(events.withColumn("limit", limit), gap_minutes).withColumn("running", running)
    crossed = (F.col("running") >= F.col("limit")) & (F.col("running") - F.col("watched_seconds") < F.col("limit"))
    return rows.groupBy(*KEYS).agg(
        F.count(F.when(crossed, 1)).alias("play_count"), F.sum("watched_seconds").alias("total_watch_seconds"), F.max_by("running", F.struct("ts", "event_id")).alias("session_watch_seconds"),
        F.max(F.when(crossed, F.col("ts"))).alias("last_played_at"), F.max("ts").alias("last_watch_at"),
    )
