"""Watch sessions and play counts on a stream, and tumbling counts of events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "user_id long, video_id long, play_count long, total_watch_seconds double, session_watch_seconds double, last_played_at timestamp, last_watch_at timestamp"
STATE = "play_count long, total double, session double, counted boolean, last_played timestamp, last_watch timestamp"


def live_plays(events: DataFrame, gap_minutes: float = 30.0, forget_minutes: float | None = None) -> DataFrame:
    """Update-mode stream of the play statistics of every (user, video), as ``operators.sessions.plays`` has them at the end.

    events: user_id, video_id, watched_seconds, ts timestamp, event_id, limit. The state of a key is one small row; the
    events of a micro-batch are folded in order of time and id. With ``forget_minutes`` (events need a watermark) a key
    silent for so long gives its state up: what was sent stays with the receiver, and events that come later begin new
    totals, which the receiver adds to them.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        plays, total, session, counted, played, watched = state.get if state.exists else (0, 0.0, 0.0, False, None, None)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        ts, seconds = rows["ts"].to_numpy("datetime64[us]").astype("int64"), rows["watched_seconds"].to_numpy(float)
        before = np.concatenate([[ts[0] if watched is None else _micros(watched)], ts[:-1]])
        place = np.cumsum((ts - before > gap_minutes * 60e6) if gap_minutes > 0 else np.zeros(len(ts), bool))  # 0: the session of the state goes on
        run = np.cumsum(seconds)
        starts = np.searchsorted(place, place)  # the first event of each event's session
        run = run - run[starts] + seconds[starts] + np.where(place == 0, session, 0.0)
        full = np.flatnonzero(run >= rows["limit"].to_numpy(float))
        which, first = np.unique(place[full], return_index=True)
        fresh = which[first >= 0] > 0 if counted else np.ones(len(which), bool)
        plays += int(fresh.sum())
        if fresh.any():
            played = pd.Timestamp(int(ts[full[first[fresh][-1]]]), unit="us")
        counted = bool(len(which) and which[-1] == place[-1]) or (counted and place[-1] == 0)
        total, session, watched = total + float(seconds.sum()), float(run[-1]), pd.Timestamp(int(ts[-1]), unit="us")
        stamp = lambda x: None if x is None else pd.Timestamp(x).to_pydatetime()
        state.update((plays, total, session, counted, stamp(played), stamp(watched)))
        if forget_minutes is not None:
            state.setTimeoutTimestamp(max(int(ts[-1] // 1000 + forget_minutes * 60_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "video_id": [key[1]], "play_count": [plays], "total_watch_seconds": [total], "session_watch_seconds": [session], "last_played_at": [stamp(played)], "last_watch_at": [stamp(watched)]})

    s = F.col("watched_seconds")
    good = events.filter(F.col("user_id").isNotNull() & F.col("video_id").isNotNull() & F.col("ts").isNotNull() & (s > 0) & (s < float("inf")))
    good = good.select("user_id", "video_id", "watched_seconds", "ts", "event_id", "limit")
    timeout = GroupStateTimeout.NoTimeout if forget_minutes is None else GroupStateTimeout.EventTimeTimeout
    return good.groupBy("user_id", "video_id").applyInPandasWithState(fold, OUT, STATE, "update", timeout)


def _micros(at: object) -> int:
    return int(pd.Timestamp(at).to_datetime64().astype("datetime64[us]").astype("int64"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, events, value) by window; on a stream, windows close ``late`` after their end."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "events", "value")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, events) by activity without a gap; the end of a window is exclusive."""
    counted = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
