"""The stream of play counts ends where the batch query does."""

import datetime as dt
from pyspark.sql import functions as F

from cinelake.operators.sessions import plays, sessions
from cinelake.sources.library import Library
from cinelake.streaming.watching import live_plays, session_windows, tumbling
from tests.compare import DATA


def events(spark):
    e = Library(spark, DATA).watch_events
    return e.select("user_id", "video_id", "watched_seconds", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.lit(60.0).alias("limit"))


def run(stream, tmp_path, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def source(spark, df, tmp_path):
    folder = str(tmp_path / "in")
    ordered = df.orderBy("ts").coalesce(1).toPandas()
    for k in range(3):  # three files, read one micro-batch each, so sessions go across batches
        part = ordered.iloc[k * len(ordered) // 3 : (k + 1) * len(ordered) // 3]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_equals_batch(spark, tmp_path):
    df = events(spark)
    run(live_plays(source(spark, df, tmp_path), 720), tmp_path, "plays_out", "update")
    last = spark.table("plays_out").toPandas().groupby(["user_id", "video_id"])[["play_count", "total_watch_seconds"]].max().reset_index()
    want = plays(df, F.col("limit"), 720).toPandas()
    both = want.merge(last, on=["user_id", "video_id"], how="outer", suffixes=("", "_s"))
    assert (both.play_count == both.play_count_s).all()
    assert ((both.total_watch_seconds - both.total_watch_seconds_s).abs() < 1e-6).all()


def test_tumbling_stream_equals_batch(spark, tmp_path):
    df = Library(spark, DATA).raw("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "user_id")
    run(tumbling(source(spark, df, tmp_path), "1 day"), tmp_path, "days_out", "complete")
    key = lambda d: {(r.start, r.event_type): r.events for r in d.collect()}
    assert key(spark.table("days_out")) == key(tumbling(df, "1 day"))
    assert session_windows(df).agg(F.sum("events")).first()[0] == df.count()


def test_gap_is_strict_and_bad_events_are_left_out(spark):
    t = dt.datetime(2024, 1, 1)
    m = dt.timedelta(minutes=1)
    rows = [(1, 1, 30.0, t, 1), (1, 1, 30.0, t + 30 * m, 2), (1, 1, 5.0, t + 61 * m, 3), (1, 1, -3.0, t, 4), (1, None, 9.0, t, 5), (1, 1, float("nan"), t, 6)]
    df = spark.createDataFrame(rows, "user_id long, video_id long, watched_seconds double, ts timestamp, event_id long")
    assert sorted((r.event_id, r.session) for r in sessions(df, 30).collect()) == [(1, 0), (2, 0), (3, 1)]
    got = plays(df, F.lit(60.0), 30).first()
    assert (got.play_count, got.total_watch_seconds, got.session_watch_seconds) == (1, 65.0, 5.0)
    assert plays(df.limit(0), F.lit(60.0), 30).count() == 0


def test_feed_sends_public_changes_to_all(spark, tmp_path):
    from cinelake.streaming.feed import Receiver, broadcast, to_table

    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, public boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    numbers: list[int] = []
    receivers = [Receiver(to_table(str(tmp_path / "all"))), Receiver(to_table(str(tmp_path / "known")), authenticated=True), Receiver(lambda batch, number: numbers.append(number))]
    q = broadcast(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), receivers, str(tmp_path / "state"))
    q.awaitTermination(120)
    assert q.exception() is None and numbers == [0]
    ids = lambda name: sorted(r.id for r in spark.read.parquet(str(tmp_path / name)).collect())
    assert ids("all") == [1] and ids("known") == [1, 2, 3]


def test_silent_keys_are_forgotten(spark, tmp_path):
    df = events(spark)
    run(live_plays(source(spark, df, tmp_path).withWatermark("ts", "1 minute"), 720, forget_minutes=60), tmp_path, "forgetful", "update")
    last = spark.table("forgetful").agg(F.max("total_watch_seconds")).first()[0]
    assert 0 < last <= df.groupBy("user_id", "video_id").agg(F.sum("watched_seconds").alias("s")).agg(F.max("s")).first()[0] + 1e-6
