"""Scalar functions against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from cinelake.functions import hashing, scalars as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("n", "text"), [(0, "0 Bytes"), (1024, "1 KB"), (1 << 20, "1 MB"), (1 << 30, "1 GB"), (1536, "1.5 KB"), (1, "1 Bytes"), (1023, "1023 Bytes"), (10 * 1024, "10 KB"), (100 << 20, "100 MB")])
def test_format_bytes(spark, n, text):
    assert value(spark, X.format_bytes(F.lit(n))) == text


@pytest.mark.parametrize(("path", "yes"), [("/a/b.mp4", True), ("/a/B.MKV", True), ("/a.mp4/b", False), ("x.txt", False), ("noext", False)])
def test_is_video(spark, path, yes):
    assert value(spark, X.is_video(F.lit(path))) is yes


@pytest.mark.parametrize(("x", "want"), [(0.5, 1), (1.5, 2), (-0.5, 0), (-1.5, -1), (2.4, 2)])
def test_js_round(spark, x, want):
    assert value(spark, X.js_round(F.lit(x))) == want


@pytest.mark.parametrize(("header", "want"), [("bytes=0-9", (0, 9)), ("bytes=90-", (90, 99)), ("bytes=-10", (90, 99)), ("bytes=-500", (0, 99)), ("bytes=5-100", None), ("bytes=9-5", None), ("bytes=-", None), ("lines=1-2", None), ("bytes=100-", None)])
def test_byte_range(spark, header, want):
    a, b = X.byte_range(F.lit(header), F.lit(100).cast("long"))
    row = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (None if row.a is None else (row.a, row.b)) == want


@pytest.mark.parametrize(("text", "want"), [("30000/1001", 29.97), ("25/1", 25.0), ("24", 24.0), ("0/0", None), ("x", None), (None, None)])
def test_frames_per_second(spark, text, want):
    assert value(spark, X.frames_per_second(F.lit(text).cast("string"))) == want


def test_bitrate_steps(spark):
    rows = [(None, 1920), (30_000_000, 1920), (3_000_000, 1280), (100_000, 640)]
    df = spark.createDataFrame(rows, "bps long, w int")
    t, m, b = X.target_bitrate("hevc", F.col("bps"), F.col("w"))
    assert [tuple(r) for r in df.select(t, m, b).collect()] == [(15, 15, 30), (15, 15, 30), (3, 4, 8), (4, 4, 8)]


@pytest.mark.parametrize(("w", "h", "p", "want"), [(3840, 2160, 1920, "1920x-2"), (1280, 640, 1280, "original"), (None, 1080, 1280, "1280x-2"), (1920, 1080, 1920, "original"), (1920, 1080, None, "original")])
def test_target_resolution(spark, w, h, p, want):
    assert value(spark, X.target_resolution(F.lit(w).cast("int"), F.lit(h).cast("int"), F.lit(p).cast("int"))) == want


def test_crop_stays_inside(spark):
    cols = X.crop_square(F.lit(0.0), F.lit(0.0), F.lit(50.0), F.lit(100.0), F.lit(200), F.lit(120))
    assert list(spark.range(1).select(*cols).first()) == [0, 0, 120]


def test_settings_and_cron(spark):
    got = X.setting(F.lit(" TRUE "))
    assert value(spark, got["flag"]) is True and value(spark, got["number"]) is None
    assert value(spark, X.setting(F.lit("2.5"))["number"]) == 2.5
    assert [value(spark, X.minutes_to_cron(F.lit(m))) for m in (15, 120, 2000)] == ["*/15 * * * *", "0 */2 * * *", "0 0 * * *"]


def test_cosine_of_zero_is_null(spark):
    assert value(spark, X.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) is None
    assert math.isclose(value(spark, X.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))), math.sqrt(0.5))


def test_progress_and_media_type(spark):
    assert value(spark, X.progress(F.lit(200.0), F.lit(100.0))) == 99
    assert value(spark, X.media_type(F.lit("a.MKV"))) == "video/x-matroska"
    assert value(spark, X.media_type(F.lit("a.xyz"))) == "application/octet-stream"


def test_fingerprints(spark):
    big = bytes(range(256)) * (45_000)
    small = hashing.fingerprint(b"abc")
    assert len(small) == 32 and small != hashing.fingerprint(b"abd")
    assert hashing.fingerprint(big) != hashing.fingerprint(big + b"x")
    df = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "c binary")
    assert [r.h for r in df.select(hashing.fingerprints("c").alias("h")).collect()] == [small, None]


def test_files_with_equal_samples_are_read_whole(spark, tmp_path):
    big = bytearray(bytes(range(256)) * 60_000)  # 15 MB: more than the three samples
    (tmp_path / "a.bin").write_bytes(big)
    (tmp_path / "b.bin").write_bytes(big)
    big[5 << 20] ^= 1  # between the samples
    (tmp_path / "c.bin").write_bytes(big)
    (tmp_path / "d.bin").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    part = {r.path[-5]: r.fingerprint for r in hashing.of_files(files).collect()}
    assert part["a"] == part["b"] == part["c"] == hashing.fingerprint(bytes(big)) and part["d"] == hashing.fingerprint(b"abc")
    assert sorted(r.path[-5] for r in hashing.same_files(files).collect()) == ["a", "b"]


def test_lists_flags_and_frames(spark):
    assert value(spark, X.id_list(F.lit("3, x,12,,7 "))) == [3, 12, 7] and value(spark, X.id_list(F.lit(None).cast("string"))) == []
    assert [value(spark, X.flag(F.lit(t))) for t in ("TRUE", "1", "0", "no", " false ")] == [True, True, False, False, False]
    n, times = X.frame_times(F.lit(65.0), 30)
    assert (value(spark, n), value(spark, times)) == (3, [0.0, 30.0, 60.0])
    assert value(spark, X.frame_times(F.lit(None).cast("double"), 30)[1]) == [] and value(spark, X.seconds_left(F.lit(9000.0), F.lit(3), F.lit(10))) == 21
    assert len(X.PRESETS) == 9 and {p.max_mbit for p in X.PRESETS} == {20, 15, 6, 10, 8, 4, None}
