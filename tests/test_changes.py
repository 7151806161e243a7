"""Table changes, rules, filters and sources."""

import pytest
from pyspark.sql import functions as F

from cinelake.operators import filters, listing, merging as M, paths, statistics
from cinelake.operators.filters import VideoFilter
from cinelake.operators.paths import Condition, Rule
from cinelake.sources import exchange, files
from cinelake.sources.library import Library
from tests.compare import DATA


@pytest.fixture(scope="module")
def lib(spark):
    return Library(spark, DATA)


def test_ranges_are_checked():
    with pytest.raises(ValueError):
        VideoFilter(min_width=5, max_width=4)
    with pytest.raises(ValueError):
        VideoFilter(favorite=True)


def test_any_holds_all(lib):
    ids = (1, 2, 3)
    some = {r.id for r in filters.apply(lib, VideoFilter(studio_ids=ids)).select("id").collect()}
    every = {r.id for r in filters.apply(lib, VideoFilter(studio_ids=ids, match_all=True)).select("id").collect()}
    assert every <= some and some


def test_pages_make_the_whole_list(lib):
    f = VideoFilter(include_hidden=True)
    got = [r.id for n in range(1, 12) for r in listing.page(lib, f, "bitrate", True, n, 10).select("id").collect()]
    assert len(got) == len(set(got)) == min(110, lib.videos.count())


def test_next_and_previous_are_inverse(lib):
    rows = lib.videos
    for i in [r.id for r in rows.orderBy("id").limit(4).collect()]:
        after = listing.neighbour(rows, i, "duration_seconds", False).first()
        assert listing.neighbour(rows, after.id, "duration_seconds", True).first().id == i


def test_breakdown_sums_to_total(lib):
    total = lib.videos.count()
    assert statistics.resolution_breakdown(lib.videos).agg(F.sum("count")).first()[0] == total
    assert statistics.resolution_breakdown(lib.videos.limit(0)).count() == 0
    assert statistics.totals(lib.videos.limit(0)).first().total == 0


def test_no_cartesian_product_in_a_filtered_page(lib):
    df = filters.apply(lib, VideoFilter(has_tags=True, min_height=720, search="a"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_upsert_and_insert_ignore(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, v string, w int")
    new = spark.createDataFrame([(2, None), (3, "c"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, M.upsert(old, new.distinct(), ["id"]).collect()), key=str) == [(1, "a", 5), (2, None, 6), (3, "c", None)]
    assert M.insert_ignore(old.drop("w"), new, ["id"]).count() == 3


def test_upsert_of_repeated_keys_takes_the_last(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (2, "x", 1), (2, "y", 2), (3, None, 1), (None, "n", 1)], "id int, v string, at int")
    assert sorted(map(tuple, M.upsert(old, new, ["id"], ["at"]).collect()), key=str) == [(1, "b"), (2, "y"), (3, None), (None, "n")]
    assert sorted(map(tuple, M.upsert(old, new.drop("at").filter("id is not null"), ["id"]).collect()), key=str) == [(1, "c"), (2, "y"), (3, None)]


def test_only_the_columns_summed_are_read(spark):
    import re

    from cinelake import catalog

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = catalog.QUERIES["a1_library_totals"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"ReadSchema: struct<(.*?)>", plan)) == {"id:bigint,file_size_bytes:bigint,duration_seconds:double,is_available:boolean"}
    plan = catalog.QUERIES["f4_dimensions"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(width,1280)" in plan and "file_path" not in plan


def test_reconcile(spark):
    listed = spark.createDataFrame([("a", 1), ("b", 2), ("n", 1)], "file_path string, file_size_bytes long")
    known = spark.createDataFrame([("a", 1), ("b", 3), ("m", 1)], "file_path string, file_size_bytes long")
    assert {tuple(r) for r in M.reconcile(listed, known).collect()} == {("a", "unchanged"), ("b", "changed"), ("n", "new"), ("m", "missing")}


def test_append_starts_at_zero_and_skips_known(spark):
    items = spark.createDataFrame([(1, 5, 4)], "playlist_id long, video_id long, position int")
    new = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (2, 7, 0)], "playlist_id long, video_id long, n int")
    assert sorted(map(tuple, M.append_items(items, new).collect())) == [(1, 5, 4), (1, 6, 5), (2, 7, 0)]


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/media/onlyfans/jane/x.mp4", ("jane", None, None, None, "high")),
        ("/lib/Ann/Show/E12.mkv", ("Ann", None, "Show", "12", "high")),
        ("/videos/bob/x.mp4", ("bob", None, None, None, "high")),
        ("/Acme/bob/clip.mp4", ("bob", "Acme", None, None, "high")),
        ("clip_1080p_x.mp4", (None, None, None, None, "medium")),
        ("2024-01-02.mp4", (None, None, None, None, "low")),
        ("x.mp4", (None, None, None, None, "low")),
    ],
)
def test_paths(spark, path, want):
    p = paths.parse(F.lit(path))
    row = spark.range(1).select(*(p[k].alias(k) for k in ("creator", "studio", "series", "episode", "confidence", "tags"))).first()
    assert tuple(row)[:5] == want


def test_tags_of_names(spark):
    p = paths.parse(F.lit("/a/x_4k_-hdr-_.vr.mp4"))
    assert spark.range(1).select(p["tags"]).first()[0] == "4K,HDR,VR"


def test_invalid_rules_never_fire(spark):
    df = spark.createDataFrame([(1, "/a/3840x2160/av1.mp4")], "id long, file_path string")
    yes = Rule(1, "r", 1, (Condition("resolution", "equals", "4k"), Condition("codec", "contains", "AV1")), (("add_tag", "1"),))
    no = Rule(2, "n", 1, (Condition("path_pattern", "matches", "("), Condition("resolution", "equals", "1080p"), Condition("file_size", "equals", "1")), (("add_tag", "1"),))
    assert [r.rule_id for r in paths.evaluate(df, [yes, no]).collect()] == [1]
    assert paths.evaluate(df, []).count() == 0


def test_export_and_load(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "s"), (2, None, "t")], "id int, name string, password_hash string")
    exchange.export({"users": df}, str(tmp_path))
    back = exchange.load(spark, str(tmp_path), {"users": df.drop("password_hash").schema})["users"]
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None)]
    assert exchange.row_counts({"users": back}).first().n == 2 and exchange.next_id(back).first()[0] == 3


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.MP4").write_bytes(b"1234")
    (tmp_path / "b.txt").write_bytes(b"12")
    assert [r.file_size_bytes for r in files.listing(spark, str(tmp_path)).collect()] == [4]
    assert tuple(files.folder_size(spark, str(tmp_path)).first()) == (2, 6)


def test_runnable(lib):
    assert exchange.runnable(lib.jobs, 3).count() == 3
    assert exchange.runnable(lib.jobs, 1, "batch_id").count() == lib.jobs.filter("status = 'pending'").select("batch_id").distinct().count()


def test_flags_and_order_of_an_import(spark, tmp_path):
    (tmp_path / "videos").mkdir()
    (tmp_path / "videos" / "a.json").write_text('{"id":1,"is_available":1}\n{"id":2,"is_available":false}\n{"id":3}\n')
    (tmp_path / "users").mkdir()
    (tmp_path / "users" / "a.json").write_text('{"id":1}\n')
    schemas = {"videos": spark.createDataFrame([], "id long, is_available boolean").schema, "users": spark.createDataFrame([], "id long").schema}
    got = exchange.load(spark, str(tmp_path), schemas)
    assert list(got) == ["users", "videos"] and [r.is_available for r in got["videos"].orderBy("id").collect()] == [True, False, None]


def test_automatic_tags_ignore_operators(spark):
    df = spark.createDataFrame([(1, "/videos/ann/x_4K_y.mp4"), (2, "/videos/bob/a1920x1080.mp4"), (3, "x.mp4")], "id long, file_path string")
    rules = [Rule(1, "r", 1, (Condition("resolution", "not_equals", "4k"), Condition("resolution", "equals", "1080p")), (("add_creator", "$creator"), ("set_rating", "1"), ("add_tag", "9")))]
    assert sorted(map(tuple, paths.auto_tags(df, rules).collect())) == [(1, 1, "add_creator", "ann"), (1, 1, "add_tag", "9"), (2, 1, "add_creator", "bob"), (2, 1, "add_tag", "9")]


def test_resolve_and_match(spark):
    known = spark.createDataFrame([(1, "a"), (2, "b"), (5, "b")], "id long, name string")
    items = spark.createDataFrame([(1, 1, None), (2, 9, "a"), (3, None, "b"), (4, None, "c"), (5, None, None)], "item long, id long, name string")
    assert {r.item: (r.entity_id, r.action) for r in M.resolve(items, known, "item").collect()} == {1: (1, "update"), 2: (None, "unknown id"), 3: (2, "update"), 4: (None, "create"), 5: (None, "create")}
