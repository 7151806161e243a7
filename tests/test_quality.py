"""Orphan references and hierarchies on small cases."""

import pytest

from cinelake.operators import entities, hierarchy, integrity


def tree(spark, rows, **options):
    df = spark.createDataFrame(rows, "id long, parent_id long, name string, updated_at int, head string, size int")
    return hierarchy.build(df, updated="updated_at", **options)


def flat(h):
    return {r.id: (r.root_id, r.depth, r.path, r.descendants) for r in h.flat().collect()}


def brute(parents):
    out = {}
    for i in parents:
        seen, at = [], i
        while at is not None and at not in seen:
            seen.append(at)
            nxt = parents[at]
            at = nxt if nxt in parents else None
        out[i] = (min(seen[seen.index(at) :]), -1) if at is not None else (seen[-1], len(seen) - 1)
    return out


def test_hierarchy_of_every_shape(spark):
    parents = {1: None, 2: 1, 3: 2, 4: 2, 5: 99, 6: 5, 7: 8, 8: 9, 9: 7, 10: 9, 11: 10, 12: 12, 13: 12, 14: 3, 15: 14, 16: 15}
    h = tree(spark, [(i, p, f" n{i} ", 1, "x", 7) for i, p in parents.items()])
    got = flat(h)
    assert {i: v[:2] for i, v in got.items()} == brute(parents)
    assert got[16][2] == "n1 > n2 > n3 > n14 > n15 > n16"
    assert got[1][3] == 6 and got[7][3] == -1 and got[7][2] is None
    below = {(r.id, r.descendant_id) for r in h.below().collect()}
    chain = {i: [] for i in parents}
    for i in parents:
        at = parents[i]
        while got[i][1] >= 0 and at in parents and at is not None:
            chain[i].append(at)
            at = parents[at]
    assert below == {(a, i) for i, above in chain.items() for a in above}


def test_deep_chain_and_bush(spark):
    n = 300
    parents = {i: i + 1 if i < n else None for i in range(1, n + 1)} | {1000 + i: 150 for i in range(200)}
    h = tree(spark, [(i, p, "t", 1, None, None) for i, p in parents.items()], paths=False)
    assert {i: v[:2] for i, v in flat(h).items()} == brute(parents)


def test_latest_row_holds_and_nulls_are_defined(spark):
    rows = [(1, None, "root", 1, "", 0), (2, 1, "old", 1, "", 0), (2, 3, "new", 5, "", 0), (2, 3, "new", 5, "", 0), (3, None, None, None, "", 0), (None, 1, "x", 1, "", 0)]
    got = flat(tree(spark, rows))
    assert got[2][:3] == (3, 1, " > new") and set(got) == {1, 2, 3}


def test_empty_hierarchy(spark):
    h = tree(spark, [])
    assert h.flat().count() == 0 and h.below().count() == 0


@pytest.fixture
def references(spark):
    rows = spark.createDataFrame([(1, 10, "2024-01-05", "p"), (2, 11, "2024-01-06", "p"), (3, None, "2024-02-01", "p"), (4, 99, None, "p"), (4, 99, None, "p"), (5, 98, "2024-02-03", "p")], "id long, ref int, at string, there string")
    rows = rows.selectExpr("id", "ref", "cast(at as timestamp_ntz) at", "there")
    parents = spark.createDataFrame([(10,), (10,), (11,), (None,)], "id long")
    return [integrity.Reference("child", rows, "id", "ref", "parent", parents, created="at")]


def test_orphans(references):
    assert {tuple(r) for r in integrity.orphans(references).collect()} == {("child", 4, 99), ("child", 5, 98)}


def test_orphan_counts(references):
    assert {tuple(r) for r in integrity.orphan_counts(references).collect()} == {("child", "2024-01", 0, 2), ("child", "2024-02", 1, 1), ("child", None, 1, 1)}


def test_orphans_of_empty_tables(spark, references):
    r = references[0]
    none = integrity.Reference("child", r.rows.limit(0), "id", "ref", "parent", r.parents, created="at")
    assert integrity.orphans([none]).count() == 0
    bare = integrity.Reference("child", r.rows, "id", "ref", "parent", r.parents.limit(0), created="at")
    assert integrity.orphans([bare]).count() == 4


def test_a_hot_key_is_grouped_once(spark):
    rows = spark.range(20_000).selectExpr("id", "case when id % 3 = 0 then 7 else id end as ref")
    parents = spark.range(10_000).selectExpr("id")
    got = integrity.orphans([integrity.Reference("c", rows, "id", "ref", "p", parents)])
    assert got.count() == len([i for i in range(10_000, 20_000) if i % 3])


def test_deep_tag_trees(spark):
    n = 300  # far beyond what a recursive query may take
    rows = [(i, i - 1 if i > 1 else None, f"t{i}") for i in range(1, n + 1)] + [(2001, 2003, "a"), (2002, 2001, "b"), (2003, 2002, "c"), (2004, 2001, "d")]
    tags = spark.createDataFrame(rows, "id long, parent_id long, name string").coalesce(1)
    assert {(r.id, r.steps) for r in entities.ancestors(tags, n).collect()} == {(i, n - i) for i in range(1, n + 1)}
    got = {r.id: r for r in entities.descendants(tags, 3).collect()}
    assert set(got) == set(range(3, n + 1)) and got[n].depth == n - 3 and got[n].path.startswith("t3 > t4 > ") and got[n].path.count(" > ") == n - 3
    assert {(r.id, r.depth) for r in entities.descendants(tags, 2002).collect()} == {(2002, 0), (2003, 1), (2001, 2), (2004, 3)}
    assert {r.id for r in entities.valid_parents(tags, 2).collect()} == {1, 2001, 2002, 2003, 2004}
    links = spark.createDataFrame([(1, 1), (1, 250), (2, 2001)], "video_id long, tag_id long")
    left, kept = entities.delete_subtree(tags, links, 2)
    assert left.count() == 5 and sorted(r.tag_id for r in kept.collect()) == [1, 2001]
    assert hierarchy.depths(tags, paths=False).agg({"depth": "max"}).first()[0] == n - 1
    assert entities.descendants(tags, 99_999).count() == 0 and entities.ancestors(tags, 99_999).count() == 0


def test_hot_keys_are_split(spark, monkeypatch):
    from cinelake.plans import skew

    monkeypatch.setattr(skew, "HOT", 100)
    monkeypatch.setattr(hierarchy, "HOT", 100)
    parents = {1: None, 2: 1, 3: 2} | {i: 3 if i % 3 else i - 1 for i in range(4, 904)}
    h = tree(spark, [(i, p, "t", 1, None, None) for i, p in parents.items()], paths=False)
    assert {i: v[:2] for i, v in flat(h).items()} == brute(parents)
    rows = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 7 else id end as ref")
    got = integrity.orphans([integrity.Reference("c", rows, "id", "ref", "p", spark.range(10, 100))])
    assert got.count() == 3000 - len([i for i in range(10, 100) if i % 3])
