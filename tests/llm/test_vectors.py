"""Nearest vectors and similarity groups against brute force."""

import numpy as np
import pytest

from cinelake.llm import clusters, neighbours, vectors
from cinelake.llm.components import components

SCHEMA = "id long, embedding array<float>, similarity string, query_id int, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s", 0, 0) for i, v in rows], SCHEMA)


def faces(rng, groups, each, noise=0.35):
    centres = rng.standard_normal((groups, 64))
    out = np.repeat(centres, each, axis=0) + noise * rng.standard_normal((groups * each, 64))
    return (out * rng.uniform(0.1, 30, (len(out), 1))).astype(np.float32)


def brute_top(q, c, k, least):
    unit = lambda rows: {i: vectors.unit64(v[None].astype(np.float32))[0] for i, v in rows}
    q, c = unit(q), unit(c)
    out = set()
    for i, a in q.items():
        s = sorted((-round(float(a @ b), 6), j) for j, b in c.items() if a @ b >= least)
        out |= {(i, j, -x) for x, j in s[:k]}
    return out


def test_nearest_has_recall(spark):
    rng = np.random.default_rng(1)
    x = faces(rng, 150, 8)
    c = [(i, v) for i, v in enumerate(x) if i % 3]
    q = [(i, v) for i, v in enumerate(x) if i % 5 == 0]
    got = {(r.query_id, r.neighbour_id, r.similarity) for r in neighbours.nearest(frame(spark, q), frame(spark, c)).collect()}
    want = brute_top(q, c, 3, 0.85)
    assert got <= want | got and len(got & want) >= 0.99 * len(want) > 100


def test_nearest_in_several_passes_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = faces(rng, 40, 10)
    rows = list(enumerate(x))
    monkeypatch.setattr(neighbours, "PART_ROWS", 150)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    got = neighbours.nearest(frame(spark, rows[:100]), frame(spark, rows)).collect()
    want = brute_top(rows[:100], rows, 3, 0.85)
    assert len({(r.query_id, r.neighbour_id, r.similarity) for r in got} & want) >= 0.99 * len(want)
    assert all(1 <= r["rank"] <= 3 for r in got)


ODD = [(None, [1.0] * 64), (50, None), (51, [1.0] * 63), (52, [0.0] * 64), (53, [float("nan")] + [1.0] * 63), (54, [float("inf")] + [1.0] * 63), (55, [None] + [1.0] * 63), (56, [])]


def test_unusable_rows_repeated_rows_and_ties(spark):
    base = [1.0] * 32 + [0.5] * 32
    c = [(9, base), (9, base), (9, base), (9, base), (4, base), (7, [2 * x for x in base]), (3, [-x for x in base]), (8, base)] + ODD
    got = neighbours.nearest(frame(spark, [(1, base), (1, base), *ODD]), frame(spark, c)).collect()
    assert sorted((r.query_id, r.neighbour_id, r["rank"]) for r in got) == [(1, 4, 1), (1, 7, 2), (1, 8, 3)]


def test_empty_sides(spark):
    some, none = frame(spark, [(1, [1.0] * 64)]), frame(spark, [])
    assert neighbours.nearest(none, some).count() == neighbours.nearest(some, none).count() == neighbours.nearest(none, none).count() == 0
    assert clusters.groups(none).count() == 0


def test_very_large_and_small_values_are_usable(spark):
    v = np.linspace(0.5, 1, 64)
    got = neighbours.nearest(frame(spark, [(1, v * 1e-30)]), frame(spark, [(2, v * 1e30)])).collect()
    assert [(r.neighbour_id, r.similarity) for r in got] == [(2, 1.0)]


def at_cosine(rng, n, cosine):
    """Pairs of unit vectors of that similarity."""
    q = vectors.unit64(rng.standard_normal((n, 64)))
    o = rng.standard_normal((n, 64))
    o = vectors.unit64(o - np.einsum("ij,ij->i", o, q)[:, None] * q)
    return q.astype(np.float32), (cosine * q + np.sqrt(1 - cosine**2) * o).astype(np.float32)


def test_nearest_finds_those_right_at_the_limit(spark):
    q, c = at_cosine(np.random.default_rng(7), 2000, 0.8505)
    got = neighbours.nearest(frame(spark, list(enumerate(q))), frame(spark, list(enumerate(c)))).filter("query_id = neighbour_id").count()
    assert got >= 1996


def test_a_query_meets_few_of_a_large_collection():
    rng = np.random.default_rng(8)
    c = vectors.unit64(rng.standard_normal((40_000, 64))).astype(np.float32)
    met = neighbours.CollisionIndex(np.arange(len(c)), c, neighbours.bases()).meetings(c[:200] + np.float32(0.001))[1].sum(axis=0)
    assert met.max() < len(c) / 100


def test_nearest_where_very_many_are_alike(spark):
    rng = np.random.default_rng(9)
    x = faces(rng, 1, 1500, 0.2)
    x[:300] = x[0]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(x)), x)]
    got = {(r.query_id, r.neighbour_id, r.similarity) for r in neighbours.nearest(frame(spark, rows[290:330]), frame(spark, rows)).collect()}
    assert got == brute_top(rows[290:330], rows, 3, 0.85)


def test_bit_sliced_counts():
    rng = np.random.default_rng(3)
    planes = rng.integers(0, 2, (24, 5, 64)).astype(np.uint8)
    waiting = [[]]
    for p in planes:
        neighbours._add(waiting, 0, np.packbits(p, axis=1, bitorder="little").view(np.uint64).copy())
    done = neighbours._planes(waiting)
    for least in (1, 7, 12, 13, 16, 24):
        got = np.unpackbits(neighbours._at_least(done, least).view(np.uint8), axis=1, bitorder="little")
        assert (got == (planes.sum(axis=0) >= least)).all()


def brute_groups(rows, least=0.85, smallest=3):
    ids = np.array([i for i, _ in rows])
    u = vectors.unit64(np.array([v for _, v in rows], np.float32))
    label = np.arange(len(ids))
    near = u @ u.T >= least
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    out = set()
    for g in np.unique(label):
        m = ids[label == g]
        if len(set(m)) >= smallest:
            out |= {(int(m.min()), int(i)) for i in m}
    return out


@pytest.mark.parametrize("split", [6_000, 40])
def test_groups(spark, monkeypatch, split):
    rng = np.random.default_rng(4)
    x = faces(rng, 60, 12, 0.42)
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(x)), x)]
    rows += [(5000 + i, x[0]) for i in range(60)] + rows[:20]
    monkeypatch.setattr(clusters, "CELL", 50)
    monkeypatch.setattr(clusters, "SPLIT", split)
    got = {(r.group_id, r.member_id) for r in clusters.groups(frame(spark, rows + ODD)).collect()}
    want = brute_groups(list({i: (i, v) for i, v in rows}.values()))
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_memory_for_placing_does_not_grow_with_the_cells():
    import tracemalloc

    rng = np.random.default_rng(10)
    x, centres = (vectors.unit64(rng.standard_normal((n, 64))).astype(np.float32) for n in (3_000, clusters.MOST_CELLS))
    tracemalloc.start()
    row, cell = clusters._cells(x, centres)
    clusters._best(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    for i in (0, 1_500, 2_999):
        s = x[i] @ centres.T
        order = np.argsort(-s)[: clusters.MOST_COPIES]
        assert set(cell[row == i].tolist()) == {int(c) for n, c in enumerate(order) if n < clusters.COPIES or s[c] >= s[order[0]] - clusters.HARDLY}


def test_typical_members(spark):
    rng = np.random.default_rng(5)
    x = faces(rng, 3, 9, 0.2)
    df = frame(spark, list(enumerate(x)))
    got = clusters.describe(df, clusters.groups(df)).collect()
    for g in {r.group_id for r in got}:
        u = vectors.unit64(x[g : g + 9])
        c = u.sum(axis=0) / np.linalg.norm(u.sum(axis=0))
        best = sorted((-round(float(s), 6), g + i) for i, s in enumerate(u @ c))[:3]
        assert [r.member_id for r in sorted(got, key=lambda r: r["rank"]) if r.group_id == g] == [i for _, i in best]
        assert {r["size"] for r in got} == {9}


def test_packing_loses_nothing():
    x = np.array([[0.5] * 64, [0.1] * 64, [1e30] * 64], np.float32)
    packed, short = clusters.pack(x)
    assert short.tolist() == [True, False, False] and [len(p) for p in packed] == [128, 256, 256]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    edges = chain + [(200, 100), (100, 300), (300, 300), (None, 5), (7, None)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("scaled", [False, True])
def test_one_vector_with_very_many_copies(spark, monkeypatch, scaled):
    rng = np.random.default_rng(6)
    hot = vectors.unit64(rng.standard_normal((1, 64)))
    aside = rng.standard_normal((300, 64))
    aside = vectors.unit64(aside - (aside @ hot.T) * hot)
    alike = 0.88 * hot + np.sqrt(1 - 0.88**2) * aside  # each alike to the hot vector, hardly any to one another
    x = np.concatenate([np.repeat(hot, 1000, axis=0), alike, rng.standard_normal((1700, 64))]).astype(np.float32)
    if scaled:
        x[:1000] *= rng.uniform(0.1, 30, (1000, 1)).astype(np.float32)
    x = x[rng.permutation(len(x))]
    monkeypatch.setattr(clusters, "CELL", 5)
    got = {(r.group_id, r.member_id) for r in clusters.groups(frame(spark, list(enumerate(x))).coalesce(1)).collect()}
    want = brute_groups(list(enumerate(x)))
    assert len(want) >= 1290 and got <= want and len(got) >= 0.99 * len(want)
