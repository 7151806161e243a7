"""Most similar vectors for every vector, by collision counting over sorted projections.

Every vector of the collection is projected on ``ROTATIONS`` random orthogonal bases, and the axes of each are divided among
``BLOCKS`` blocks. In a block the vector falls to the axis and sign of its largest coordinate; an array keeps the collection
sorted by what it falls to in three blocks, and there are ``len(STEPS)`` arrays for each basis. A query collides with the
vectors that stand at its own place of an array, so what it meets is about one vector in 600, all arrays together. Of these,
the ones that collide with it on at least ``COLLISIONS`` of 64 one-bit projections and ``ALL_COLLISIONS`` of 128 (counted by popcount) are
verified by their true cosine similarity.

A query that would meet a large share of the collection is compared with all of it instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.llm.vectors import DIM, matrix, raw, sized, unit64
from cinelake.plans.layout import spread
from cinelake.plans.parts import load, store
from cinelake.plans.scratch import checkpoint

#: Bases, blocks of the axes of each, and how far on in the circle of bases the blocks after the first of an array are taken
#: from. Two vectors right at a similarity of 0.85 fall to the same in a block with a probability of 0.44, and share no array
#: with one of 0.0003.
ROTATIONS, BLOCKS, STEPS = 40, 3, ((0, 0), (1, 5), (5, 1))
#: Axes of a block at most; an array has (2 * axes) ** blocks places.
AXES = 21
#: One-bit projections that two vectors must have in common, of the first 64 and of 128: at 0.85 they have 53 and 105, with a
#: deviation of 3 and 4.3.
COLLISIONS, ALL_COLLISIONS = 40, 88
#: Vectors that queries are compared with at a time, where they are compared with all.
BLOCK = 16_384
#: Vectors of one part of the collection, about; its index takes up to 600 MB of a task.
PART_ROWS = 786_432
QUERIES = 1024
#: A query that meets more than this part of the collection is compared with all of it.
CROWDED = 1 / 16
#: So is every query where a part has no more vectors than this.
FEW = 1024
#: Meetings looked through at a time.
MEETINGS = 1 << 20


class CollisionIndex:
    """Vectors of one part of the collection, and the arrays sorted by what they fall to.

    ``stored`` has the vectors with their largest elements brought near 1 by powers of two, so nothing is lost; they are kept in
    half precision where that loses nothing either.
    """

    def __init__(self, ids: np.ndarray, stored: np.ndarray, bases: np.ndarray):
        self.ids, self.stored, self.bases = ids, stored, bases
        self.scale = np.empty(len(ids), np.float32)
        blocks, axes = bases.shape[1], bases.shape[3]
        falls = np.empty((blocks, len(bases), len(ids)), np.uint8)
        self.bits = np.empty((2, len(ids)), np.uint64)
        for at in range(0, len(ids), BLOCK):
            some = slice(at, at + BLOCK)
            wide = stored[some].astype(np.float64)
            norm = np.sqrt(np.einsum("ij,ij->i", wide, wide))
            self.scale[some] = 1 / norm
            falls[:, :, some], self.bits[:, some] = _falls((wide / norm[:, None]).astype(np.float32), bases)
        places = (2 * axes) ** blocks
        self.order, self.start = np.empty((len(_arrays()), len(ids)), np.int32), np.empty((len(_arrays()), places + 1), np.int32)
        for n, where in enumerate(_arrays()):
            place = _place(falls, where, axes)
            self.order[n] = np.argsort(place, kind="stable")
            self.start[n, 0], self.start[n, 1:] = 0, np.cumsum(np.bincount(place, minlength=places))

    def near(self, rows: np.ndarray | slice) -> np.ndarray:
        """Those vectors in float32, scaled to length 1."""
        return self.stored[rows].astype(np.float32) * self.scale[rows, None]

    def meetings(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the vectors at each query's place begin in each array, how many they are, and the query's one-bit projections."""
        falls, bits = _falls(queries, self.bases)
        low, many = np.empty((2, len(self.order), len(queries)), np.int64)
        for n, where in enumerate(_arrays()):
            place = _place(falls, where, self.bases.shape[3])
            low[n] = self.start[n].take(place)
            many[n] = self.start[n].take(place + 1) - low[n]
        return low, many, bits

    def candidates(self, queries: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query row, vector row) of pairs that collide, each once and sorted, all of a query together; of crowded queries those alike."""
        low, many, bits = self.meetings(queries)
        met = many.sum(axis=0)
        crowded = (met > CROWDED * len(self.ids)) | (len(self.ids) <= FEW)
        full = np.flatnonzero(crowded)
        for some in (full[at : at + 16] for at in range(0, len(full), 16)):
            pairs = []
            for at in range(0, len(self.ids), BLOCK):
                q, v = np.nonzero(queries[some] @ self.near(slice(at, at + BLOCK)).T >= least)
                pairs.append(some[q] * np.int64(len(self.ids)) + v + at)
            pairs = np.sort(np.concatenate(pairs))
            yield pairs // len(self.ids), pairs % len(self.ids)
        rest = np.flatnonzero(~crowded)
        for some in np.split(rest, np.flatnonzero(np.diff(np.cumsum(met[rest]) // MEETINGS)) + 1):
            found = []
            for n in range(len(self.order)):
                count = many[n, some]
                end = np.cumsum(count)
                at = np.arange(end[-1] if len(end) else 0) + np.repeat(low[n, some] - (end - count), count)
                v, q = self.order[n].take(at), np.repeat(some, count)
                apart = np.bitwise_count(np.repeat(bits[0, some], count) ^ self.bits[0].take(v))
                hit = np.flatnonzero(apart <= 64 - COLLISIONS)
                v, q, apart = v[hit], q[hit], apart[hit]
                hit = apart + np.bitwise_count(bits[1, q] ^ self.bits[1, v]) <= 128 - ALL_COLLISIONS
                found.append(q[hit] * np.int64(len(self.ids)) + v[hit])
            pairs = np.sort(np.concatenate(found))
            pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
            yield pairs // len(self.ids), pairs % len(self.ids)


def _arrays() -> list[tuple[int, ...]]:
    """The basis of each block of each array."""
    return [(i, *((i + x) % ROTATIONS for x in step)) for step in STEPS for i in range(ROTATIONS)]


def _falls(vectors: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What vectors fall to in each block of each basis, twice the axis and one more for a negative sign; and 128 one-bit projections."""
    rotations, blocks, dim, axes = bases.shape
    out = np.empty((blocks, rotations, len(vectors)), np.uint8)
    signs, need = [], -(-128 // (blocks * axes))
    for i, basis in enumerate(bases):
        at = (vectors @ basis.transpose(1, 0, 2).reshape(dim, -1)).reshape(-1, axes)
        if i < need:
            signs.append(at.reshape(len(vectors), -1) > 0)
        axis = np.abs(at).argmax(axis=1)
        sign = at.ravel().take(np.arange(0, at.size, axes) + axis) < 0
        out[:, i] = (2 * axis + sign).reshape(-1, blocks).T
    bits = np.packbits(np.concatenate(signs, axis=1)[:, :128], axis=1)
    return out, np.ascontiguousarray(np.pad(bits, ((0, 0), (0, 16 - bits.shape[1]))).view(np.uint64).T)


def _place(falls: np.ndarray, where: tuple[int, ...], axes: int) -> np.ndarray:
    """The place in an array of vectors that fall to ``falls``."""
    place = np.zeros(falls.shape[2], np.int32)
    for block, basis in zip(falls, where):
        place = place * (2 * axes) + block[basis]
    return place


def _add(waiting: list[list[np.ndarray]], k: int, plane: np.ndarray) -> None:
    """Adds a bit plane of weight 2**k; three of a weight become one, with a carry."""
    while len(waiting) <= k:
        waiting.append([])
    waiting[k].append(plane)
    if len(waiting[k]) == 3:
        a, b, c = waiting[k]
        half = a ^ b
        waiting[k] = [half ^ c]
        a &= b
        half &= c
        a |= half
        _add(waiting, k + 1, a)


def _planes(waiting: list[list[np.ndarray]]) -> list[np.ndarray | None]:
    """One bit plane of each weight; a last carry may open one more."""
    k = 0
    while k < len(waiting):
        while len(waiting[k]) > 1:
            a, b = waiting[k][:2]
            waiting[k] = [a ^ b, *waiting[k][2:]]
            _add(waiting, k + 1, a & b)
        k += 1
    return [w[0] if w else None for w in waiting]


def _at_least(planes: list[np.ndarray | None], least: int) -> np.ndarray:
    """Where the number in the bit planes is at least ``least`` (compared from the highest plane down)."""
    shape = next(p for p in planes if p is not None)
    more, same = np.zeros_like(shape), np.full_like(shape, np.iinfo(np.uint64).max)
    for k in reversed(range(max(len(planes), least.bit_length()))):
        plane = planes[k] if k < len(planes) and planes[k] is not None else np.zeros_like(shape)
        if least >> k & 1:
            same &= plane
        else:
            more |= same & plane
            same &= ~plane
    return more | same


def bases(dim: int = DIM, rotations: int = 0, seed: int = 7) -> np.ndarray:
    """Random orthogonal bases, as columns, by block; a few axes may be left out."""
    blocks = min(BLOCKS, dim)
    axes = min(AXES, dim // blocks)
    draws = np.random.default_rng(seed).standard_normal((rotations or ROTATIONS, dim, blocks * axes))
    return np.ascontiguousarray(np.linalg.qr(draws)[0].reshape(-1, dim, blocks, axes).transpose(0, 2, 1, 3).astype(np.float32))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest elements to at least 1/2 and under 1, in half precision where nothing is lost."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x
    half = x.astype(np.float16)
    return half if (half == x).all() else x


def _close(q: np.ndarray, i: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the ``k`` best of their query, by a similarity ``s`` that is right to 5 decimals at least.

    ``q`` is sorted. Only queries with many rows are looked at; for the others all rows stay.
    """
    stay = np.ones(len(q), bool)
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    for a, b in zip(starts, np.append(starts[1:], len(q))):
        if b - a > 64 and b - a > k:
            order = np.lexsort((-s[a:b], i[a:b]))
            first = order[np.append(True, np.diff(i[a:b][order]) != 0)]  # the best row of each id
            if len(first) > k:
                stay[a:b] = s[a:b] >= np.partition(s[a:b][first], -k)[-k] - 2e-5
    return stay


def search(index: CollisionIndex, queries: np.ndarray, queries64: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, similarity) of the up to ``k`` most similar vectors with at least ``least``."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(queries) if len(index.ids) else 0, QUERIES):
        some = slice(start, start + QUERIES)
        for q, v in index.candidates(queries[some], least - 1e-4):
            near = np.empty(len(q), np.float32)
            for at in range(0, len(q), BLOCK):
                near[at : at + BLOCK] = np.einsum("ij,ij->i", queries[q[at : at + BLOCK] + start], index.near(v[at : at + BLOCK]))
            hit = near > least - 1e-4
            q, v, near = q[hit] + start, v[hit], near[hit]
            stay = _close(q, index.ids[v], near, k)
            q, v = q[stay], v[stay]
            for at in range(0, len(q), BLOCK):
                row, of = q[at : at + BLOCK], v[at : at + BLOCK]
                s = np.einsum("ij,ij->i", queries64[row], unit64(index.stored[of]))
                keep = s >= least
                out.append((row[keep], index.ids[of[keep]], np.round(s[keep], 6)))
    q, i, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1]) | (s[1:] != s[:-1])]) if len(q) else np.zeros(0, bool)
    q, i, s = q[first], i[first], s[first]  # repeated rows of the collection count once
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], i[rank < k], s[rank < k]


def nearest(queries: DataFrame, collection: DataFrame, k: int = 3, least: float = 0.85, query_id: str = "id", collection_id: str = "id", column: str = "embedding", dim: int = DIM) -> DataFrame:
    """For every usable vector of ``queries`` its ``k`` most similar vectors of ``collection``.

    Returns query_id, neighbour_id (long), similarity (rounded to 6 decimals) and rank. Ties go to the smaller
    neighbour id; vectors under ``least`` do not come out. Repeated rows of either side count once. Unusable vectors
    (null, other lengths, nulls or non-finite values inside, all zero) on either side take no part; null ids
    neither; an empty side gives no rows.

    The collection is cut by a hash of its ids into parts of about ``PART_ROWS``; the index of every part is built once, by
    a task, and kept in the shared folder. A task holds the index of one part at a time and answers all its queries from it,
    so nothing is broadcast, and neither the driver nor a task ever holds the collection. Queries are read once for every
    part and never shuffled by key; where their files give few partitions they are spread over more. A search returns all
    pairs over the limit but for misses of the collisions (three in ten thousand right at 0.85, fewer above); with a limit
    below that more are missed. Of equal vectors of the collection only the ``k`` smallest ids can come out, and only these
    are indexed. Whatever shares a partition with a query, its rows are the same.
    """
    q = spread(sized(queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(column).alias("v")), "v", dim).filter("query_id is not null"))
    c = sized(collection.select(F.col(collection_id).cast("long").alias("neighbour_id"), F.col(column).alias("v")), "v", dim).filter("neighbour_id is not null").distinct()
    first = W.partitionBy("v").orderBy("neighbour_id")
    c = c.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_n")
    axes = bases(dim)

    def make(table: pa.Table) -> CollisionIndex:
        ids, stored = [np.zeros(0, np.int64)], [np.zeros((0, dim), np.float16)]
        for batch in table.to_batches(max_chunksize=BLOCK):
            _, good = matrix(batch.column("v"), dim)
            ids.append(batch.column("neighbour_id").to_numpy()[good])
            stored.append(_scaled(raw(batch.column("v"), good, dim).astype(np.float32)))
        ids, stored = np.concatenate(ids), np.concatenate(stored)
        order = np.argsort(ids, kind="stable")
        return CollisionIndex(ids[order], stored[order], axes)

    folder, parts = store(checkpoint(c), "neighbour_id", PART_ROWS, make)
    schema = "query_id long, neighbour_id long, similarity double, rank int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = load(folder, batch.column(2)[0].as_py()) if batch.num_rows else None
            if held is None:
                continue
            unit, good = matrix(batch.column(1), dim)
            if not len(good):
                continue
            row, found, similarity = search(held, unit, unit64(raw(batch.column(1), good, dim)), k, least)
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            ids = batch.column(0).to_numpy()[good][row]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(similarity), pa.array(rank, pa.int32())], ["query_id", "neighbour_id", "similarity", "rank"])

    # one scan for every part; a task has one part only
    found = reduce(DataFrame.unionByName, (q.withColumn("part", F.lit(p)).mapInArrow(run, schema) for p in range(parts))).distinct()
    if parts > 1:
        best = W.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found
