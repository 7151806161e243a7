"""Grouping records into clusters of mutually similar records.

Vectors are turned into hashed weighted features, distributed k-means with parallel oversampled seeding divides
the feature space into cells, and similar pairs are looked for inside the cells only, each vector taking part in
its few nearest cells. Links are verified by the true cosine similarity; a cluster is a connected component of
the verified links, and its most typical members are those nearest to its centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.llm.components import components
from cinelake.llm.vectors import DIM, matrix, raw, sized, unit64
from cinelake.plans.scratch import checkpoint
from cinelake.plans.skew import salted_join

BUCKETS = 4096
#: Rows aimed at in a cell, and rows beyond which a cell is split into blocks.
CELL, SPLIT = 512, 6_000
#: A vector takes part in this many nearest cells, and in up to so many that are hardly farther than the nearest: a vector
#: near its centroid finds its like there, one far from all centroids needs more cells.
COPIES, MOST_COPIES, HARDLY = 2, 6, 0.1
#: Units that links between equal vectors are spread over, one for so many rows and at least so many; they need no comparing,
#: and one vector may have very many.
REPEAT_ROWS, LEAST_REPEATS = 20_000, 256
#: A unit of work is a cell, or a pair of its blocks: bits of a block's number in the unit's key.
BLOCK_BITS = 20
#: Bounds of the fit: cells (a broadcast of at most 8 MB) and rows of the sample that centroids are fitted on.
MOST_CELLS, SAMPLE_PER_CELL, MOST_SAMPLE = 32_768, 48, 262_144
ROUNDS = 3
#: Centroids this alike are one; equal ones would fill up the nearest cells of a vector.
EQUAL = 1 - 1e-6
#: Distinct vectors a task of the placing has at least.
LEAST_PLACED = 2_000
#: Similarities of vectors to centroids that a task holds at a time (16 MB), however many cells there are.
SCORES = 1 << 22


def feature_axes(names: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """The matrix that takes weights of named features to signed hash buckets; buckets nothing falls into are left out."""
    out = np.zeros((len(names), buckets), np.float32)
    for row, name in enumerate(names):
        h = xxhash.xxh64_intdigest(name)
        out[row, h % buckets] += 1.0 if h >> 63 else -1.0
    return out[:, np.abs(out).sum(axis=0) > 0]


def pack(vectors: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Vectors as bytes, in half precision where that loses nothing; and where it does not."""
    with np.errstate(over="ignore"):
        half = vectors.astype(np.float16)
    short = (half == vectors).all(axis=1)
    full = vectors.astype(np.float32)
    return [half[i].tobytes() if short[i] else full[i].tobytes() for i in range(len(vectors))], short


def unpack(payload: pa.Array, dim: int = DIM) -> np.ndarray:
    """Unit vectors of packed ones."""
    rows = payload.to_pylist()
    size = np.fromiter((len(x) for x in rows), np.int64, len(rows))
    out = np.empty((len(rows), dim), np.float64)
    for width, kind in ((2 * dim, np.float16), (4 * dim, np.float32)):
        at = np.flatnonzero(size == width)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(-1, dim)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return (out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]).astype(np.float32)


def _scores(x: np.ndarray, centres: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The similarities of rows of ``x`` to all centroids, about ``SCORES`` at a time."""
    step = max(1, SCORES // max(1, len(centres)))
    for at in range(0, len(x), step):
        yield slice(at, at + step), x[at : at + step] @ centres.T


def _best(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row, and its similarity."""
    cell, near = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    for some, s in _scores(x, centres):
        cell[some] = s.argmax(axis=1)
        near[some] = s[np.arange(len(s)), cell[some]]
    return cell, near


def _cells(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the ``COPIES`` nearest cells of every row and those hardly farther than the nearest, ``MOST_COPIES`` at most."""
    rows, cells = [], []
    for some, s in _scores(x, centres):
        row = np.arange(len(s))
        for copy in range(min(COPIES, len(centres))):
            cell = s.argmax(axis=1)
            if not copy:
                least = s[row, cell] - np.float32(HARDLY)
            s[row, cell] = -np.inf
            rows.append(row + some.start), cells.append(cell)
        r, c = np.nonzero(s >= least[:, None])
        order = np.lexsort((-s[r, c], r))
        r, c = r[order], c[order]
        taken = np.arange(len(r)) - np.searchsorted(r, r) < MOST_COPIES - COPIES
        rows.append(r[taken] + some.start), cells.append(c[taken])
    return np.concatenate(rows), np.concatenate(cells)


def _apart(centres: np.ndarray) -> np.ndarray:
    """The rows of ``centres`` that no earlier one equals."""
    kept = np.ones(len(centres), bool)
    for at in range(0, len(centres), 1024):
        s = centres[at : at + 1024] @ centres[: at + 1024].T >= EQUAL
        kept[at : at + 1024] = ~np.tril(s, at - 1).any(axis=1)
    return np.flatnonzero(kept)


def fit_cells(rows: DataFrame, n: int, dim: int, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids in feature space and the estimated rows of each cell.

    ``rows`` has id and v, ``n`` is about the number of different vectors. The fit sees a hash sample of these, each once
    however many rows have it, of at most ``MOST_SAMPLE`` (``SAMPLE_PER_CELL`` for each cell). Seeds: half drawn evenly, so that dense regions get cells in proportion; half in parallel rounds
    with a chance proportional to the squared distance from the nearest seed so far (the rows with the
    smallest exponential draws over their distance, merged from all tasks). Then ``ROUNDS`` rounds of k-means. Equal
    centroids count once, among the seeds and in the end.
    """
    k = int(min(MOST_CELLS, max(1, -(-n // CELL))))
    if k == 1:
        return np.zeros((1, axes.shape[1]), np.float32), np.array([n])
    spark, want = rows.sparkSession, min(MOST_SAMPLE, SAMPLE_PER_CELL * k)
    part = min(1.0, want / n)
    sample = rows.filter(F.pmod(F.xxhash64("v", F.lit("fit")), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    sample = sample.groupBy("v").agg(F.min("id").alias("id")).select("id", "v").persist(StorageLevel.DISK_ONLY)

    def draw(centres: np.ndarray | None, many: int, seed: int) -> np.ndarray:
        sent = spark.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                unit, good = matrix(batch.column(1), dim)
                if not len(good):
                    continue
                x, ids = _unit(unit @ axes), batch.column(0).to_numpy()[good]
                far = np.ones(len(x)) if sent.value is None else np.maximum(1e-9, 1 - _best(x, sent.value)[1])
                u = np.array([(xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), seed) + 1) / 2**64 for i in ids])
                key = -np.log(u) / far
                best = np.argsort(key, kind="stable")[:many]
                yield pa.RecordBatch.from_arrays([pa.array(key[best]), pa.array(list(x[best]), pa.list_(pa.float32()))], ["key", "x"])

        got = sample.mapInArrow(run, "key double, x array<float>").orderBy("key").limit(many).toArrow()["x"].combine_chunks()
        return got.flatten().to_numpy().reshape(-1, axes.shape[1])

    centres = draw(None, k - k // 2, 1)
    for step in range(2):
        centres = np.concatenate([centres, draw(centres, k // 4 + (k // 2) % 2 * step, 2 + step)])
    centres = centres[_apart(centres)]
    size = np.zeros(len(centres))
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _unit(matrix(batch.column(1), dim)[0] @ axes)
                if not len(x):
                    continue
                cell = _best(x, sent.value)[0]
                order = np.argsort(cell, kind="stable")
                there, first = np.unique(cell[order], return_index=True)
                total = np.add.reduceat(x[order], first, axis=0)
                count = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(count, pa.int64()), pa.array(list(total), pa.list_(pa.float32()))], ["cell", "n", "x"])

        def mean(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
            total = part["x"].combine_chunks().flatten().to_numpy().reshape(-1, axes.shape[1]).sum(axis=0)
            return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([sum(part["n"].to_pylist())], pa.int64()), "x": pa.array([total], pa.list_(pa.float32()))})

        schema = "cell int, n long, x array<float>"
        got = sample.mapInArrow(assign, schema).groupBy("cell").applyInArrow(mean, schema).toArrow()
        at = got["cell"].to_numpy()
        centres, size = centres.copy(), np.zeros(len(centres))
        centres[at] = _unit(got["x"].combine_chunks().flatten().to_numpy().reshape(-1, axes.shape[1]))
        size[at] = got["n"].to_numpy()
    sample.unpersist()
    kept = _apart(centres)
    size = np.bincount(_best(centres, centres[kept])[0], size, len(kept)) if len(kept) < len(centres) else size
    return centres[kept], size * (n / max(1.0, size.sum()))


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Ids spread evenly over 64 bits."""
    x = ids.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _local(vectors: np.ndarray, least: float) -> np.ndarray:
    """The smallest row of the component of every row; memory stays bounded however many pairs are alike."""
    n = len(vectors)
    label = np.arange(n)
    for at in range(0, n, 512):
        r, c = np.nonzero(vectors[at : at + 512] @ vectors[at:].T >= least)
        u, v = label[r + at], label[c + at]
        differ = u != v
        if not differ.any():
            continue
        pairs = np.unique(u[differ] * np.int64(n) + v[differ])
        u, v = pairs // n, pairs % n
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        while (label[label] != label).any():
            label = label[label]
    return label


def links(rows: DataFrame, least: float = 0.85, dim: int = DIM) -> DataFrame:
    """(a, b) edges, a > b, whose connected components are those of all pairs with cosine similarity ``least`` or more.

    ``rows``: id long, v array. Equal vectors are brought together first, those of a batch before the shuffle; one of
    them takes part and the others are linked to it. It goes to its nearest cells; a cell's task links its rows
    blockwise and returns stars only, never pairs. Cells with more than ``SPLIT`` estimated rows are split into
    blocks, and every pair of blocks is a task of its own.
    """
    rows = rows.select("id", "v")
    n = rows.agg(F.approx_count_distinct(F.xxhash64("v"), 0.02)).first()[0]
    axes = feature_axes([f"v{j}" for j in range(dim)])
    centres, size = fit_cells(rows, n, dim, axes)
    blocks = np.minimum((1 << BLOCK_BITS) - 1, np.maximum(1, np.ceil(size / SPLIT))).astype(np.int64)
    repeats = max(LEAST_REPEATS, rows.count() // REPEAT_ROWS)
    sent = rows.sparkSession.sparkContext.broadcast((centres, blocks))

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            good = matrix(batch.column(1), dim)[1]
            ids = batch.column(0).to_numpy()[good]
            payload, _ = pack(raw(batch.column(1), good, dim))
            seen: dict[bytes, int] = {}
            rep = np.fromiter((seen.setdefault(p, i) for i, p in enumerate(payload)), np.int64, len(payload))
            here = np.flatnonzero(rep == np.arange(len(rep)))
            again = np.flatnonzero((rep != np.arange(len(rep))) & (ids != ids[rep]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[here], ids[again]])), pa.array([None] * len(here) + ids[rep[again]].tolist(), pa.int64()), pa.array([payload[i] for i in here] + [None] * len(again), pa.binary())],
                ["id", "same_as", "v"],
            )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, blocks = sent.value
        last, first = None, 0  # the vector of the row before and the first id that has it
        for batch in batches:
            ids, same_as, payload = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            here = []
            for i, p in enumerate(payload):
                if p is None:
                    continue
                if p == last:
                    same_as[i] = first
                else:
                    last, first = p, int(ids[i])
                    here.append(i)
            again = [i for i, x in enumerate(same_as) if x is not None and x != ids[i]]
            vectors = batch.column(2)
            here = np.array(here, np.int64)
            key = who = np.zeros(0, np.int64)
            if len(here):
                x = _unit(unpack(vectors.take(pa.array(here)), dim) @ axes)
                who, cell = _cells(x, centres)
                who = here[who]
                many = blocks[cell]
                mine = (_mixed(ids[who]) % many.astype(np.uint64)).astype(np.int64)  # the block of a row in its cell; it meets each of the cell's blocks
                other = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                mine, cell, who = np.repeat(mine, many), np.repeat(cell, many), np.repeat(who, many)
                key = (cell << (2 * BLOCK_BITS)) + (np.minimum(mine, other) << BLOCK_BITS) + np.maximum(mine, other)
            key = np.concatenate([key, -1 - ids[again] % repeats]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(np.concatenate([ids[who], ids[again]])), pa.array([None] * len(who) + [same_as[i] for i in again], pa.int64()), pa.concat_arrays([vectors.take(pa.array(who)), pa.nulls(len(again), pa.binary())])],
                ["cell", "id", "same_as", "v"],
            )

    def link(part: pa.Table) -> pa.Table:
        same = part.filter(pc.is_valid(part["same_as"]))
        part = part.filter(pc.is_null(part["same_as"]))
        ids, first = np.unique(part["id"].to_numpy(), return_index=True)
        label = _local(unpack(part["v"].take(pa.array(first)), dim), least) if len(ids) else np.zeros(0, np.int64)
        star = np.flatnonzero(label != np.arange(len(ids)))
        x, y = np.concatenate([ids[star], same["id"].to_numpy()]), np.concatenate([ids[label[star]], same["same_as"].to_numpy()])
        return pa.table({"a": pa.array(np.maximum(x, y), pa.int64()), "b": pa.array(np.minimum(x, y), pa.int64())})

    tasks = max(1, min(-(-n // LEAST_PLACED), max(3 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())))
    once = rows.mapInArrow(bring, "id long, same_as long, v binary").repartition(tasks, "v", "same_as").sortWithinPartitions("v", "id")
    return once.mapInArrow(place, "cell long, id long, same_as long, v binary").groupBy("cell").applyInArrow(link, "a long, b long")


def groups(df: DataFrame, least: float = 0.85, smallest: int = 3, id: str = "id", column: str = "embedding", dim: int = DIM) -> DataFrame:
    """(group_id, member_id, size): one row for each member of a group of at least ``smallest`` rows.

    Two rows are alike at a cosine similarity of ``least`` or more; a group is a largest set joined by chains of
    alike rows, named by its smallest id. Repeated rows count once. Null ids and unusable vectors (null, other
    lengths, nulls or non-finite values inside, all zero) belong to no group; an empty table gives no rows.
    """
    rows = sized(df.select(F.col(id).cast("long").alias("id"), F.col(column).alias("v")), "v", dim).filter("id is not null")
    of = components(links(rows, least, dim))
    size = of.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= smallest)
    return of.join(size, "component").select(F.col("component").alias("group_id"), F.col("id").alias("member_id"), "size")


def describe(df: DataFrame, members: DataFrame, typical: int = 3, id: str = "id", column: str = "embedding", dim: int = DIM) -> DataFrame:
    """(group_id, size, rank, member_id, similarity): the ``typical`` members nearest to each group's centroid.

    The centroid is the mean of the members' unit vectors; similarities are rounded to 6 decimals, ties go to the smaller id.
    Of several vectors of one id the smallest counts. Sums and best members are formed batch by batch before they are brought
    together by group, and very large groups are split where members meet their centroid, so no task holds a whole group.
    """
    rows = sized(df.select(F.col(id).cast("long").alias("member_id"), F.col(column).alias("v")), "v", dim).join(members, "member_id")
    rows = checkpoint(rows.groupBy("member_id").agg(F.min("v").alias("v"), F.first("group_id").alias("group_id"), F.first("size").alias("size")))
    sums = [f"s{j}" for j in range(dim)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = matrix(batch.column(1), dim)[1] if batch.num_rows else ()
            if len(good):
                unit = unit64(raw(batch.column(1), good, dim))
                group = batch.column(0).to_numpy()[good]
                order = np.argsort(group, kind="stable")
                there, first = np.unique(group[order], return_index=True)
                total = np.add.reduceat(unit[order], first, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(there), *(pa.array(total[:, j]) for j in range(dim))], ["group_id", *sums])

    part = rows.select("group_id", "v").mapInArrow(add, "group_id long, " + ", ".join(f"{s} double" for s in sums))
    centre = part.groupBy("group_id").agg(*(F.sum(s).alias(s) for s in sums)).select("group_id", F.array(*sums).alias("c"))
    counts = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    met = salted_join(rows, centre, ["group_id"], counts, F.col("member_id")).select("group_id", "size", "member_id", "v", "c")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = matrix(batch.column(3), dim)[1] if batch.num_rows else ()
            if not len(good):
                continue
            unit = unit64(raw(batch.column(3), good, dim))
            group, size, member = (batch.column(c).to_numpy()[good] for c in range(3))
            c = batch.column(4).flatten().to_numpy().reshape(-1, dim)[good]
            near = np.round(np.einsum("ij,ij->i", unit, c) / np.maximum(np.sqrt(np.einsum("ij,ij->i", c, c)), 1e-300), 6)
            order = np.lexsort((member, -near, group))
            group, size, member, near = group[order], size[order], member[order], near[order]
            best = np.arange(len(group)) - np.searchsorted(group, group) < typical
            yield pa.RecordBatch.from_arrays([pa.array(x[best]) for x in (group, size, member, near)], ["group_id", "size", "member_id", "similarity"])

    some = met.mapInArrow(nearest, "group_id long, size long, member_id long, similarity double")
    best = W.partitionBy("group_id").orderBy(F.desc("similarity"), "member_id")
    return some.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= typical).select("group_id", "size", "rank", "member_id", "similarity")
