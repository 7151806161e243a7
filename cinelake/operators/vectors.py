"""Exact similarity search, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.plans.parts import load, store
from cinelake.plans.scratch import checkpoint

#: Vectors of the searched side in one part, which a task holds at a time.
PART_ROWS = 65_536


def _unit(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows of ``dim`` finite elements that are not all zero, and their row numbers."""
    rows = lists.to_pylist()
    good = [i for i, r in enumerate(rows) if r and len(r) == dim and None not in r]
    x = np.array([rows[i] for i in good], np.float64).reshape(len(good), dim)
    with np.errstate(all="ignore"):
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    fine = np.isfinite(x).all(axis=1)
    return x[fine], np.array(good, np.int64)[fine]


def top_k(queries: DataFrame, collection: DataFrame, k: int | None, least: float, dim: int, id: str = "id", column: str = "embedding", later_only: bool = False) -> DataFrame:
    """(query_id, match_id, similarity, rank): the k most similar rows of ``collection`` with at least ``least``, exactly.

    ``k`` None: all of them. Similarities are rounded to 6 decimals; ties go to the smaller id. ``later_only``: only matches of
    a greater id than the query's, for pairs within one table. Rows of other than ``dim`` elements, with nulls or non-finite
    ones inside or all zero, and null ids take no part; repeated ids count once. The collection is kept in parts of bounded
    size; a task holds one part at a time and compares it with each batch of queries as one matrix product.
    """
    some = lambda df: df.select(F.col(id).cast("long").alias("i"), F.col(column).alias("v")).filter(F.col("i").isNotNull() & (F.size("v") == dim))
    q, c = some(queries).distinct(), checkpoint(some(collection).groupBy("i").agg(F.max("v").alias("v")))

    def make(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        unit, good = _unit(table["v"], dim)
        return table["i"].to_numpy()[good], unit

    folder, parts = store(c, "i", PART_ROWS, make)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = load(folder, batch.column(2)[0].as_py()) if batch.num_rows else None
            if held is None or not len(held[0]):
                continue
            ids, other = held
            mine, good = _unit(batch.column(1), dim)
            own = batch.column(0).to_numpy()[good]
            for at in range(0, len(mine), 512):
                s = np.round(mine[at : at + 512] @ other.T, 6)
                r, j = np.nonzero((s >= least) & (ids > own[at : at + 512, None]) if later_only else s >= least)
                order = np.lexsort((ids[j], -s[r, j], r))
                r, j = r[order], j[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                keep = rank < k if k is not None else rank >= 0
                r, j, rank = r[keep], j[keep], rank[keep]
                yield pa.RecordBatch.from_arrays([pa.array(own[at + r]), pa.array(ids[j]), pa.array(s[r, j]), pa.array(rank + 1, pa.int32())], ["query_id", "match_id", "similarity", "rank"])

    found = reduce(DataFrame.unionByName, (q.withColumn("part", F.lit(p)).mapInArrow(run, "query_id long, match_id long, similarity double, rank int") for p in range(parts)))
    if parts > 1:
        w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")
        found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k if k is not None else F.lit(True))
    return found


def decide(matches: DataFrame, groups: DataFrame, creator: str, group: str, auto: float = 0.75) -> DataFrame:
    """(group, creator, detections, best, decision): best match of each detection, gathered by group and creator.

    ``matches``: query_id, similarity of the best match and its creator; ``groups``: query_id and its group. A group is
    tagged when its best similarity reaches ``auto``, else its detections stay pending.
    """
    rows = matches.filter("rank = 1").join(groups, "query_id")
    best = rows.groupBy(group, creator).agg(F.count(F.lit(1)).alias("detections"), F.max("similarity").alias("best"))
    return best.withColumn("decision", F.when(F.col("best") >= auto, "tag").otherwise("pending"))
