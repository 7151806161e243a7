"""Top N items within every group, by statistics-guided skipping.

The rows are clustered by group into Parquet files of small row groups, best scores first within a group. A task
then reads the row groups of a file in descending order of their maximum score, as their statistics tell, and
passes over those whose maximum is strictly below the current N-th score of every group they contain. Groups with
very many rows are clustered in several files, and their partial results are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.plans.scratch import new_path

#: Rows of a group in one file; larger groups are spread over several. Rows of a row group.
GROUP_ROWS, ROW_GROUP_ROWS = 50_000, 1_000


def _scan(path: str, n: int) -> tuple[pa.Table, int, int]:
    """Up to ``n`` best rows of each group of one clustered file; row groups read and passed over."""
    where, inside = fs.FileSystem.from_uri(path)
    with where.open_input_file(inside) as source:
        file = pq.ParquetFile(source)
        meta, names = file.metadata, file.schema_arrow.names
        at = {name: names.index(name) for name in ("g", "score")}
        ranges = []
        for i in range(meta.num_row_groups):
            g, s = (meta.row_group(i).column(at[c]).statistics for c in ("g", "score"))
            known = g is not None and s is not None and g.has_min_max and s.has_min_max
            ranges.append((s.max, g.min, g.max, i) if known else (np.inf, -(2**63), 2**63 - 1, i))
        ranges.sort(key=lambda r: (-r[0], r[3]))
        best: pa.Table | None = None
        groups, nth, read = np.zeros(0, np.int64), np.zeros(0), 0
        for top, low, high, i in ranges:
            if len(groups) and top < nth.max():  # worth asking which groups it holds: from its statistics, or from the one column of its groups
                held = np.array([low]) if low == high else np.unique(file.read_row_group(i, ["g"])["g"].to_numpy())
                at_ = np.searchsorted(groups, held).clip(max=len(groups) - 1)
                if (groups[at_] == held).all() and (top < nth[at_]).all():
                    continue
            read += 1
            rows = file.read_row_group(i)
            best = _best(rows if best is None else pa.concat_tables([best, rows]), n)
            g = best["g"].to_numpy()
            last = np.flatnonzero(np.append(g[1:] != g[:-1], True))
            first = np.append(0, last[:-1] + 1)
            groups = g[last]
            nth = np.where(last - first + 1 >= n, best["score"].to_numpy()[last], -np.inf)
        return best if best is not None else file.schema_arrow.empty_table(), read, meta.num_row_groups - read


def _best(rows: pa.Table, n: int) -> pa.Table:
    """Up to ``n`` rows of each group, in order; repeated rows (of equal id) count once."""
    rows = rows.take(pc.sort_indices(rows, [("g", "ascending"), ("score", "descending"), ("tie", "ascending"), ("id", "ascending")]))
    g, i = rows["g"].to_numpy(), rows["id"].to_numpy()
    fresh = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])))[: len(g)] if len(g) else np.zeros(0, np.int64)
    g = g[fresh]
    rank = np.arange(len(g)) - np.searchsorted(g, g)
    return rows.take(pa.array(fresh[rank < n]))


def cluster(df: DataFrame, group: str, score: str, id: str, tie: str | None = None, low: float | None = None, high: float | None = None) -> str:
    """The path of the rows of ``df`` clustered for ``top_of``: written once, asked as often as wanted; see ``top_n`` for which rows take part."""
    spark = df.sparkSession
    value = F.col(score).cast("double")
    valid = value.isNotNull() & ~F.isnan(value) & F.col(group).isNotNull() & F.col(id).isNotNull()
    if low is not None:
        valid &= value >= low
    if high is not None:
        valid &= value <= high
    last = F.lit(float("inf")) if tie is None else F.coalesce(F.col(tie).cast("double"), F.lit(float("inf")))
    rows = df.filter(valid).select(F.col(group).cast("long").alias("g"), value.alias("score"), last.alias("tie"), F.col(id).cast("long").alias("id"))
    large = rows.groupBy("g").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > GROUP_ROWS).select("g", F.ceil(F.col("rows") / GROUP_ROWS).alias("files"))
    salted = rows.join(large, "g", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("files", F.lit(1))))
    path = new_path(spark, "clustered")
    clustered = salted.repartition("g", "salt").sortWithinPartitions("g", F.desc("score"), "tie", "id").select("g", "score", "tie", "id")
    clustered.write.option("parquet.block.row.count.limit", ROW_GROUP_ROWS).parquet(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return listed.repartition(max(1, min(spark.sparkContext.defaultParallelism * 2, 1000)))


def top_of(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(group_id, item_id, score, rank) from clustered rows; row groups are passed over as their statistics allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                best, _, _ = _scan(name, n)
                yield from best.select(["g", "score", "tie", "id"]).to_batches(max_chunksize=10_000)

    best = W.partitionBy("g").orderBy(F.desc("score"), "tie", "id")
    parts = _files(spark, path).mapInArrow(run, "g long, score double, tie double, id long")
    return parts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select(F.col("g").alias("group_id"), F.col("id").alias("item_id"), "score", "rank")


def skips(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(read, passed_over): row groups that ``top_of`` reads and passes over, of all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [_scan(name, n)[1:] for name in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)], ["read", "passed_over"])

    zero = F.lit(0)
    return _files(spark, path).mapInArrow(run, "read long, passed_over long").agg(F.coalesce(F.sum("read"), zero).alias("read"), F.coalesce(F.sum("passed_over"), zero).alias("passed_over"))


def top_n(df: DataFrame, n: int, group: str, score: str, id: str, tie: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """(group_id, item_id, score, rank): the first ``n`` rows of every group by score descending, tie ascending, id ascending.

    group and id are integers, score and tie numbers. Scores that are null, NaN or outside [low, high], null
    groups and null ids take no part; a null tie comes after all others. Repeated rows count once. Groups with
    fewer rows give what they have; an empty table gives no rows. The rows are clustered first; where a table is asked more
    than once keep what ``cluster`` writes and ask ``top_of``. For a single question over rows that are read anyway a ranking
    window, of which Spark keeps the first rows only, would do with less writing.
    """
    return top_of(df.sparkSession, cluster(df, group, score, id, tie, low, high), n)
