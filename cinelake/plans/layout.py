"""Helpers that decide how rows are spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Below this estimated size a table is left in the partitions it was read in.
SPREAD_BYTES = 8 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """``df`` over at least ``per_core`` partitions for each core, where the file layout gives fewer.

    For compute-heavy narrow stages over few large row groups. Small inputs are left alone.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) < SPREAD_BYTES or df.rdd.getNumPartitions() * per_core >= 2 * want:
        return df
    return df.repartition(want)
