"""Joins on keys that very many rows share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key in one unit of work; a key with more is split into as many units as it takes.
HOT = 1_000_000


def salted_join(rows: DataFrame, table: DataFrame, on: Sequence[str], counts: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has at most one row for a key; keys of HOT rows or more are split by a hash of ``by``.

    ``counts`` has the keys and ``n``, the number of ``rows`` of each. What is sent to all tasks are the split keys only, at
    most one for every HOT rows; the row of such a key in ``table`` is repeated once for each part.
    """
    hot = F.broadcast(counts.filter(F.col("n") >= HOT).select(*on, F.ceil(F.col("n") / HOT).cast("long").alias("_parts")))  # at most one row in HOT
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    left = rows.join(hot, list(on), "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts)).drop("_parts")
    right = table.join(hot, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
