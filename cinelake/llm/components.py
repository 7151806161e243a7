"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.plans.scratch import checkpoint, release


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component) of every id in ``edges``; a component is named by its smallest id.

    Alternating large-star and small-star steps: each keeps connectivity and moves edges towards the smallest
    id of a component, in a number of rounds logarithmic in its size. A round costs two aggregations with
    map-side combination and two joins, whose hot keys adaptive execution splits; every round is a written table, and that of the round before is released.
    Edges with a null end or from an id to itself link nothing; no edges give no rows.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    now = checkpoint(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a is not null and b is not null and a <> b and isnotnull(a + b)").distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        before, now, last = now, checkpoint(small), state
        release(before)
        state = _state(now)
        if state == last:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
