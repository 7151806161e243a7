"""References to records that do not exist.

Keys of parents and children are united in long form and grouped once by parent table and key; groups without a parent's
flag are orphans. Counts by period travel through the same grouping.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.plans.skew import salted_join


@dataclass(frozen=True)
class Reference:
    """``rows.key`` refers to ``parents.parent_key``; ``created`` dates a row for the counts by period."""

    table_name: str
    rows: DataFrame
    row_id: str
    key: str
    parent_name: str
    parents: DataFrame
    parent_key: str = "id"
    created: str | None = None


def _children(references: list[Reference]) -> DataFrame:
    def one(r: Reference) -> DataFrame:
        at = F.lit(None).cast("string") if r.created is None else F.date_format(F.col(r.created), "yyyy-MM")
        return r.rows.filter(F.col(r.key).isNotNull()).select(
            F.lit(r.table_name).alias("table_name"), F.lit(r.parent_name).alias("parent_name"), F.col(r.row_id).cast("long").alias("row_id"), F.col(r.key).cast("long").alias("key"), at.alias("month")
        )

    return reduce(DataFrame.unionByName, map(one, references))


def _parents(references: list[Reference]) -> DataFrame:
    once = {r.parent_name: r for r in references}
    keys = [r.parents.filter(F.col(r.parent_key).isNotNull()).select(F.lit(name).alias("parent_name"), F.col(r.parent_key).cast("long").alias("key")) for name, r in once.items()]
    return reduce(DataFrame.unionByName, keys)


def orphans(references: list[Reference]) -> DataFrame:
    """(table_name, row_id, key): the distinct rows whose key is in no row of the table it refers to.

    Null keys refer to nothing and are no case; a parent created later than the reference counts as there. Keys of
    all references are combined map-side and grouped once; rows are then picked by the orphan keys, where a key that
    very many rows share is split. Empty tables of children give no rows; an empty parent table makes every key an orphan.
    """
    rows = _children(references).select("table_name", "parent_name", "row_id", "key")
    tagged = rows.select("parent_name", "key", F.lit(0).alias("there"), F.lit(1).alias("n")).unionByName(_parents(references).select("parent_name", "key", F.lit(1).alias("there"), F.lit(0).alias("n")))
    lost = tagged.groupBy("parent_name", "key").agg(F.max("there").alias("there"), F.sum("n").alias("n")).filter("there = 0")
    found = salted_join(rows, lost.select("parent_name", "key"), ["parent_name", "key"], lost, F.col("row_id"), "left_semi")
    return found.select("table_name", "row_id", "key").distinct()


def orphan_counts(references: list[Reference]) -> DataFrame:
    """(table_name, month, orphans, references): orphan rows and all rows with a key, by table and month of ``created``.

    Repeated rows count once. Months without a row with a key have no line; rows without a date are under a null month.
    Rows are counted by key, table and month before keys meet, so a key has at most one row for a table and month there.
    """
    rows = _children(references).distinct().groupBy("parent_name", "key", "table_name", "month").agg(F.count(F.lit(1)).alias("n"))
    carried = F.struct("table_name", "month", "n")
    tagged = rows.select("parent_name", "key", F.lit(0).alias("there"), carried.alias("c"))
    tagged = tagged.unionByName(_parents(references).distinct().select("parent_name", "key", F.lit(1).alias("there"), F.lit(None).cast(tagged.schema["c"].dataType).alias("c")))
    met = tagged.groupBy("parent_name", "key").agg(F.max("there").alias("there"), F.collect_list("c").alias("c")).select("there", F.explode("c").alias("c"))
    n = F.col("c.n")
    return met.groupBy("c.table_name", "c.month").agg(F.sum(F.when(F.col("there") == 0, n).otherwise(0)).alias("orphans"), F.sum(n).alias("references"))
