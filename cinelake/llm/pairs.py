"""Items that appear together in baskets, with large baskets split into blocks.

A basket of more than ``chunk`` items is cut into item chunks, and each pair of its chunks becomes a unit of work
of its own; an ordinary basket is one unit. The pairs of all units are then counted alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.plans.skew import salted_join

#: Items of a basket up to which it is one unit of work; larger baskets are cut into chunks of about half of it.
CHUNK = 256


def together(df: DataFrame, basket: str, item: str, least: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Association of every pair of items in at least ``least`` common baskets.

    ``item`` may be of any ordered type. Returns item_a < item_b, n_both, n_a, n_b, baskets (the number of baskets
    with any item) and lift = n_both * baskets / (n_a * n_b), how many times the pair exceeds chance.
    Repeated rows count once; rows with a null basket or item take no part. No rows give no pairs.

    Items in fewer than ``least`` baskets cannot reach it and are left out before pairs are made; an item that very many
    baskets have is split where its rows meet its count. No task ever
    holds more than two chunks of a basket, and pair counts are combined before they are shuffled.
    """
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).filter("basket is not null and item is not null").distinct()
    baskets = rows.agg(F.countDistinct("basket").alias("baskets"))  # one row
    often = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    kept = salted_join(rows, often.select("item"), ["item"], often, F.col("basket"))
    size = kept.groupBy("basket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    parts = F.when(F.col("size") <= chunk, 1).otherwise(F.ceil(F.col("size") * 2 / chunk)).cast("long")
    cut = kept.join(size, "basket").select("basket", "item", parts.alias("parts")).withColumn("mine", F.pmod(F.xxhash64("item"), F.col("parts")))
    units = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    units = units.select("basket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "item")
    lists = units.groupBy("basket", "i", "j").agg(
        F.collect_list(F.when(F.col("mine") == F.col("i"), F.col("item"))).alias("x"),
        F.collect_list(F.when(F.col("mine") == F.col("j"), F.col("item"))).alias("y"),
    )
    pairs = lists.withColumn("a", F.explode("x")).withColumn("b", F.explode("y")).filter("i <> j or a < b")
    counts = pairs.groupBy(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b")).agg(F.count(F.lit(1)).alias("n_both")).filter(F.col("n_both") >= least)
    out = counts.join(often.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a").join(often.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
    out = out.crossJoin(F.broadcast(baskets))
    lift = F.col("n_both").cast("double") * F.col("baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select("item_a", "item_b", "n_both", "n_a", "n_b", "baskets", lift.alias("lift"))
