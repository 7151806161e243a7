"""Queries of the operators in this package, over the tables of a library directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm import clusters, leaks, mixing, moderation, names, neighbours, pairs, topn
from cinelake.plans.scratch import checkpoint
from cinelake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """The three most similar reference faces of every detection, with similarity and rank."""
    found = neighbours.nearest(table(spark, directory, "video_face_detections"), table(spark, directory, "creator_face_embeddings"))
    return found.select(F.col("query_id").alias("detection_id"), F.col("neighbour_id").alias("face_id"), "similarity", "rank")


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return p1_neighbours(spark, directory).select("detection_id", "face_id")


def p2_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Every pair of tags and creators with at least five common videos, with its counts and lift."""
    tag = table(spark, directory, "video_tags").select("video_id", (F.col("tag_id").cast("long") * 2).alias("item"))
    creator = table(spark, directory, "video_creators").select("video_id", (F.col("creator_id").cast("long") * 2 + 1).alias("item"))
    found = pairs.together(tag.unionByName(creator), "video_id", "item", least=5)  # numbers are counted, names made for what comes out

    def named(c: str) -> Column:
        return F.when(F.pmod(F.col(c), F.lit(2)) == 0, F.concat(F.lit("t"), F.expr(f"{c} div 2"))).otherwise(F.concat(F.lit("c"), F.expr(f"({c} - 1) div 2")))

    ends = F.array_sort(F.array(F.struct(named("item_a").alias("item"), F.col("n_a").alias("n")), F.struct(named("item_b").alias("item"), F.col("n_b").alias("n"))))
    return found.withColumn("e", ends).select(F.col("e")[0]["item"].alias("item_a"), F.col("e")[1]["item"].alias("item_b"), "n_both", F.col("e")[0]["n"].alias("n_a"), F.col("e")[1]["n"].alias("n_b"), "baskets", "lift")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return p2_pairs(spark, directory).filter(F.col("n_both") * F.col("baskets") >= 4 * F.col("n_a") * F.col("n_b")).select("item_a", "item_b")


def _unsettled(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "video_face_detections").select("id", "embedding", "match_status")
    return rows.filter(F.lower(F.trim("match_status")).isin("pending", "no_match")).select("id", "embedding")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return clusters.groups(_unsettled(spark, directory)).select("group_id", F.col("member_id").alias("detection_id"))


def p3_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Every group of three or more unsettled detections with its size and its three most typical members."""
    rows = _unsettled(spark, directory)
    return clusters.describe(rows, clusters.groups(rows)).withColumnRenamed("member_id", "detection_id")


_NAMED = (("creator", "creators", "person"), ("studio", "studios", "organisation"))


def p4_entities(spark: SparkSession, directory: str) -> DataFrame:
    """The entity of every creator and studio whose name is a variant of another's, named by its smallest id, and the rarity that links it."""
    return names.link([(kind, table(spark, directory, t), how) for kind, t, how in _NAMED])[0]


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return names.pairs(p4_entities(spark, directory))


def p6_top(spark: SparkSession, directory: str) -> DataFrame:
    """The three best detections of every video with score and rank."""
    best = topn.top_n(table(spark, directory, "video_face_detections"), 3, "video_id", "det_score", "id", "timestamp_seconds", 0.0, 1.0)
    return best.select(F.col("group_id").alias("video_id"), F.col("item_id").alias("detection_id"), F.col("score").alias("det_score"), "rank")


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return p6_top(spark, directory).select("video_id", "detection_id")


def p6_skips(spark: SparkSession, directory: str) -> DataFrame:
    """Row groups read and passed over for the three best detections of every video."""
    path = topn.cluster(table(spark, directory, "video_face_detections"), "video_id", "det_score", "id", "timestamp_seconds", 0.0, 1.0)
    return topn.skips(spark, path, 3)


def p8_passages(spark: SparkSession, directory: str) -> DataFrame:
    """Every passage of an evaluation item in a document, with its place in folded words and its score."""
    return leaks.leaks(table(spark, directory, "documents"), table(spark, directory, "eval_items"))


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return p8_passages(spark, directory).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, directory: str) -> DataFrame:
    """Spans of documents to remove."""
    return leaks.removal_spans(p8_passages(spark, directory))


def _mix(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    source = mixing.source_key(F.col("source")).alias("source")
    sized = checkpoint(mixing.tokens(table(spark, directory, "documents"), "doc_id", "text", [source]))
    return sized, checkpoint(mixing.rates(sized, table(spark, directory, "mix_targets")))


def p9_selection(spark: SparkSession, directory: str) -> DataFrame:
    """Every document used, with its tokens and how often it is used."""
    return mixing.select(*_mix(spark, directory)).withColumnRenamed("id", "doc_id")


def p9_report(spark: SparkSession, directory: str) -> DataFrame:
    """Target and reached share of every source with a target."""
    sized, rate = _mix(spark, directory)
    return mixing.report(mixing.select(sized, rate), rate)


def _moderated(spark: SparkSession, directory: str) -> DataFrame:
    source = mixing.source_key(F.col("source")).alias("source")
    return moderation.scores(table(spark, directory, "documents"), keep=(source,), samples=table(spark, directory, "moderation_samples")).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    return _moderated(spark, directory).filter("flagged").select("doc_id").distinct()


def p10_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Score, worst sentence and kind of every document."""
    return _moderated(spark, directory)


def p10_rates(spark: SparkSession, directory: str) -> DataFrame:
    """Documents to be reviewed and their rate, by source."""
    return moderation.rates(_moderated(spark, directory), "source")


_ALL = (
    p1_found, p1_neighbours, p2_found, p2_pairs, p3_found, p3_groups, p4_found, p4_entities, p6_found, p6_top, p6_skips,
    p8_found, p8_passages, p8_spans, p9_selection, p9_report, p10_found, p10_scores, p10_rates,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
