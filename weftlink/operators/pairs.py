"""Pair sets: neighbours rolled up over views, routes united, negatives capped, labels joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSICAL = ("classical_evidence", "classical_route_count", "classical_shared_keys", "classical_best_df")
KEYS = ["s1_id", "target_id", "source", "country"]


def roll_up_views(ann: DataFrame, views: tuple[str, ...] = ("name", "address", "combined")) -> DataFrame:
    """Best score, best rank, number of views and the best score of each view of a pair."""
    by_view = [F.max(F.when(F.col("ann_view") == v, F.col("ann_score"))).alias(f"retrieval_ann_{v}_score") for v in views]
    return ann.groupBy("s1_id", "target_id", "source", "country").agg(F.max("ann_score").alias("retrieval_ann_best_score"), F.min("ann_rank").alias("retrieval_ann_best_rank"), F.count_distinct("ann_view").alias("retrieval_ann_view_count"), *by_view)


def retrieval_priority(evidence: str = "classical_evidence", score: str = "retrieval_ann_best_score"):
    """The better of the best score (-1 without one) and the evidence as a share of 5, within 0 and 1."""
    part = F.least(F.greatest(F.coalesce(F.col(evidence), F.lit(0.0)) / 5.0, F.lit(0.0)), F.lit(1.0))
    return F.greatest(F.coalesce(F.col(score), F.lit(-1.0)), part)


def unite_routes(classical: DataFrame, ann: DataFrame) -> DataFrame:
    """Full outer union of both routes by pair, with the priority."""
    return classical.join(ann, KEYS, "full").withColumn("retrieval_priority", retrieval_priority())


def force_truth(pairs: DataFrame, links: DataFrame, s1: DataFrame, partitions: tuple[str, ...] = ("train",)) -> DataFrame:
    """Adds known links that no route found, for S1 records of the given partitions; country from S1.

    ``s1`` has s1_id, country, split. Pairs get is_match and validation_split.
    """
    forced = links.join(s1.where(F.col("split").isin(*partitions)).select("s1_id"), "s1_id").select("s1_id", "target_id", "source")
    out = pairs.drop("country", "is_match", "validation_split").join(forced, ["s1_id", "target_id", "source"], "full")
    out = out.join(links.select("s1_id", "target_id", F.lit(True).alias("m")), ["s1_id", "target_id"], "left").withColumn("is_match", F.coalesce("m", F.lit(False))).drop("m")
    return out.join(s1.select("s1_id", "country", F.col("split").alias("validation_split")), "s1_id", "left")


def with_country(pairs: DataFrame) -> DataFrame:
    """``pairs``, of which one without a country (an unknown S1 record) ends the query with an error."""
    missing = F.raise_error(F.concat(F.lit("missing S1 country of "), F.col("s1_id")))
    return pairs.withColumn("country", F.when(F.col("country").isNull(), missing).otherwise(F.col("country")))


def cap_negatives(pairs: DataFrame, cap: int) -> DataFrame:
    """All positives and, of each S1 record and source, the ``cap`` negatives of highest priority (ties by target)."""
    order = Window.partitionBy("s1_id", "source").orderBy(F.desc_nulls_last("retrieval_priority"), F.asc("target_id"))
    negatives = pairs.where("NOT is_match").withColumn("negative_rank", F.row_number().over(order)).where(F.col("negative_rank") <= cap)
    return pairs.where("is_match").unionByName(negatives, allowMissingColumns=True)


def cap_candidates(pairs: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` pairs of highest priority of each S1 record and source, labelled or not."""
    order = Window.partitionBy("s1_id", "source").orderBy(F.desc_nulls_last("retrieval_priority"), F.asc("target_id"))
    return pairs.withColumn("candidate_rank", F.row_number().over(order)).where(F.col("candidate_rank") <= cap)
