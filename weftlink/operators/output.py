"""Final matches: one S1 record a target, one row an S1 record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exclusive_matches(scored: DataFrame, threshold: float) -> DataFrame:
    """Pairs at or above the threshold, each target with its best S1 record (ties by the lower id)."""
    best = scored.where(F.col("score") >= threshold).groupBy("target_id").agg(F.max("score").alias("score"), F.min_by("s1_id", F.struct((-F.col("score")).alias("s"), "s1_id")).alias("s1_id"))
    return best.select("s1_id", "target_id", "score")


def grouped_output(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids) of every S1 record: distinct ids sorted in a comma list, "" without any."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias("ids"))
    out = entities.select("s1_id").distinct().join(lists, "s1_id", "left")
    return out.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))
