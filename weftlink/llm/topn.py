"""Problem 6: the top N items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_scores(df: DataFrame, group_col: str, item_col: str, score_col: str, at_col: str) -> DataFrame:
    """(group, item, score, at): of each pair only the row scored last.

    NULL and NaN scores are no score and become NULL. A row without a time counts as the earliest;
    of rows scored at one time the highest score counts. Pairs without group or item leave.
    """
    score = F.when(~F.isnan(score_col), F.col(score_col).cast("double"))
    rows = df.select(F.col(group_col).alias("group"), F.col(item_col).alias("item"), F.col(at_col).alias("at"), score.alias("score")).where("group IS NOT NULL AND item IS NOT NULL")
    last = rows.groupBy("group", "item").agg(F.max(F.struct("at", "score")).alias("m"))
    return last.select("group", "item", F.col("m.score").alias("score"), F.col("m.at").alias("at"))


def top_items(df: DataFrame, n: int, group_col: str, item_col: str, score_col: str, at_col: str) -> DataFrame:
    """(group, item, score, rank): the ``n`` items of highest latest score of each group.

    Equal scores go by item ascending. Repeated rows and earlier scores do not count, pairs whose
    latest row has no score are out, a group with fewer items gives what it has. The rank filter
    over row_number becomes a group limit that prunes before the shuffle as well as after it, so
    a group of any size sends at most ``n`` rows a task to the task that ranks it.
    """
    scored = latest_scores(df, group_col, item_col, score_col, at_col).where("score IS NOT NULL")
    order = Window.partitionBy("group").orderBy(F.col("score").desc(), F.col("item").asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("group", "item", "score", "rank")
