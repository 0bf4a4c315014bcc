"""Per-key results when a few keys hold most rows (problem 4): aggregate before anything moves.

Joins and distinct counts are never run on the raw rows of a key. Each input is first reduced to a
compact state a key (counts and sums, combined in the tasks that read it), the states are
joined, and counts of pairs and sums over pairs follow algebraically: the join of m rows with
n rows has m * n rows, and a left column's sum over it is its sum times n. Distinct counts go
through (key, value) pairs, which spread a heavy key over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_profile(df: DataFrame, key: str, distinct: dict[str, str], counts: dict[str, Column]) -> DataFrame:
    """(key, n_rows, one column of ``distinct`` and ``counts`` each) for every key, NULL being one too.

    ``distinct`` maps a result column to the column whose distinct non-NULL values count;
    ``counts`` maps one to a condition whose true rows count.
    """
    state = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_rows"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    for name, column in distinct.items():
        values = df.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).alias("v")).distinct()
        values = values.groupBy("k").agg(F.count("*").alias(name))
        state = state.join(values, F.col("key").eqNullSafe(F.col("k")), "left").drop("k").fillna(0, [name])
    return state


def with_share(profile: DataFrame, total: DataFrame, column: str, least: float) -> DataFrame:
    """Adds ``share`` of the one-row ``total`` (column ``total``) and ``is_heavy`` at ``least`` or more.

    The total comes apart because values under several keys count once in it. Over an empty table
    shares are NULL and nothing is heavy.
    """
    out = profile.crossJoin(F.broadcast(total))
    heavy = F.col("key").isNotNull() & (F.col(column) >= F.lit(least) * F.col("total"))
    return out.withColumn("share", F.when(F.col("total") > 0, F.col(column) / F.col("total"))).withColumn("is_heavy", heavy & (F.col("total") > 0)).drop("total")


def distinct_total(df: DataFrame, column: str) -> DataFrame:
    """One row, ``total``: distinct non-NULL values of a column, counted over all tasks."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().agg(F.count("*").alias("total"))


def eager_join_totals(left: DataFrame, right: DataFrame, key: str, left_sums: dict[str, Column], right_sums: dict[str, Column]) -> DataFrame:
    """(key, n_left, n_right, n_pairs, sums over the pairs) of an inner equi-join that is never made.

    ``left_sums`` and ``right_sums`` name sums over the join's rows of an expression of one
    side. NULL keys join with nothing. Equal to joining first and aggregating then, at the cost of
    one row a key and task.
    """
    a = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_left"), *(F.sum(c).alias(n) for n, c in left_sums.items()))
    b = right.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_right"), *(F.sum(c).alias(n) for n, c in right_sums.items()))
    out = a.join(b, "key").withColumn("n_pairs", F.col("n_left") * F.col("n_right"))
    for n in left_sums:
        out = out.withColumn(n, F.col(n) * F.col("n_right"))
    for n in right_sums:
        out = out.withColumn(n, F.col(n) * F.col("n_left"))
    return out
