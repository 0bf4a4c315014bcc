"""Pairs and stars that never compare equal texts with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.session import cut


def different_pairs(rows: DataFrame, keys: list[str], id_col: str, text_col: str) -> DataFrame:
    """All pairs of ids of one group whose texts differ: keys, ``id_a`` < ``id_b``, each once.

    The pairing happens between distinct texts and is expanded to ids afterwards, so a group of a
    million copies of one text costs a million rows and not their square: every pair of texts that
    the join makes gives at least one row of the result. Groups with one text leave before any
    text is shuffled. NULL keys, ids or texts pair with nothing.
    """
    rows = rows.select(*keys, F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).dropna()
    rows = rows.withColumn("_g", F.xxhash64(*keys)).withColumn("_t", F.xxhash64("_text"))
    mixed = rows.groupBy("_g").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi")).where("_lo <> _hi").select("_g")
    rows = cut(rows.join(mixed.hint("merge"), "_g", "left_semi").dropDuplicates([*keys, "_id", "_text"]))
    texts = rows.select("_g", *keys, "_text").distinct()
    a = texts.withColumnRenamed("_text", "_text_a")
    b = texts.withColumnRenamed("_text", "_text_b")
    pairs = a.join(b.hint("merge"), ["_g", *keys]).where("_text_a < _text_b")
    left = rows.select("_g", *keys, F.col("_text").alias("_text_a"), F.col("_id").alias("_ia"))
    right = rows.select("_g", *keys, F.col("_text").alias("_text_b"), F.col("_id").alias("_ib"))
    pairs = pairs.join(left.hint("merge"), ["_g", *keys, "_text_a"]).join(right.hint("merge"), ["_g", *keys, "_text_b"]).where("_ia <> _ib")
    return pairs.select(*keys, F.least("_ia", "_ib").alias("id_a"), F.greatest("_ia", "_ib").alias("id_b")).distinct()


def roots(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Root of every node of a forest: (node, root), by pointer doubling until nothing moves.

    ``parents`` has (node, parent), at most one row a node, with each parent of higher order than
    its node, so there are no cycles. A chain of n links takes log2(n) rounds.
    """
    above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
    at = nodes.select("node").join(parents.hint("merge"), "node", "left").join(above.hint("merge"), "parent", "left")
    at = cut(at.select("node", F.coalesce("_up", "parent", "node").alias("root"), F.col("_up").isNotNull().alias("moved")))
    while not at.where("moved").isEmpty():
        up = at.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("_up"))
        at = cut(at.drop("moved").join(up.hint("merge"), "root", "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")))
    return at.select("node", "root")
