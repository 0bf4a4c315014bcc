"""Problem 8: a mix of sources at target shares, by iterative proportional fitting."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.session import cut

#: Cells of source and margins that the driver rakes; more are an error, never cut.
MOST_CELLS = 200_000


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counter(vocabulary: str):
    """A column function: tokens of a text under the byte-level vocabulary file (``.tiktoken``).

    NULL has none. The file must lie at the same path on every executor.
    """

    @F.pandas_udf(T.LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(vocabulary).encode_ordinary
        for part in parts:
            yield pd.Series([0 if s is None else len(encode(s)) for s in part], dtype="int64")

    return count


def sized(documents: DataFrame, vocabulary: str, id_col: str, text_col: str, source_col: str, margins: dict[str, Column]) -> DataFrame:
    """(id, source, *margins, tokens) of documents with a source, computed once and kept."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), *(F.coalesce(c, F.lit("(none)")).alias(m) for m, c in margins.items()))
    return cut(rows.where("source IS NOT NULL").withColumn("tokens", token_counter(vocabulary)("text")).drop("text"))


def source_sizes(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, own_tokens, wanted_tokens, most_tokens, short) for each target.

    The mix is half of all tokens of documents with a source, whether or not the source has a
    target. A source without documents has size 0. NULL shares count as 0, NULL repeats as 1, and
    a source listed twice takes its largest share and repeats.
    """
    targets = targets.where("source IS NOT NULL").groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).cast("long").alias("max_repeats"))
    own = sizes.groupBy("source").agg(F.sum("tokens").alias("own_tokens"))
    total = own.agg(F.coalesce(F.sum("own_tokens"), F.lit(0)).alias("total"))
    out = targets.join(own, "source", "left").crossJoin(F.broadcast(total)).withColumn("own_tokens", F.coalesce("own_tokens", F.lit(0)))
    out = out.withColumn("wanted_tokens", F.col("target_share") * F.col("total") / 2).withColumn("most_tokens", F.col("max_repeats") * F.col("own_tokens"))
    return out.drop("total").withColumn("short", F.col("wanted_tokens") > F.col("most_tokens"))


def rake(tokens: np.ndarray, groups: list[np.ndarray], goals: list[np.ndarray], most: np.ndarray, rounds: int = 500, close: float = 1e-9) -> np.ndarray:
    """Tokens to take of each cell so that every margin meets its goals as far as ``most`` allows.

    ``groups[k][cell]`` is the cell's value of margin k, ``goals[k]`` the goal of each value. The
    last margin is met last and so exactly where cells below their most can carry it.
    """
    take = tokens.astype(float)
    for _ in range(rounds):
        before = take
        for group, goal in zip(groups, goals):
            held = np.bincount(group, weights=take, minlength=len(goal))
            take = np.minimum(take * np.divide(goal, held, out=np.zeros_like(goal), where=held > 0)[group], most)
        if np.abs(take - before).max(initial=0) <= close * max(1.0, tokens.sum()):
            break
    # What the caps cut off goes to the other cells of the same source.
    group, goal = groups[-1], goals[-1]
    for _ in range(50):
        held = np.bincount(group, weights=take, minlength=len(goal))
        room = np.bincount(group, weights=np.where(take < most * (1 - 1e-12), take, 0), minlength=len(goal))
        lack = goal - held
        if (lack <= close * np.maximum(goal, 1)).all() or not room[lack > 0].any():
            break
        factor = np.where((room > 0) & (lack > 0), 1 + lack / np.where(room > 0, room, 1), 1.0)
        take = np.where(take < most * (1 - 1e-12), np.minimum(take * factor[group], most), take)
    return take


def mixture(sizes: DataFrame, targets: DataFrame, margins: list[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of a mix of the sizes of :func:`sized`.

    rows: (id, source, tokens, copies, weight), documents that are in the mix, ``copies`` times.
    report: a row for each target source with wanted, drawn and available tokens, the shares wanted
    and reached, and whether it falls short. Token weights of the cells source x margins are raked
    to the target shares of the sources (capped where a source falls short, whose lack is not made
    up by others) and to the corpus' own shares of the other margins, every value of a margin apart;
    more than MOST_CELLS cells or targets are an error. A document is taken
    floor(w) times, and once more with probability w - floor(w) by a hash of its id, where w is
    its cell's weight, never above the repeats allowed. Sources without a target are not used.
    """
    spark = sizes.sparkSession
    goals = source_sizes(sizes, targets)
    used = sizes.join(goals.select("source"), "source", "left_semi")
    counted = cut(used.groupBy("source", *margins).agg(F.sum("tokens").alias("tokens")))
    if max(counted.count(), goals.count()) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of source, {', '.join(margins)}: give coarser margins")
    cells = counted.toPandas()
    cells = cells[cells.tokens > 0].reset_index(drop=True)
    by_source = goals.toPandas().set_index("source")
    if cells.empty:
        weights = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in ("source", *margins)] + [T.StructField("weight", T.DoubleType())]))
    else:
        groups, aims = [], []
        reach = np.minimum(by_source.wanted_tokens, by_source.most_tokens)
        for m in margins:
            group, values = pd.factorize(cells[m])
            share = np.bincount(group, weights=cells.tokens, minlength=len(values)) / cells.tokens.sum()
            groups.append(group)
            aims.append(share * reach.sum())
        group, values = pd.factorize(cells.source)
        groups.append(group)
        aims.append(reach.loc[values].to_numpy(dtype=float))
        most = (cells.tokens * by_source.max_repeats.loc[cells.source].to_numpy()).to_numpy(dtype=float)
        take = rake(cells.tokens.to_numpy(), groups, aims, most)
        cells["weight"] = take / cells.tokens.to_numpy()
        weights = spark.createDataFrame(cells[["source", *margins, "weight"]])
    drawn = used.join(F.broadcast(weights), ["source", *margins])
    chance = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    copies = F.floor("weight") + F.when(chance < F.col("weight") - F.floor("weight"), 1).otherwise(0)
    rows = drawn.withColumn("copies", copies.cast("int")).where("copies > 0").select("id", "source", "tokens", "copies", "weight")
    taken = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.count("*").alias("documents"))
    all_ = taken.agg(F.sum("drawn_tokens").alias("all"))
    report = goals.join(taken, "source", "left").crossJoin(F.broadcast(all_)).fillna(0, ["drawn_tokens", "documents"])
    report = report.withColumn("actual_share", F.col("drawn_tokens") / F.col("all")).drop("all")
    return rows, report
