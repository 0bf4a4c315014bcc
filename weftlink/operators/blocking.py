"""Blocking: keys, document frequencies, the index, candidates and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.text import ROUTES, affix_keys, all_filled, compact, normalized, route_keys, word_tokens

#: Scores are summed as whole numbers of this part of one, so that sums do not depend on their order.
UNIT = 1e12
KEY = ["route", "country", "key"]
TARGETS = ("S2", "S3")


def _named_keys(route: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(route).alias("route"), k.alias("key")))


def exploded_keys(entities: DataFrame, routes: tuple[str, ...] = tuple(ROUTES)) -> DataFrame:
    """(id, source, country, route, key), each once where ids are unique; empty keys are none.

    One scan serves all routes. Keys of a record are distinct arrays, so nothing is shuffled here.
    """
    keys = route_keys(F.col("name_norm"), F.col("address_norm"))
    pairs = F.concat(*(_named_keys(r, keys[r]) for r in routes))
    rows = entities.select(F.col("entity_id").alias("id"), "source", "country", F.explode(pairs).alias("p"))
    return rows.select("id", "source", "country", "p.route", "p.key").where("key <> ''")


def document_frequency(keys: DataFrame, name: str = "df") -> DataFrame:
    """Records of each (route, country, key), of all sources in ``keys`` together."""
    return keys.groupBy(*KEY).agg(F.count("*").alias(name))


def by_key(keys: DataFrame) -> DataFrame:
    """``keys`` shuffled by (route, country, key), for plans that count and join the same keys.

    Where each use reads the same columns, ids too, Spark explodes and shuffles the keys once for all of them.
    """
    return keys.repartition(*KEY)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, however small it seems.

    The planner takes exploded rows for as many as those they are made of, and would collect all of
    them on the driver to broadcast them.
    """
    return df.hint("merge")


def _records() -> Column:
    """Rows, counted by their ids, NULL or not, so that joins of the same keys read the same columns."""
    return F.count_if(F.col("id").isNotNull()) + F.count_if(F.col("id").isNull())


def _by_route(position: int) -> Column:
    return F.create_map(*(F.lit(x) for r, v in ROUTES.items() for x in (r, v[position])))[F.col("route")]


def capped_frequency(s1_keys: DataFrame) -> DataFrame:
    """S1 frequencies up to the route's cap: rarer keys carry evidence, commoner ones none."""
    return document_frequency(s1_keys, "s1_df").where(F.col("s1_df") <= _by_route(1))


def blocking_index(s1_keys: DataFrame, target_keys: DataFrame, sources: tuple[str, ...] = TARGETS) -> DataFrame:
    """(target_id, source, country, route, key, s1_df, target_df) of keys within both caps.

    ``target_df`` counts the records of the target's own source, and the cap holds for each source
    apart. Both frequencies are aggregates by the same columns, combined before they are shuffled;
    the index is one join on these columns, so each target key is shuffled once and no window holds all records of a common
    key. Adaptive execution splits the partition of a hot key in the join.
    """
    counts = target_keys.groupBy(*KEY).agg(*(F.count_if(F.col("source") == s).alias(f"n_{s}") for s in sources))
    eligible = capped_frequency(s1_keys).join(merged(counts), KEY)
    own = F.coalesce(*(F.when(F.col("source") == s, F.col(f"n_{s}")) for s in sources))
    index = target_keys.join(merged(eligible), KEY).withColumn("target_df", own).where(F.col("target_df") <= _by_route(2))
    return index.select(F.col("id").alias("target_id"), "source", "country", "route", "key", "s1_df", "target_df")


def route_scores(s1_keys: DataFrame, index: DataFrame, flat_exact: float | None = None) -> DataFrame:
    """One row a shared key: (s1_id, target_id, source, country, route, key, route_score, s1_df).

    Scores are the route's weight over the root of the S1 frequency, in UNITs. With ``flat_exact``
    the exact routes score that, at frequency 0.
    """
    score, df = _by_route(0) / F.sqrt("s1_df"), F.col("s1_df")
    if flat_exact is not None:
        exact = F.col("route").isin("exact_name", "exact_address")
        score, df = F.when(exact, F.lit(flat_exact)).otherwise(score), F.when(exact, F.lit(0)).otherwise(df)
    met = s1_keys.drop("source").join(merged(index), KEY)
    return met.select(F.col("id").alias("s1_id"), "target_id", "source", "country", "route", "key", F.round(score * UNIT).cast("bigint").alias("route_score"), df.alias("s1_df"))


def aggregate_evidence(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Evidence, routes, shared keys and rarest key of each pair; one aggregate, as routes are counted as bits.

    With ``by``, the id that pairs are then ranked by, the scores are shuffled by it once for both steps. Pairs
    meet by few keys, which lie in different tasks, so sums before that shuffle would save next to nothing.
    """
    bit = F.create_map(*(F.lit(x) for i, r in enumerate(ROUTES) for x in (r, 1 << i)))[F.col("route")]
    rows = scores.select("s1_id", "target_id", "source", "country", "route_score", bit.alias("bit"), F.col("s1_df"))
    rows = rows.repartition(by) if by else rows
    return rows.groupBy("s1_id", "target_id", "source", "country").agg((F.sum("route_score") / UNIT).alias("classical_evidence"), F.bit_count(F.bit_or("bit")).cast("bigint").alias("classical_route_count"), F.count("*").alias("classical_shared_keys"), F.min("s1_df").alias("classical_best_df"))


RANK_ORDER = (F.desc, "classical_evidence"), (F.desc, "classical_route_count"), (F.desc, "classical_shared_keys"), (F.asc, "classical_best_df")


def ranked(pairs: DataFrame, by: list[str], tie: str, k: int | None, name: str = "classical_rank") -> DataFrame:
    """Pairs of each ``by`` by evidence, routes, keys and rarest key, ties by id; the best ``k`` of them, if given."""
    order = Window.partitionBy(*by).orderBy(*(f(c) for f, c in RANK_ORDER), F.asc(tie))
    out = pairs.withColumn(name, F.row_number().over(order))
    return out if k is None else out.where(F.col(name) <= k)


def classical_candidates(s1: DataFrame, targets: DataFrame, k: int = 30) -> DataFrame:
    """All routes in one join on (route, country, key), then the best ``k`` targets of each S1 record and source."""
    s1_keys, target_keys = exploded_keys(s1), exploded_keys(targets)
    pairs = aggregate_evidence(route_scores(s1_keys, blocking_index(s1_keys, target_keys)), "s1_id")
    return ranked(pairs, ["s1_id", "source"], "target_id", k)


def target_evidence(s1: DataFrame, targets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Evidence of all S1 records for the ``wanted`` targets (target_id), without a cap on target frequency.

    This is the ranking that recall is measured on: an equal name or address counts a flat 5,
    however common it is, and other keys count up to the route's S1 cap. Only wanted targets are exploded.
    """
    few = targets.join(merged(wanted.select(F.col("target_id").alias("entity_id")).distinct()), "entity_id", "left_semi")
    s1_keys, few_keys = by_key(exploded_keys(s1)), exploded_keys(few)
    exact = F.col("route").isin("exact_name", "exact_address")
    reached = s1_keys.join(merged(few_keys.select(*KEY).distinct()), KEY, "left_semi")
    frequency = reached.groupBy(*KEY).agg(_records().alias("s1_df")).where(exact | (F.col("s1_df") <= _by_route(1)))
    index = few_keys.join(merged(frequency), KEY).withColumnRenamed("id", "target_id")
    return aggregate_evidence(route_scores(reached, index, flat_exact=5.0), "target_id")


#: Exact keys: the plain forms keep marks, the folded ones do not.
EXACT_KEYS = ("name_plain", "name_folded", "address_plain", "address_folded")


def exact_keys(df: DataFrame) -> DataFrame:
    """Four exact keys: plain and folded compact name and address."""
    plain = {"name_plain": compact(normalized(F.col("business_name"), False)), "address_plain": compact(normalized(F.col("business_address"), False))}
    return df.select("entity_id", "source", "country", F.col("name_compact").alias("name_folded"), F.col("address_compact").alias("address_folded"), *(c.alias(n) for n, c in plain.items()))


def exact_pairs(s1: DataFrame, targets: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Pairs of one country with an equal, filled key, a row a route; ``keys`` maps routes to columns.

    Each side is exploded to (route, key) once. The result holds every pair of a common key by
    definition; volumes come from :func:`join_volume` without it.
    """
    def rows(df: DataFrame, name: str) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(r).alias("route"), F.col(c).alias("k")) for r, c in keys.items()))).alias("p")
        return df.select(F.col("entity_id").alias(name), *(["source"] if name == "target_id" else []), "country", each).select("*", "p.route", "p.k").drop("p").where("k <> ''")

    met = rows(s1, "s1_id").join(rows(targets, "target_id"), ["country", "route", "k"])
    return met.select("s1_id", "target_id", "source", "country", "route", F.lit(5.0).alias("score"), F.lit(1).alias("shared"), F.lit(0).alias("best_df"))


def join_volume(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of an equi-join by ``keys`` (all filled) without making it: one row, ``volume``."""
    filled = all_filled(*map(F.col, keys))
    a = left.where(filled).groupBy(*keys).agg(F.count("*").alias("n1"))
    b = right.where(filled).groupBy(*keys).agg(F.count("*").alias("n2"))
    return a.join(b, keys).agg(F.coalesce(F.sum(F.col("n1") * F.col("n2")), F.lit(0)).alias("volume"))


def affixes(df: DataFrame) -> DataFrame:
    """Prefix and suffix keys of name and address words."""
    out = {}
    for side in ("name", "address"):
        tokens = word_tokens(F.col(f"{side}_norm"))
        out |= {f"{side}_prefixes": affix_keys(tokens, False), f"{side}_suffixes": affix_keys(tokens, True)}
    return df.select("entity_id", "country", *(c.alias(n) for n, c in out.items()))
