"""Retrieval reports: volumes, recalls by threshold and rank, distributions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.text import AFFIX_ROUTES, GRAM_ROUTES, THRESHOLDS, TOKEN_ROUTES
from weftlink.session import kept


def thresholds_frame(df: DataFrame, values: Sequence[float], name: str) -> DataFrame:
    kind = "double" if any(isinstance(v, float) for v in values) else "bigint"
    return F.broadcast(df.sparkSession.createDataFrame([(v,) for v in values], f"{name} {kind}"))


def labelled_pairs(links: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Known links as (s1_id, target_id, source, country of S1, exact): ``exact`` where name or address agree when folded."""
    a = s1.select(F.col("entity_id").alias("s1_id"), "country", F.col("name_compact").alias("n1"), F.col("address_compact").alias("a1"))
    b = targets.select(F.col("entity_id").alias("target_id"), "source", F.col("name_compact").alias("n2"), F.col("address_compact").alias("a2"))
    both = links.select("s1_id", "target_id").join(a, "s1_id").join(b, "target_id")
    return both.select("s1_id", "target_id", "source", "country", F.expr("n1 <> '' AND n1 = n2 OR a1 <> '' AND a1 = a2").alias("exact"))


def minimum_shared_df(links: DataFrame, s1_keys: DataFrame, target_keys: DataFrame, frequency: DataFrame) -> DataFrame:
    """Rarest shared key of each known link and route: (s1_id, target_id, route, min_df)."""
    a = links.select("s1_id", "target_id").join(s1_keys.drop("source").withColumnRenamed("id", "s1_id"), "s1_id")
    both = a.join(target_keys.select(F.col("id").alias("target_id"), "country", "route", "key"), ["target_id", "country", "route", "key"])
    return both.join(frequency, ["route", "country", "key"]).groupBy("s1_id", "target_id", "route").agg(F.min("df").alias("min_df"))


def candidate_occurrences(frequency: DataFrame, s1_frequency: DataFrame, target_keys: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Pairs and keys that each frequency threshold lets through, by source, route and country.

    ``frequency`` (df) decides, ``s1_frequency`` (s1_df) counts the S1 records asked. Both sides are
    aggregated before they meet, and sums over the few distinct frequencies serve all thresholds.
    """
    keys = ["route", "country", "key"]
    target_frequency = target_keys.groupBy("source", *keys).agg(F.count("*").alias("target_df"))
    volume = frequency.where(F.col("df") <= max(thresholds)).join(s1_frequency, keys).join(target_frequency, keys)
    steps = volume.groupBy("source", "route", "country", "df").agg(F.sum(F.col("s1_df") * F.col("target_df")).alias("pairs"), F.count("*").alias("keys"))
    met = steps.join(thresholds_frame(frequency, thresholds, "threshold"), F.col("df") <= F.col("threshold"))
    return met.groupBy("source", "route", "country", "threshold").agg(F.sum("pairs").alias("occurrences"), F.sum("keys").alias("eligible_keys"))


def _with_minima(labelled: DataFrame, minima: DataFrame, routes: Sequence[str]) -> DataFrame:
    """One pivot of the minima instead of a join a route."""
    wide = minima.groupBy("s1_id", "target_id").pivot("route", list(routes)).agg(F.min("min_df"))
    return labelled.join(wide, ["s1_id", "target_id"], "left")


def _hits(routes: Sequence[str], limit) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(r) <= limit, F.lit(False)) for r in routes])


def recall_table(labelled: DataFrame, minima: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Links retrieved by each word route, by whole words, by word ends, and beyond the exact ones, for each source, threshold and country."""
    routes = [*TOKEN_ROUTES, *AFFIX_ROUTES]
    met = _with_minima(labelled, minima, routes).crossJoin(thresholds_frame(labelled, thresholds, "threshold"))
    limit, exact = F.col("threshold"), F.col("exact")
    tokens, ends = _hits(TOKEN_ROUTES, limit), _hits(AFFIX_ROUTES, limit)
    counts = {f"{r}_links": _hits([r], limit) for r in routes} | {"union_links": tokens | ends, "token_links": tokens, "char_links": ends, "exact_links": exact, "marginal_links": (tokens | ends) & ~exact, "char_marginal_links": ends & ~tokens & ~exact, "combined_links": tokens | ends | exact}
    out = met.groupBy("source", "threshold", "country").agg(F.count("*").alias("links"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    return out.withColumns({f"{n}_recall": F.round(F.col(f"{n}_links") / F.col("links"), 6) for n in ("union", "exact", "combined")})


def qgram_recall_table(labelled: DataFrame, minima: DataFrame, baseline: int = 100, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """What letter runs add to a baseline of exact keys and words of at most ``baseline`` records, for each source, threshold and country."""
    routes = [*TOKEN_ROUTES, *GRAM_ROUTES]
    met = _with_minima(labelled, minima, routes).crossJoin(thresholds_frame(labelled, thresholds, "threshold"))
    base = F.col("exact") | _hits(TOKEN_ROUTES, baseline)
    name, address = (_hits([r], F.col("threshold")) for r in GRAM_ROUTES)
    counts = {"baseline_links": base, "name_gram_links": name, "address_gram_links": address, "name_gram_marginal": name & ~base, "address_gram_marginal": address & ~name & ~base, "combined_links": base | name | address}
    out = met.groupBy("source", "threshold", "country").agg(F.count("*").alias("links"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    return out.withColumns({f"{n}_recall": F.round(F.col(f"{n}_links") / F.col("links"), 6) for n in ("baseline", "combined")})


def link_ranks(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """The candidates that are known links: few rows, kept where several reports read them."""
    return candidates.join(links.select("s1_id", "target_id").distinct(), ["target_id", "s1_id"], "left_semi")


def _best_ranks(candidates: DataFrame, links: DataFrame, rank: str) -> DataFrame:
    best = link_ranks(candidates, links).groupBy("s1_id", "target_id").agg(F.min(rank).alias("r"))
    return links.select("s1_id", "target_id", "source", "country").join(best, ["s1_id", "target_id"], "left")


def recall_at(candidates: DataFrame, links: DataFrame, ks: Sequence[int], rank: str) -> DataFrame:
    """Known links (with source and country) among the first k candidates: (source, country, k, links, retrieved, recall)."""
    base = _best_ranks(candidates, links, rank).crossJoin(thresholds_frame(links, ks, "k"))
    out = base.groupBy("source", "country", "k").agg(F.count("*").alias("links"), F.count_if(F.col("r") <= F.col("k")).alias("retrieved"))
    return out.withColumn("recall", F.round(F.col("retrieved") / F.col("links"), 6))


def recall_totals(candidates: DataFrame, links: DataFrame, ks: Sequence[int], rank: str) -> DataFrame:
    """As :func:`recall_at` over all countries of a source, with the pairs, their mean a target that has any, and the recall of all candidates uncut."""
    # The candidates are shuffled once, by target; what a target keeps is its counts and the ranks of its links.
    best = candidates.select("source", "target_id", "s1_id", rank).repartition("target_id").groupBy("source", "target_id", "s1_id").agg(F.min(rank).alias("r"))
    known = links.groupBy("target_id").agg(F.collect_set("s1_id").alias("_known"))
    hit = F.when(F.array_contains("_known", F.col("s1_id")), F.struct("s1_id", "r"))
    a_target = kept(best.join(known, "target_id", "left").groupBy("source", "target_id").agg(F.collect_list(hit).alias("hits"), *(F.count_if(F.col("r") <= k).alias(f"n{k}") for k in ks)))
    hits = a_target.select("target_id", F.inline("hits"))
    base = _best_ranks(hits, links, "r").crossJoin(thresholds_frame(links, ks, "k"))
    out = base.groupBy("source", "k").agg(F.count("*").alias("links"), F.count_if(F.col("r") <= F.col("k")).alias("retrieved"), F.count("r").alias("uncut"))
    sums = a_target.groupBy("source").agg(*(F.struct(F.sum(f"n{k}").alias("pairs"), F.count_if(F.col(f"n{k}") > 0).alias("targets")).alias(f"n{k}") for k in ks))
    each = sums.select("source", F.explode(F.array(*(F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"n{k}.pairs"), F.col(f"n{k}.targets")) for k in ks))).alias("x")).select("source", "x.*").where("targets > 0")
    pairs = each.select("source", "k", "pairs", F.round(F.col("pairs") / F.col("targets"), 6).alias("mean_candidates"))
    share = lambda c: F.round(F.col(c) / F.col("links"), 6)
    out = out.join(pairs, ["source", "k"], "left").fillna(0, ["pairs", "mean_candidates"])
    return out.select("source", "k", "links", "retrieved", share("retrieved").alias("recall"), "pairs", "mean_candidates", share("uncut").alias("uncut_recall"))


def count_distribution(candidates: DataFrame, by: str) -> DataFrame:
    """Groups, mean, median, p95 (a value that occurs) and most candidates a group, for each source."""
    n = candidates.groupBy("source", by).agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.count("*").alias("groups"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").cast("double").alias("p95"), F.max("n").alias("most"))


def marginal_over(links: DataFrame, classical: DataFrame, ann: DataFrame, ks: Sequence[int], rank: str) -> DataFrame:
    """Known links by the classical route, by the first k neighbours, by both, by these alone and by either, for each source."""
    c = link_ranks(classical, links).select("s1_id", "target_id").distinct().withColumn("c", F.lit(True))
    base = _best_ranks(ann, links, rank).join(c, ["s1_id", "target_id"], "left").crossJoin(thresholds_frame(links, ks, "k"))
    by_c, by_a = F.coalesce("c", F.lit(False)), F.coalesce(F.col("r") <= F.col("k"), F.lit(False))
    counts = {"classical": by_c, "ann": by_a, "both": by_a & by_c, "marginal": by_a & ~by_c, "either": by_a | by_c}
    out = base.groupBy("source", "k").agg(F.count("*").alias("links"), *(F.count_if(x).alias(n) for n, x in counts.items()))
    return out.withColumns({f"{n}_recall": F.round(F.col(n) / F.col("links"), 6) for n in ("classical", "ann", "either")})


def exact_recall(links: DataFrame, s1_keys: DataFrame, target_keys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Links whose four exact keys agree, and those of any, for each source and country and, with country NULL and ``is_total``, for the source.

    The keys are compared on the labelled pairs only; both levels come from one rollup.
    """
    a, b = (df.select(F.col("entity_id").alias(i), *more, *(F.col(k).alias(f"{k}{n}") for k in keys)) for df, i, n, more in ((s1_keys, "s1_id", 1, ["country"]), (target_keys, "target_id", 2, ["source"])))
    both = links.select("s1_id", "target_id").join(a, "s1_id").join(b, "target_id")
    same = {k: F.expr(f"{k}1 <> '' AND {k}1 = {k}2") for k in keys}
    flagged = both.select("source", "country", *(c.alias(k) for k, c in same.items()), reduce(lambda x, y: x | y, same.values()).alias("union"))
    out = flagged.groupingSets([["source", "country"], ["source"]], "source", "country").agg(F.count("*").alias("links"), *(F.count_if(F.col(k)).alias(f"{k}_links") for k in (*keys, "union")), (F.grouping("country") == 1).alias("is_total"))
    return out.withColumn("union_recall", F.round(F.col("union_links") / F.col("links"), 6))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``, whose header must be these columns in this order."""
    if list(df.columns) != list(columns):
        raise ValueError(f"expected columns {list(columns)}, found {df.columns}")
    return df


def audit_source(df: DataFrame, prefix: str) -> DataFrame:
    """Rows, distinct ids, ids with another prefix and NULLs of a raw source."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("business_name", "business_address", "country")]
    return df.agg(F.lit(prefix).alias("source"), F.count("*").alias("n_rows"), F.count_distinct("entity_id").alias("unique_ids"), F.count_if(~F.startswith("entity_id", F.lit(f"{prefix}-"))).alias("bad_prefixes"), *nulls)


def audit_countries(sources: dict[str, DataFrame]) -> DataFrame:
    """(source, country, n_rows) of raw sources, ordered."""
    parts = [df.groupBy("country").agg(F.count("*").alias("n_rows")).select(F.lit(s).alias("source"), "country", "n_rows") for s, df in sources.items()]
    return reduce(DataFrame.unionByName, parts).orderBy("source", "country")


def rank_within(df: DataFrame, by: str, order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
