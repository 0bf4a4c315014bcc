"""The reports on raw sources: audit, exact keys, words, letter runs, ranking, neighbours. Each gives named tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions.text import AFFIX_ROUTES, GRAM_ROUTES, ROUTES, THRESHOLDS, TOKEN_ROUTES, in_sample, list_cardinality
from weftlink.operators import blocking, evaluation, features, vectors
from weftlink.session import cut
from weftlink.sources.readers import SOURCE_COLUMNS, TRUTH_COLUMNS, normalized_source, read_source, read_truth, truth_links


@dataclass(frozen=True)
class Inputs:
    """Normalised S1 and target records, once each, and the known links of the S1 records asked."""

    s1: DataFrame
    targets: DataFrame
    links: DataFrame
    raw: dict[str, DataFrame]
    truth: DataFrame


def load(spark: SparkSession, data: str, holdout_only: bool = True, per_mille: int | None = None) -> Inputs:
    """Reads a data folder; links are those of the holdout, or of the last ``per_mille`` of a thousand S1 ids."""
    raw = {f"S{n}": evaluation.require_columns(read_source(spark, f"{data}/train_source{n}.tsv"), SOURCE_COLUMNS) for n in (1, 2, 3)}
    truth = evaluation.require_columns(read_truth(spark, f"{data}/train_matches.tsv"), TRUTH_COLUMNS)
    s1, two, three = (normalized_source(raw[f"S{n}"].dropDuplicates(["entity_id"]), n, n == 1) for n in (1, 2, 3))
    s1 = cut(s1)
    asked = s1.where("split = 'holdout'") if holdout_only else s1
    asked = asked if per_mille is None else s1.where(in_sample(F.col("entity_id"), per_mille))
    known = truth_links(truth).join(asked.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    return Inputs(s1, cut(two.unionByName(three)), cut(known), raw, truth)


def audit(x: Inputs) -> dict[str, DataFrame]:
    parts = [evaluation.audit_source(df, s) for s, df in x.raw.items()]
    links = list_cardinality(F.col("matched_entity_ids"))
    return {
        "sources": parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("source"),
        "countries": evaluation.audit_countries(x.raw),
        "truth": x.truth.agg(F.count("*").alias("n_rows"), F.count_distinct("source1_entity_id").alias("unique_ids"), F.count_if(links == 0).alias("singletons"), F.sum(links).alias("links"), F.avg(links).alias("mean_links"), F.max(links).alias("most_links")),
        "cardinality": x.truth.groupBy(links.alias("links")).agg(F.count("*").alias("n_rows")).orderBy("links"),
    }


def exact(x: Inputs) -> dict[str, DataFrame]:
    recall = evaluation.exact_recall(x.links, blocking.exact_keys(x.s1), blocking.exact_keys(x.targets), blocking.EXACT_KEYS)
    asked = x.s1.where("split = 'holdout'")
    sizes = [blocking.join_volume(asked, x.targets, ["country", *k]).withColumn("keys", F.lit("+".join(k))) for k in (["name_compact"], ["address_compact"], ["name_compact", "address_compact"])]
    counts = x.s1.groupBy("split", "country").agg(F.count("*").alias("n")).orderBy("split", "country")
    return {"splits": counts, "recall": recall.orderBy("source", "is_total", "country"), "volumes": sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).orderBy("keys")}


def _minima(x: Inputs, routes: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    keys = blocking.exploded_keys(x.s1, routes)
    frequency = blocking.document_frequency(keys)
    mine, theirs = (df.join(x.links.select(F.col(c).alias("entity_id")).distinct(), "entity_id", "left_semi") for df, c in ((x.s1, "s1_id"), (x.targets, "target_id")))
    minima = evaluation.minimum_shared_df(x.links, blocking.exploded_keys(mine, routes), blocking.exploded_keys(theirs, routes), frequency)
    return evaluation.labelled_pairs(x.links, x.s1, x.targets), minima, frequency


def _volumes(x: Inputs, frequency: DataFrame, asked: DataFrame, routes: tuple[str, ...], thresholds) -> DataFrame:
    mine = blocking.document_frequency(blocking.exploded_keys(asked, routes), "s1_df")
    return evaluation.candidate_occurrences(frequency, mine, blocking.exploded_keys(x.targets, routes), thresholds).orderBy("source", "route", "threshold", "country")


def tokens(x: Inputs, thresholds=THRESHOLDS) -> dict[str, DataFrame]:
    routes = TOKEN_ROUTES + AFFIX_ROUTES
    labelled, minima, frequency = _minima(x, routes)
    recall = evaluation.recall_table(labelled, minima, thresholds).orderBy("source", "threshold", "country")
    return {"recall": recall, "volumes": _volumes(x, frequency, x.s1.where("split = 'holdout'"), routes, thresholds)}


def qgrams(x: Inputs, thresholds=THRESHOLDS, per_mille: int = 10) -> dict[str, DataFrame]:
    labelled, minima, frequency = _minima(x, TOKEN_ROUTES + GRAM_ROUTES)
    recall = evaluation.qgram_recall_table(labelled, minima, 100, thresholds).orderBy("source", "threshold", "country")
    grams = frequency.where(F.col("route").isin(*GRAM_ROUTES))
    return {"recall": recall, "volumes": _volumes(x, grams, x.s1.where(in_sample(F.col("entity_id"), per_mille)), GRAM_ROUTES, thresholds)}


def _reports(ranked: DataFrame, x: Inputs, ks, rank: str) -> dict[str, DataFrame]:
    return {"recall": evaluation.recall_at(ranked, x.links, ks, rank).orderBy("source", "k", "country"), "totals": evaluation.recall_totals(ranked, x.links, ks, rank).orderBy("source", "k")}


def ranking(x: Inputs, ks=(1, 2, 3, 5, 10, 20)) -> dict[str, DataFrame]:
    """By evidence, and by likeness of the texts of the same candidates."""
    found = cut(blocking.ranked(blocking.target_evidence(x.s1, x.targets, x.links), ["target_id"], "s1_id", None, "rank"))
    texts = features.fuzzy_score(features.fuzzy_features(features.attach_texts(found, x.s1, x.targets)))
    alike = cut(evaluation.rank_within(texts, "target_id", [F.desc("fuzzy_score"), *(f(c) for f, c in blocking.RANK_ORDER), F.asc("s1_id")], "fuzzy_rank"))
    out = {f"evidence_{k}": v for k, v in _reports(found, x, ks, "rank").items()} | {f"likeness_{k}": v for k, v in _reports(alike, x, ks, "fuzzy_rank").items()}
    return out | {"candidates_a_target": evaluation.count_distribution(found, "target_id").orderBy("source"), "candidates": alike.where(F.col("fuzzy_rank") <= max(ks)).select("s1_id", "target_id", "source", "country", "fuzzy_rank", "fuzzy_score", *(c for _, c in blocking.RANK_ORDER))}


def neighbours(x: Inputs, ks=(1, 5, 10, 20, 50)) -> dict[str, DataFrame]:
    """By the vectors of each view, by all views, and what they add to the classical candidates."""
    few = x.targets.join(x.links.select(F.col("target_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    found = cut(vectors.targets_to_s1(vectors.view_vectors(few), vectors.view_vectors(x.s1), max(ks), ("view",)))
    out = {f"{v}_{k}": t for v in ("name", "address", "combined") for k, t in _reports(found.where(F.col("view") == v), x, ks, "ann_rank").items()}
    classical = blocking.ranked(blocking.target_evidence(x.s1, x.targets, x.links), ["target_id"], "s1_id", 20, "rank")
    return out | {f"union_{k}": t for k, t in _reports(found, x, ks, "ann_rank").items()} | {"marginal": evaluation.marginal_over(x.links, classical, found, ks, "ann_rank").orderBy("source", "k"), "candidates": found}


REPORTS: dict[str, Callable[[Inputs], dict[str, DataFrame]]] = {"audit": audit, "exact": exact, "tokens": tokens, "qgrams": qgrams, "ranking": ranking, "neighbours": neighbours}
#: Reports on a thousandth part of the S1 records instead of the holdout, as they look at every candidate.
SAMPLED = {"qgrams": 10, "ranking": 1, "neighbours": 1}
