"""Queries of the problems for training data, and the SQL that checks them where SQL can."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm.graph_match import match_entities
from weftlink.llm.leaks import find_leaks
from weftlink.llm.lookalikes import consistent_texts, lookalike_pairs
from weftlink.llm.mixture import mixture, sized
from weftlink.llm.name_variants import organisation_members, variant_pairs
from weftlink.llm.places import address_records, resolve_addresses, same_place_pairs
from weftlink.llm.spans import shared_documents, shared_windows
from weftlink.llm.topn import top_items
from weftlink.sources.tables import table


def vocabulary() -> str:
    """Path of the tokenizer's vocabulary: WEFTLINK_VOCABULARY, else the public one that is installed."""
    named = os.environ.get("WEFTLINK_VOCABULARY")
    if named:
        return named
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


FIELDS = ["business_name", "business_address"]


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    s1, s2, s3, known = (table(spark, d, t) for t in ("train_source1", "train_source2", "train_source3", "train_matches"))
    return match_entities(s1, [s2, s3], known).withColumn("confidence", F.round("confidence", 6))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("s1_id", "target_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(table(spark, d, "train_source1"), FIELDS, "entity_id")


def p2_consistent(spark: SparkSession, d: str) -> DataFrame:
    return consistent_texts(table(spark, d, "train_source1"), FIELDS, "entity_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_pairs(table(spark, d, "train_source1"))


def p3_organisations(spark: SparkSession, d: str) -> DataFrame:
    m = organisation_members(table(spark, d, "train_source1"))
    return m.select("id", "name", "country", "organisation", "likeness")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return same_place_pairs(table(spark, d, "train_source1"))


def p5_places(spark: SparkSession, d: str) -> DataFrame:
    r = resolve_addresses(address_records(table(spark, d, "train_source1"), "entity_id", "business_address", "country"))
    return r.select("id", "address", "country", "number", "street", "stype", "city", "postcode", "unit", F.hex("place").alias("place"))


def p6_top(spark: SparkSession, d: str) -> DataFrame:
    top = top_items(table(spark, d, "pairs"), 5, "s1_id", "target_id", "retrieval_priority", "scored_at")
    return top.select(F.col("group").alias("s1_id"), F.col("item").alias("target_id"), F.col("score").alias("retrieval_priority"), "rank")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_top(spark, d).select("s1_id", "target_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    ending = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    topic = F.when(ending.isin("md", "txt", "rst", "adoc"), "prose").when(ending.isin("yml", "yaml", "json", "toml", "ini", "cfg", "xml"), "configuration").when(ending.isin("css", "html", "svg"), "markup").when(F.coalesce(ending, F.lit("")) == "", "other").otherwise("code")
    return sized(table(spark, d, "documents"), vocabulary(), "doc_id", "text", "source", {"lang": F.col("lang"), "topic": topic})


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = mixture(_sizes(spark, d), table(spark, d, "mix_targets"), ["lang", "topic"])
    return rows.select(F.col("id").alias("doc_id"), "source", "tokens", "copies", F.round("weight", 6).alias("weight"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixture(_sizes(spark, d), table(spark, d, "mix_targets"), ["lang", "topic"])
    return report


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources that the report of the raked mix names as short."""
    return p8_report(spark, d).where("short").select("source")


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return shared_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_windows(table(spark, d, "documents")).select(F.col("doc").alias("doc_id")).distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_matches, p2_found, p2_consistent, p3_found, p3_organisations, p5_found, p5_places, p6_found, p6_top, p7_found, p7_leaks, p8_found, p8_mix, p8_report, p9_found, p9_shared)}

_TOP = """
WITH clean AS (SELECT s1_id, target_id, scored_at, CASE WHEN isnan(retrieval_priority) THEN NULL ELSE retrieval_priority END AS p FROM pairs WHERE s1_id IS NOT NULL AND target_id IS NOT NULL),
last AS (SELECT s1_id, target_id, p, row_number() OVER (PARTITION BY s1_id, target_id ORDER BY scored_at DESC NULLS LAST, p DESC NULLS LAST) AS k FROM clean),
ranked AS (SELECT s1_id, target_id, p AS retrieval_priority, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, target_id ASC) AS rank FROM last WHERE k = 1 AND p IS NOT NULL)
"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate({{0}}, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+')"
# Runs of eight words of items and documents, the item's words that shared runs cover.
_LEAKS = f"""
WITH iw AS (SELECT item_id, {_WORDS.format("item_text")} AS w FROM eval_items WHERE item_id IS NOT NULL AND item_text IS NOT NULL),
ig AS (SELECT item_id, j, array_to_string(w[j:j + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS j FROM iw)),
dw AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[j:j + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS j FROM dw)),
hit AS (SELECT DISTINCT doc_id, item_id, unnest(range(j, j + 8)) AS at FROM dg JOIN ig USING (g)),
leak AS (SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS covered_words, CAST(max(len(w)) AS INTEGER) AS item_words FROM hit JOIN iw USING (item_id) GROUP BY doc_id, item_id)
SELECT * FROM leak WHERE covered_words * 2 >= item_words"""
# Every window of 600 characters by its hash.
_SPANS = """
WITH w AS MATERIALIZED (SELECT doc_id, s, hash(substr(text, s, 600)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 598)) AS s FROM documents WHERE length(text) >= 600)),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
f AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM w SEMI JOIN r USING (h))
"""
ORACLE = {
    "p7_found": f"SELECT doc_id, item_id FROM ({_LEAKS})",
    "p7_leaks": f"SELECT *, round(covered_words / item_words, 6) AS covered_share FROM ({_LEAKS})",
    # In characters: the statement says that the choice of tokenizer does not change the result.
    "p8_found": "WITH s AS (SELECT source, sum(length(text)) AS own FROM documents WHERE source IS NOT NULL GROUP BY source) SELECT m.source FROM mix_targets m LEFT JOIN s USING (source) CROSS JOIN (SELECT sum(own) / 2 AS mix FROM s) WHERE target_share * mix > max_repeats * coalesce(own, 0)",
    "p9_found": _SPANS + "SELECT DISTINCT doc_id FROM f",
    "p9_shared": _SPANS + "SELECT doc_id, length(text) AS n_chars, shared_chars, round(shared_chars / length(text), 6) AS shared_share FROM (SELECT doc_id, CAST(sum(least(600, coalesce(n - s, 600))) AS BIGINT) AS shared_chars FROM f GROUP BY doc_id) JOIN documents USING (doc_id)",
    "p6_found": _TOP + "SELECT s1_id, target_id FROM ranked WHERE rank <= 5",
    "p6_top": _TOP + "SELECT s1_id, target_id, retrieval_priority, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5",
}
