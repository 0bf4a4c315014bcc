"""Queries of problem 4 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.operators.heavy_keys import distinct_total, eager_join_totals, key_profile, with_share
from weftlink.sources.tables import table

FILLERS = ("", "n/a", "na", "none", "null", "-", "unknown")


def p4_countries(spark: SparkSession, d: str) -> DataFrame:
    s1 = table(spark, d, "train_source1").select("entity_id", "business_name", "business_address", "country")
    missing = F.coalesce(F.lower(F.trim("business_address")), F.lit("")).isin(*FILLERS)
    profile = key_profile(s1, "country", {"n_entities": "entity_id", "n_names": "business_name"}, {"n_missing_addresses": missing})
    out = with_share(profile, distinct_total(s1, "entity_id"), "n_entities", 0.05)
    return out.select(F.col("key").alias("country"), "n_rows", "n_entities", "n_names", "n_missing_addresses", F.round("share", 9).alias("share"), "is_heavy")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The heavy countries of the joined compact states of :func:`p4_countries`."""
    return p4_countries(spark, d).where("is_heavy").select("country")


def p4_join_totals(spark: SparkSession, d: str) -> DataFrame:
    size = F.length(F.coalesce("business_name", F.lit(""))).cast("bigint")
    left, right = (table(spark, d, t).select("country", "business_name") for t in ("train_source1", "train_source2"))
    out = eager_join_totals(left, right, "country", {"left_name_chars": size}, {"right_name_chars": size})
    return out.withColumnRenamed("key", "country")


QUERIES = {f.__name__: f for f in (p4_found, p4_countries, p4_join_totals)}

ORACLE = {
    "p4_found": "SELECT country FROM train_source1 WHERE country IS NOT NULL GROUP BY country HAVING count(DISTINCT entity_id) >= 0.05 * (SELECT count(DISTINCT entity_id) FROM train_source1)",
    "p4_countries": "WITH t AS (SELECT count(DISTINCT entity_id) AS total FROM train_source1), p AS (SELECT country, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities, count(DISTINCT business_name) AS n_names, CAST(count(*) FILTER (coalesce(lower(trim(business_address)), '') IN ('', 'n/a', 'na', 'none', 'null', '-', 'unknown')) AS BIGINT) AS n_missing_addresses FROM train_source1 GROUP BY country) "
    "SELECT country, n_rows, n_entities, n_names, n_missing_addresses, round(n_entities / total, 9) AS share, country IS NOT NULL AND n_entities >= 0.05 * total AS is_heavy FROM p, t",
    "p4_join_totals": "SELECT country, CAST(count(DISTINCT a) AS BIGINT) AS n_left, CAST(count(DISTINCT b) AS BIGINT) AS n_right, count(*) AS n_pairs, CAST(sum(la) AS BIGINT) AS left_name_chars, CAST(sum(lb) AS BIGINT) AS right_name_chars FROM (SELECT country, row_number() OVER () AS a, length(coalesce(business_name, '')) AS la FROM train_source1) x JOIN (SELECT country, row_number() OVER () AS b, length(coalesce(business_name, '')) AS lb FROM train_source2) y USING (country) GROUP BY country",
}
