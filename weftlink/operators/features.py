"""Features of a pair from its texts and vectors; no retrieval rank or flag enters them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions.similarity import likenesses_udf
from weftlink.functions.text import digit_jaccard, length_ratio
from weftlink.session import spread

FUZZY = ("name_ratio", "name_wratio", "name_token_set", "address_ratio", "address_wratio", "address_token_set")
VECTOR = ("name_cos", "address_cos", "combined_cos", "best_cos", "combined_minus_name", "combined_minus_address", "name_times_address")
BUILTIN = ("name_length_ratio", "name_digit_jaccard", "name_exact", "address_length_ratio", "address_digit_jaccard", "address_exact", "address_missing", "source_is_s3", "country_is_us", "country_is_india")

#: What the model is fitted on: all but the digits of names.
MODEL = tuple(f for f in (*BUILTIN, *FUZZY, *VECTOR) if f != "name_digit_jaccard")


def attach_texts(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Normalised name and address of both sides beside each pair; unknown ids get empty text."""
    out = pairs
    for side, frame, key in (("s1", s1, "s1_id"), ("target", targets, "target_id")):
        out = out.join(frame.select(F.col("entity_id").alias(key), F.col("name_norm").alias(f"{side}_name"), F.col("address_norm").alias(f"{side}_address")), key, "left")
    return out.fillna("", [f"{s}_{p}" for s in ("s1", "target") for p in ("name", "address")])


def builtin_features(pairs: DataFrame) -> DataFrame:
    """Length, digit and equality features and indicators; a missing address zeroes the address ones."""
    n1, n2, a1, a2 = (F.col(c) for c in ("s1_name", "target_name", "s1_address", "target_address"))
    missing = (a1 == "") | (a2 == "")
    address = lambda c: F.when(missing, 0.0).otherwise(c)
    flag = lambda c: c.cast("double")
    return pairs.withColumns(
        {
            "name_length_ratio": length_ratio(n1, n2),
            "name_digit_jaccard": digit_jaccard(n1, n2),
            "name_exact": flag((n1 != "") & (n1 == n2)),
            "address_length_ratio": address(length_ratio(a1, a2)),
            "address_digit_jaccard": address(digit_jaccard(a1, a2)),
            "address_exact": address(flag(a1 == a2)),
            "address_missing": flag(missing),
            "source_is_s3": flag(F.col("source") == "S3"),
            "country_is_us": flag(F.col("country") == "US"),
            "country_is_india": flag(F.col("country") == "India"),
        }
    )


def fuzzy_features(pairs: DataFrame) -> DataFrame:
    """Plain, weighted and word-set ratios; a missing address zeroes the address ones."""
    missing = (F.col("s1_address") == "") | (F.col("target_address") == "")
    out = spread(pairs).withColumn("_f", likenesses_udf("s1_name", "target_name", "s1_address", "target_address"))
    value = lambda c: F.when(missing, 0.0).otherwise(F.col(f"_f.{c}")) if c.startswith("address") else F.col(f"_f.{c}")
    return out.withColumns({c: value(c) for c in FUZZY}).drop("_f")


def vector_features(pairs: DataFrame) -> DataFrame:
    """From the products name_cos, address_cos, combined_cos: their best and their interactions."""
    n, a, c = (F.col(x) for x in ("name_cos", "address_cos", "combined_cos"))
    return pairs.withColumns({"best_cos": F.greatest(n, a, c), "combined_minus_name": c - n, "combined_minus_address": c - a, "name_times_address": n * a})


def fuzzy_score(pairs: DataFrame) -> DataFrame:
    """Rerank score: nine tenths text likeness, one tenth evidence (as a share of 5)."""
    name = F.greatest("name_ratio", "name_token_set")
    address = F.greatest("address_ratio", "address_token_set")
    both = (F.col("s1_address") != "") & (F.col("target_address") != "")
    text = F.when(both, 0.75 * F.greatest(name, address) + 0.25 * F.least(name, address)).otherwise(name)
    return pairs.withColumn("fuzzy_score", 0.9 * text + 0.1 * F.least(F.lit(1.0), F.coalesce(F.col("classical_evidence"), F.lit(0.0)) / 5.0))
