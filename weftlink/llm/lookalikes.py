"""Problem 2: texts that look the same but are stored with different characters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.llm.glyphs import is_confusable, visual_key
from weftlink.llm.pairing import different_pairs


@F.pandas_udf(T.StringType())
def visual_key_udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(visual_key, na_action="ignore")


@F.pandas_udf(T.IntegerType())
def confusables_udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda s: 0 if s is None or s.isascii() else sum(map(is_confusable, s.split()))).astype("Int32")


def consistent_texts(df: DataFrame, fields: list[str], id_col: str) -> DataFrame:
    """Every stored text with its one consistent form: (field_name, id, stored, consistent, confusable_words).

    One row per field, id and stored text; NULL texts have none, an empty text or one of blanks
    and invisible characters has the empty form. Texts are taken whole.
    """
    parts = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("stored")) for f in fields)))
    rows = df.select(F.col(id_col).alias("id"), parts.alias("part")).select("part.field_name", "id", "part.stored")
    rows = rows.where("stored IS NOT NULL AND id IS NOT NULL").distinct()
    return rows.withColumn("consistent", visual_key_udf("stored")).withColumn("confusable_words", confusables_udf("stored"))


def lookalike_pairs(df: DataFrame, fields: list[str], id_col: str) -> DataFrame:
    """Pairs of ids whose texts in a field look the same and differ as stored.

    Columns field_name, entity_id_a < entity_id_b. An id with two stored texts is no pair with
    itself. Texts without anything to see (empty, blanks, invisible characters) count as no text.
    """
    rows = consistent_texts(df, fields, id_col).where("consistent <> ''").select("field_name", "consistent", "id", "stored")
    pairs = different_pairs(rows, ["field_name", "consistent"], "id", "stored")
    return pairs.select("field_name", F.col("id_a").alias("entity_id_a"), F.col("id_b").alias("entity_id_b"))
