"""Delimited and Parquet sources and sinks, with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.functions.text import compact, id_list, normalized, split_of
from weftlink.sources.files import Files

SOURCE_COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Tab-separated UTF-8 with a header, all strings; empty fields are NULL. A wrong header is an error."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, sep="\t", header=True, quote='"', escape='"', multiLine=True, enforceSchema=False)


def read_source(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, SOURCE_COLUMNS)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, TRUTH_COLUMNS)


def missing_files(spark: SparkSession, folder: str, split: str = "train") -> list[str]:
    """Names of the files of one split that a data folder lacks."""
    files = Files(spark)
    names = [f"{split}_source{n}.tsv" for n in (1, 2, 3)] + ([f"{split}_matches.tsv"] if split == "train" else [])
    return [n for n in names if not files.exists(f"{folder}/{n}")]


def latest_entities(df: DataFrame) -> DataFrame:
    """One row an entity, the one loaded last, of the four source columns."""
    order = [F.col(c).desc_nulls_last() for c in ("loaded_at", *SOURCE_COLUMNS[1:])]
    ranked = df.where("entity_id IS NOT NULL").withColumn("_k", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order)))
    return ranked.where("_k = 1").select(*SOURCE_COLUMNS)


def normalized_source(df: DataFrame, number: int, with_split: bool = False) -> DataFrame:
    """Raw columns beside folded name and address, their compact forms, the source and, for S1, the split."""
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) if c != "country" else F.col(c) for c in SOURCE_COLUMNS]
    out = df.select(*cols, F.lit(f"S{number}").alias("source")).withColumns({"name_norm": normalized(F.col("business_name")), "address_norm": normalized(F.col("business_address"))})
    out = out.withColumns({"name_compact": compact(F.col("name_norm")), "address_compact": compact(F.col("address_norm"))})
    return out.withColumn("split", split_of(F.col("entity_id"))) if with_split else out


def truth_links(truth: DataFrame) -> DataFrame:
    """(s1_id, target_id, source) of known matches, each once; ids of other sources have source NULL."""
    rows = truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(id_list(F.col("matched_entity_ids"))).alias("target_id"))
    source = F.when(F.startswith("target_id", F.lit("S2-")), "S2").when(F.startswith("target_id", F.lit("S3-")), "S3")
    return rows.withColumn("source", source).dropDuplicates(["s1_id", "target_id"])


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet with zstd; the committer's _SUCCESS marks a whole table."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_tsv(df: DataFrame, path: str, order: str) -> None:
    """One headered tab-separated file in the order of a column, empty strings left empty.

    The parts are written sorted by all tasks and then joined file by file.
    """
    files = Files(df.sparkSession)
    df.orderBy(order).write.mode("overwrite").csv(f"{path}.parts", sep="\t", header=False, emptyValue="", quote="")
    files.join(f"{path}.parts", path, "\t".join(df.columns))
    files.delete(f"{path}.parts")


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A JSON file, in place only when complete."""
    Files(spark).write(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=str), path)
