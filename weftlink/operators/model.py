"""Match classifier: gradient-boosted trees with held-out early stopping, refitted on all rows."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITIVE_WEIGHT = 2.0


def _prepared(df: DataFrame, features: list[str]) -> DataFrame:
    weight = F.when(F.col("is_match"), POSITIVE_WEIGHT).otherwise(1.0)
    out = df.fillna(0.0, features).withColumn("label", F.col("is_match").cast("double")).withColumn("weight", weight)
    return VectorAssembler(inputCols=features, outputCol="features").transform(out)


def _classifier(rounds: int, seed: int, **more) -> GBTClassifier:
    return GBTClassifier(**more, maxIter=rounds, maxDepth=5, stepSize=0.1, subsamplingRate=0.85, featureSubsetStrategy="0.9", minInstancesPerNode=10, weightCol="weight", seed=seed)


def fit_matcher(pairs: DataFrame, features: list[str], rounds: int = 20, seed: int = 2026) -> GBTClassificationModel:
    """Fits on ``train`` rows, stops on ``calibration`` rows, refits on both at the number of trees kept.

    ``pairs`` has the features, is_match and validation_split; unlabelled rows are left out. With
    no calibration row or only one class among either, all rounds are used.
    """
    rows = _prepared(pairs.where("is_match IS NOT NULL"), features).where("validation_split IN ('train', 'calibration')").withColumn("held", F.col("validation_split") == "calibration")
    classes = {r[0] for r in rows.where("held").select("label").distinct().collect()}
    kept = rounds
    if len(classes) == 2:
        first = _classifier(rounds, seed, validationIndicatorCol="held", validationTol=0.0001).fit(rows)
        kept = max(1, len(first.trees))
    return _classifier(kept, seed).fit(rows)


def score_pairs(model: GBTClassificationModel, pairs: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``score``, the probability of a match."""
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(pairs.fillna(0.0, features))
    return model.transform(ready).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def feature_importance(model: GBTClassificationModel, features: list[str], df: DataFrame) -> DataFrame:
    """(feature, importance), to be ordered by importance."""
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
