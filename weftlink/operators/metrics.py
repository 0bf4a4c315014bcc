"""Set F-beta over S1 records, threshold sweep, average precision and ROC area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Thresholds tried: 0.05 to 0.90 by 0.01, then 0.905 to 0.995 by 0.001.
SWEEP = tuple(round(0.05 + 0.01 * i, 3) for i in range(86)) + tuple(round(0.905 + 0.001 * i, 3) for i in range(91))


def fbeta(hits: Column, true: Column, predicted: Column, beta: float = 0.5) -> Column:
    """F-beta of a set: 1 for two empty sets, 0 if only one is empty or nothing is shared."""
    if beta <= 0:
        raise ValueError("beta must be positive")
    b2 = beta * beta
    score = (1 + b2) * hits / (b2 * true + predicted)
    return F.when((true == 0) & (predicted == 0), 1.0).when(hits == 0, 0.0).otherwise(score)


def entity_fbeta(entities: DataFrame, links: DataFrame, predicted: DataFrame, beta: float = 0.5) -> DataFrame:
    """(s1_id, n_true, n_predicted, n_hits, fbeta) of every entity; links and predictions have s1_id, target_id."""
    t = links.select("s1_id", "target_id").distinct()
    p = predicted.select("s1_id", "target_id").distinct()
    both = t.withColumn("t", F.lit(1)).join(p.withColumn("p", F.lit(1)), ["s1_id", "target_id"], "full")
    n = both.groupBy("s1_id").agg(F.count("t").alias("n_true"), F.count("p").alias("n_predicted"), F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("n_hits"))
    out = entities.select("s1_id").distinct().join(n, "s1_id", "left").fillna(0, ["n_true", "n_predicted", "n_hits"])
    return out.withColumn("fbeta", fbeta(F.col("n_hits"), F.col("n_true"), F.col("n_predicted"), beta))


def macro_fbeta(entities: DataFrame, links: DataFrame, predicted: DataFrame, beta: float = 0.5) -> DataFrame:
    """Mean F-beta over the entities, over those with and without links; predictions for others are an error."""
    stray = predicted.join(entities.select("s1_id"), "s1_id", "left_anti")
    if not stray.isEmpty():
        raise ValueError("predictions for entities outside the set")
    e = entity_fbeta(entities, links, predicted, beta)
    return e.agg(F.count("*").alias("entities"), F.avg("fbeta").alias("macro_fbeta"), F.avg(F.when(F.col("n_true") == 0, F.col("fbeta"))).alias("singleton_fbeta"), F.avg(F.when(F.col("n_true") > 0, F.col("fbeta"))).alias("linked_fbeta"), F.sum("n_predicted").alias("predicted_links"))


def threshold_sweep(entities: DataFrame, links: DataFrame, scored: DataFrame, thresholds: Sequence[float] = SWEEP, beta: float = 0.5) -> DataFrame:
    """(threshold, entities, macro_fbeta, predicted_links) for each threshold, in one pass over the pairs.

    A pair enters at the highest threshold it reaches. Only there does its entity's score change,
    so each entity contributes one difference a threshold it has pairs at, and the curve is the
    running sum of the differences over the few thresholds. Predictions for other entities are
    left out; of repeated pairs the best score counts.
    """
    steps = sorted({float(t) for t in thresholds})
    pairs = scored.where("score IS NOT NULL").groupBy("s1_id", "target_id").agg(F.max("score").alias("score"))
    true = links.select("s1_id", "target_id").distinct()
    at = F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= F.col("score")))
    hit = pairs.withColumn("at", at).where("at > 0").join(true.withColumn("t", F.lit(1)), ["s1_id", "target_id"], "left")
    base = entities.select("s1_id").distinct().join(true.groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").fillna(0, ["n_true"])
    n = hit.groupBy("s1_id", "at").agg(F.count("*").alias("n"), F.count("t").alias("h")).join(base, "s1_id")
    down = Window.partitionBy("s1_id").orderBy(F.desc("at"))
    n = n.withColumn("f", fbeta(F.sum("h").over(down), F.col("n_true"), F.sum("n").over(down), beta))
    start = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    change = n.withColumn("d", F.col("f") - F.coalesce(F.lag("f").over(down), start)).groupBy("at").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    whole = base.agg(F.count("*").alias("entities"), F.sum(start).alias("s"))
    frame = scored.sparkSession.createDataFrame([(i, t) for i, t in enumerate(steps, 1)], "at int, threshold double")
    # As many rows as thresholds.
    above = Window.orderBy(F.desc("at"))
    out = frame.join(change, "at", "left").fillna(0).crossJoin(F.broadcast(whole))
    return out.select("threshold", "entities", ((F.col("s") + F.sum("d").over(above)) / F.col("entities")).alias("macro_fbeta"), F.sum("n").over(above).alias("predicted_links"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of highest macro F-beta; of equal ones the lowest threshold."""
    return sweep.orderBy(F.desc(F.round("macro_fbeta", 9)), F.asc("threshold")).limit(1)


def candidate_recall(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Known links, those among the pairs, and their share."""
    t = links.select("s1_id", "target_id").distinct()
    hit = t.join(pairs.select("s1_id", "target_id").distinct().withColumn("r", F.lit(1)), ["s1_id", "target_id"], "left")
    return hit.agg(F.count("*").alias("links"), F.count("r").alias("retrieved"), F.round(F.count("r") / F.count("*"), 6).alias("recall"))


def _by_score(scored: DataFrame) -> DataFrame:
    """Positives and negatives of each distinct score with running totals from the highest.

    Totals run over ranges of about as many scores each: each range sums itself, the few ranges add up what lies
    above them, and rows cumulate within their range, so no task sorts everything.
    """
    n = scored.groupBy("score").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    ranges = max(64, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = n.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)]).alias("b")).first().b or []
    part = n.withColumn("range", F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))).cast("array<double>"), lambda b: b <= F.col("score"))))
    sums = part.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("m"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("m").over(above), F.lit(0)).alias("m0"))
    inside = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return part.withColumn("cp", F.sum("pos").over(inside)).withColumn("cm", F.sum("neg").over(inside)).join(sums, "range").select("pos", "neg", (F.col("cp") + F.col("p0")).alias("tp"), (F.col("cm") + F.col("m0")).alias("fp"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Average precision of (score, y): precision at each distinct score weighted by the recall it adds."""
    s = _by_score(scored)
    return s.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("average_precision"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve of (score, y); tied pairs count half."""
    s = _by_score(scored)
    return s.agg((F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))
