"""The whole run: normalise, retrieve, unite, featurise, train and calibrate, score, write.

Stages hand over through Parquet under the work folder; a stage whose signature (its options, its
inputs' size and time, and the stages it reads) is unchanged and whose table is there is not run
again. Everything between two tables is one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions.text import eligible, view_text
from weftlink.operators import blocking, features, metrics, model, output, pairs, vectors
from weftlink.operators.state import StageManifest
from weftlink.sources.files import Files
from weftlink.sources.readers import missing_files, normalized_source, read_source, read_truth, truth_links, write_json, write_table, write_tsv

VIEWS = ("name", "address", "combined")
FEATURES = list(features.MODEL)


@dataclass(frozen=True)
class Options:
    classical_k: int = 30
    ann_k: int = 20
    negative_cap: int = 5
    test_cap: int = 40
    rounds: int = 20
    seed: int = 2026
    search: str = "exact"  # or "inverted"
    lists: int = 1024
    probes: int = 16


class Pipeline:
    """``data`` holds {split}_source{n}.tsv and train_matches.tsv; ``work`` gets tables, manifest and reports."""

    def __init__(self, spark: SparkSession, data: str, work: str, options: Options = Options()) -> None:
        lacking = missing_files(spark, data)
        if lacking:
            raise FileNotFoundError(f"missing in {data}: {', '.join(lacking)}")
        self.spark, self.data, self.work, self.options = spark, data, work, options
        self.files = Files(spark)
        self.manifest = StageManifest(spark, f"{work}/manifest.json")

    def stage(self, name: str, build: Callable[[], DataFrame], *upstream: str, inputs: tuple[str, ...] = ()) -> DataFrame:
        path = f"{self.work}/{name}"
        seen = [self.files.stamp(p) for p in inputs]
        sign = self.manifest.chained(name, [asdict(self.options), seen], *upstream)
        if not self.manifest.is_complete(name, "all", sign):
            write_table(build(), path)
            self.manifest.complete(name, "all", sign, [path])
        return self.spark.read.parquet(path)

    def _file(self, name: str) -> str:
        return f"{self.data}/{name}"

    def sources(self, split: str) -> tuple[DataFrame, DataFrame]:
        def one(n: int) -> DataFrame:
            path = self._file(f"{split}_source{n}.tsv")
            return self.stage(f"{split}_s{n}", lambda: normalized_source(read_source(self.spark, path).dropDuplicates(["entity_id"]), n, n == 1), inputs=(path,))

        return one(1), one(2).unionByName(one(3))

    def links(self) -> DataFrame:
        path = self._file("train_matches.tsv")
        return self.stage("links", lambda: truth_links(read_truth(self.spark, path)), inputs=(path,))

    def vectors(self, split: str, s1: DataFrame, t: DataFrame) -> DataFrame:
        def build() -> DataFrame:
            cols = ["entity_id", "source", "country", "business_name", "business_address"]
            both = s1.select(cols).unionByName(t.select(cols))
            name, address = F.col("business_name"), F.col("business_address")
            texts = F.filter(F.array(*(F.struct(F.lit(v).alias("view"), view_text(name, address, v).alias("text"), eligible(address, v).alias("ok")) for v in VIEWS)), lambda x: x["ok"])
            rows = both.select(F.col("entity_id").alias("id"), "source", "country", F.explode(texts).alias("x"))
            return rows.select("id", "source", "country", "x.view", vectors.hashed_text_vectors("x.text").alias("vec"))

        return self.stage(f"{split}_vectors", build, f"{split}_s1", f"{split}_s2", f"{split}_s3")

    def candidates(self, split: str) -> DataFrame:
        o = self.options
        s1, t = self.sources(split)
        names = (f"{split}_s1", f"{split}_s2", f"{split}_s3")
        classical = self.stage(f"{split}_classical", lambda: blocking.classical_candidates(s1, t, o.classical_k), *names)
        vecs = self.vectors(split, s1, t)

        def neighbours() -> DataFrame:
            q, base = vecs.where("source = 'S1'"), vecs.where("source <> 'S1'")
            if o.search == "exact":
                found = vectors.exact_top_k(q.drop("source"), base, o.ann_k, ("view",)).withColumnRenamed("view", "ann_view")
                return pairs.roll_up_views(found, VIEWS)
            parts = []
            for v in VIEWS:
                mine, theirs = (df.where(F.col("view") == v).drop("view") for df in (q, base))
                cells = vectors.centroids(theirs, o.lists)
                parts.append(vectors.inverted_top_k(mine.drop("source"), theirs, cells, o.ann_k, o.probes).withColumn("ann_view", F.lit(v)))
            return pairs.roll_up_views(reduce(DataFrame.unionByName, parts), VIEWS)

        known = self.links() if split == "train" else None
        ann = self.stage(f"{split}_ann", neighbours, f"{split}_vectors")

        def unite() -> DataFrame:
            united = pairs.unite_routes(classical, ann)
            splits = s1.select(F.col("entity_id").alias("s1_id"), "country", "split")
            if known is not None:
                return pairs.cap_negatives(pairs.force_truth(united, known, splits), o.negative_cap)
            capped = pairs.cap_candidates(united, o.test_cap)
            return capped.drop("country").join(splits.drop("split"), "s1_id", "left")

        def ordered() -> DataFrame:
            return pairs.with_country(unite()).orderBy("s1_id", "source", "target_id")

        return self.stage(f"{split}_pairs", ordered, f"{split}_classical", f"{split}_ann", *(["links"] if split == "train" else []))

    def features(self, split: str) -> DataFrame:
        s1, t = self.sources(split)
        chosen, vecs = self.candidates(split), self.vectors(split, s1, t)

        def build() -> DataFrame:
            out = features.fuzzy_features(features.builtin_features(features.attach_texts(chosen, s1, t)))
            for v in VIEWS:
                mine = vecs.where(F.col("view") == v)
                out = out.join(mine.select(F.col("id").alias("s1_id"), F.col("vec").alias("_a")), "s1_id", "left").join(mine.select(F.col("id").alias("target_id"), F.col("vec").alias("_b")), "target_id", "left")
                out = out.withColumn(f"{v}_cos", vectors.dot(F.col("_a"), F.col("_b"))).drop("_a", "_b")
            keep = [c for c in ("is_match", "validation_split") if c in chosen.columns]
            return features.vector_features(out).select("s1_id", "target_id", "source", *keep, *FEATURES)

        return self.stage(f"{split}_features", build, f"{split}_pairs", f"{split}_vectors")

    def run(self) -> dict:
        """Trains, calibrates and, where test files exist, writes matches and candidates for them."""
        o = self.options
        rows = self.features("train")
        fitted = model.fit_matcher(rows, FEATURES, o.rounds, o.seed)
        scored = self.stage("train_scored", lambda: model.score_pairs(fitted, rows, FEATURES).select("s1_id", "target_id", "is_match", "validation_split", "score"), "train_features")
        s1, _ = self.sources("train")
        report: dict = {}
        held = s1.where("split = 'calibration'").select(F.col("entity_id").alias("s1_id"))
        links = self.links()
        best = metrics.best_threshold(metrics.threshold_sweep(held, links.join(held, "s1_id", "left_semi"), scored.join(held, "s1_id", "left_semi"))).first()
        report["threshold"], report["calibration_fbeta"] = best.threshold, best.macro_fbeta
        out = s1.where("split = 'holdout'").select(F.col("entity_id").alias("s1_id"))
        mine = scored.join(out, "s1_id", "left_semi")
        row = metrics.macro_fbeta(out, links.join(out, "s1_id", "left_semi"), mine.where(F.col("score") >= best.threshold)).first()
        report["holdout"] = row.asDict()
        report["candidate_recall"] = metrics.candidate_recall(mine, links.join(out, "s1_id", "left_semi")).first().recall
        report["importance"] = {r.feature: r.importance for r in model.feature_importance(fitted, FEATURES, rows).collect()}
        summary = self.spark.read.parquet(f"{self.work}/train_ann").groupBy("source").agg(F.count("*").alias("pairs"), F.count_distinct("s1_id").alias("records")).orderBy("source")
        write_json(self.spark, {"search": o.search, "k": o.ann_k, "views": list(VIEWS), "sources": [r.asDict() for r in summary.collect()]}, f"{self.work}/ann_summary.json")
        lines = [f"{f},{v!r}" for f, v in sorted(report["importance"].items(), key=lambda x: (-x[1], x[0]))]
        self.files.write("\n".join(["feature,importance", *lines, ""]), f"{self.work}/importance.csv")
        if not missing_files(self.spark, self.data, "test"):
            tested = self.features("test")
            entities = self.sources("test")[0].select(F.col("entity_id").alias("s1_id"))
            final = self.stage("test_scored", lambda: model.score_pairs(fitted, tested, FEATURES).select("s1_id", "target_id", "score"), "test_features", "train_features")
            write_tsv(output.grouped_output(entities, output.exclusive_matches(final, best.threshold)), f"{self.work}/matches.tsv", "source1_entity_id")
            write_tsv(output.grouped_output(entities, final).withColumnRenamed("matched_entity_ids", "candidate_entity_ids"), f"{self.work}/candidates.tsv", "source1_entity_id")
        write_json(self.spark, report, f"{self.work}/report.json")
        return report
