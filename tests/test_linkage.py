import json

import pytest
from pyspark.sql import functions as F

from weftlink.operators import blocking, features, metrics, model, output, pairs, vectors
from weftlink.operators.heavy_keys import distinct_total, eager_join_totals, key_profile, with_share
from weftlink.operators.state import StageManifest, signature
from weftlink.sources.readers import missing_files, normalized_source, read_source, read_truth, truth_links, write_json, write_table, write_tsv
from weftlink.streaming.incremental import start_matching

SOURCE = "entity_id string, business_name string, business_address string, country string"


def sides(spark):
    rows = [("1", "Acme Shop", "12 Main Street 560001", "US"), ("2", "Other", "99 Elsewhere", "India")]
    frame = lambda n: normalized_source(spark.createDataFrame([(f"S{n}-{i}", *r) for i, *r in rows], SOURCE), n, n == 1)
    return frame(1), frame(2).unionByName(frame(3))


def test_candidates_stay_in_country(spark):
    s1, t = sides(spark)
    got = {(r.s1_id, r.target_id) for r in blocking.classical_candidates(s1, t).collect()}
    assert got == {("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-2"), ("S1-2", "S3-2")}


def test_candidates_do_not_depend_on_partitions(spark):
    s1, t = sides(spark)
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(tuple, blocking.classical_candidates(s1, t).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_caps_drop_common_keys(spark):
    many = normalized_source(spark.createDataFrame([(f"S1-{i}", "Same Name", f"{i} Road", "US") for i in range(101)], SOURCE), 1)
    assert blocking.capped_frequency(blocking.exploded_keys(many, ("exact_name",))).count() == 0


def test_empty_sources(spark):
    empty = normalized_source(spark.createDataFrame([], SOURCE), 1)
    assert blocking.classical_candidates(empty, empty).count() == 0


def test_exact_top_k_against_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(f"{s}-{i}", rng.choice("AB"), [rng.gauss(0, 1) for _ in range(8)]) for s in ("S1", "S2") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, country string, vec array<float>").withColumn("source", F.substring("id", 1, 2))
    got = vectors.exact_top_k(df.where("id LIKE 'S1%'").drop("source"), df.where("id LIKE 'S2%'"), 3).collect()
    import numpy as np

    f32 = {i: (c, np.array(v, dtype=np.float32).astype(float)) for i, c, v in rows}
    for i, (c, v) in f32.items():
        if i.startswith("S1"):
            best = sorted((-round(float(v @ w), 9), j) for j, (d, w) in f32.items() if j.startswith("S2") and d == c)[:3]
            assert [r.target_id for r in sorted((r for r in got if r.s1_id == i), key=lambda r: r.ann_rank)] == [j for _, j in best]


def test_inverted_lists_find_most(spark):
    import random

    rng = random.Random(2)
    rows = [(f"{s}-{i}", "A", [rng.gauss(0, 1) for _ in range(8)]) for s in ("S1", "S2") for i in range(200)]
    df = spark.createDataFrame(rows, "id string, country string, vec array<float>").withColumn("source", F.substring("id", 1, 2))
    q, b = df.where("id LIKE 'S1%'"), df.where("id LIKE 'S2%'")
    exact = {(r.s1_id, r.target_id) for r in vectors.exact_top_k(q, b, 5).collect()}
    cells = vectors.centroids(b, 16)
    found = {(r.s1_id, r.target_id) for r in vectors.inverted_top_k(q, b, cells, 5, 5).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_fitted_lists_reach_their_recall(spark):
    from weftlink.plans.linkage import ann_ivf_recall

    assert ann_ivf_recall(spark, "/root/testdata/sf0.1").first().recall >= 0.9


def test_truth_is_forced_for_train_only(spark):
    s1 = spark.createDataFrame([("S1-1", "US", "train"), ("S1-2", "US", "calibration")], "s1_id string, country string, split string")
    links = spark.createDataFrame([("S1-1", "S2-9", "S2"), ("S1-2", "S2-8", "S2")], "s1_id string, target_id string, source string")
    classical = spark.createDataFrame([("S1-1", "S2-1", "S2", "US", 1.0, 1, 1, 1), ("S1-2", "S2-2", "S2", "US", 1.0, 1, 1, 1)], "s1_id string, target_id string, source string, country string, classical_evidence double, classical_route_count int, classical_shared_keys int, classical_best_df bigint")
    ann = spark.createDataFrame([("S1-1", "S2-1", "S2", "US", 0.8)], "s1_id string, target_id string, source string, country string, retrieval_ann_best_score double")
    united = pairs.unite_routes(classical, ann)
    out = pairs.force_truth(united, links, s1)
    got = {(r.s1_id, r.target_id): r for r in out.collect()}
    assert ("S1-1", "S2-9") in got and ("S1-2", "S2-8") not in got
    assert got["S1-1", "S2-9"].country == "US" and got["S1-1", "S2-9"].is_match
    assert got["S1-1", "S2-1"].retrieval_priority == 0.8
    assert pairs.cap_negatives(out, 0).count() == 1


def test_fbeta_cases(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    links = spark.createDataFrame([("c", "x"), ("d", "S2-00047"), ("d", "S3-00812")], "s1_id string, target_id string")
    pred = spark.createDataFrame([("b", "y"), ("d", "S2-00047"), ("d", "S2-00193"), ("d", "S3-00812")], "s1_id string, target_id string")
    got = {r.s1_id: r.fbeta for r in metrics.entity_fbeta(e, links, pred).collect()}
    assert got["a"] == 1.0 and got["b"] == 0.0 and got["c"] == 0.0 and abs(got["d"] - 5 / 7) < 1e-12
    with pytest.raises(ValueError):
        metrics.macro_fbeta(e, links, pred.union(spark.createDataFrame([("zz", "y")], "s1_id string, target_id string")))
    with pytest.raises(ValueError):
        metrics.fbeta(F.lit(1), F.lit(1), F.lit(1), 0)


def test_sweep_agrees_with_single_thresholds(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    links = spark.createDataFrame([("a", "x"), ("b", "y")], "s1_id string, target_id string")
    scored = spark.createDataFrame([("a", "x", 0.9), ("a", "z", 0.4), ("c", "w", 0.6)], "s1_id string, target_id string, score double")
    for row in metrics.threshold_sweep(e, links, scored, [0.3, 0.5, 0.7, 0.95]).collect():
        one = metrics.macro_fbeta(e, links, scored.where(F.col("score") >= row.threshold)).first()
        assert abs(one.macro_fbeta - row.macro_fbeta) < 1e-12


def test_ranking_measures(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "score double, y boolean")
    assert abs(metrics.roc_auc(df).first()[0] - 0.875) < 1e-12
    assert abs(metrics.average_precision(df).first()[0] - (0.5 + 0.5 * 2 / 3)) < 1e-12


def test_outputs(spark, tmp_path):
    scored = spark.createDataFrame([("S1-2", "t", 0.9), ("S1-1", "t", 0.9), ("S1-1", "u", 0.2)], "s1_id string, target_id string, score double")
    best = output.exclusive_matches(scored, 0.5)
    assert [(r.s1_id, r.target_id) for r in best.collect()] == [("S1-1", "t")]
    e = spark.createDataFrame([("S1-1",), ("S1-3",)], "s1_id string")
    grouped = output.grouped_output(e, scored)
    assert {tuple(r) for r in grouped.collect()} == {("S1-1", "t,u"), ("S1-3", "")}
    write_tsv(grouped.repartition(3), str(tmp_path / "out.tsv"), "source1_entity_id")
    assert (tmp_path / "out.tsv").read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tt,u\nS1-3\t\n"


def test_tsv_to_table(spark, tmp_path):
    (tmp_path / "train_source1.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tCafé, LLC\t12 Main St.\tUS\nS1-2\t\t\"a \"\"b\"\"\"\tUS\n", encoding="utf-8")
    (tmp_path / "train_matches.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    out = normalized_source(read_source(spark, str(tmp_path / "train_source1.tsv")), 1, True)
    got = {r.entity_id: r for r in out.collect()}
    assert got["S1-1"].name_norm == "cafe llc" and got["S1-2"].business_name == "" and got["S1-2"].business_address == 'a "b"'
    assert truth_links(read_truth(spark, str(tmp_path / "train_matches.tsv"))).count() == 2
    assert missing_files(spark, str(tmp_path)) == ["train_source2.tsv", "train_source3.tsv"]
    write_table(out, str(tmp_path / "t"), ("split",))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_manifest(spark, tmp_path):
    assert signature({"a": 1, "b": [2]}) == signature({"b": [2], "a": 1})
    path = str(tmp_path / "state" / "manifest.json")
    made = tmp_path / "made"
    made.write_text("x")
    m = StageManifest(spark, path)
    m.complete("features", "000", "s", [str(made)], rows=4)
    again = StageManifest(spark, path)
    assert again.is_complete("features", "000", "s") and not again.is_complete("features", "000", "t")
    before = again.chained("model", 1, "features")
    again.complete("features", "000", "other")
    assert again.chained("model", 1, "features") != before
    made.unlink()
    assert not StageManifest(spark, path).is_complete("features", "001", "s")
    write_json(spark, {"k": 1}, path)
    assert json.load(open(path)) == {"k": 1}


def test_heavy_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, None), (None, 3, "x"), ("b", 4, "z")], "k string, id int, v string")
    p = key_profile(df, "k", {"ids": "id", "vs": "v"}, {"none": F.col("v").isNull()})
    got = {r.key: (r.n_rows, r.ids, r.vs, r.none) for r in p.collect()}
    assert got == {"a": (3, 2, 2, 1), None: (1, 1, 1, 0), "b": (1, 1, 1, 0)}
    heavy = with_share(p, distinct_total(df, "id"), "ids", 0.5).where("is_heavy").collect()
    assert [r.key for r in heavy] == ["a"]
    empty = df.limit(0)
    assert with_share(key_profile(empty, "k", {"ids": "id"}, {}), distinct_total(empty, "id"), "ids", 0.5).count() == 0


def test_eager_join_equals_join(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, x bigint")
    right = spark.createDataFrame([("a", 10), ("a", 20), ("a", 30), ("c", 1)], "k string, y bigint")
    got = eager_join_totals(left, right, "k", {"sx": F.col("x")}, {"sy": F.col("y")}).collect()
    joined = left.join(right, "k").groupBy("k").agg(F.count("*"), F.sum("x"), F.sum("y")).collect()
    assert [(r.key, r.n_pairs, r.sx, r.sy) for r in got] == [tuple(r) for r in joined]


def test_sources_do_not_crowd_each_other(spark):
    """Forty equal S3 records leave the S2 record its place, its caps and its rank."""
    one = normalized_source(spark.createDataFrame([("S1-1", "Acme Shop", "12 Main Street", "US")], SOURCE), 1, True)
    two = normalized_source(spark.createDataFrame([("S2-1", "Acme Shop", "99 Main Street", "US")], SOURCE), 2)
    three = normalized_source(spark.createDataFrame([(f"S3-{i}", "Acme Shop", "12 Main Street", "US") for i in range(600)], SOURCE), 3)
    got = blocking.classical_candidates(one, two.unionByName(three), 5).collect()
    assert sorted(r.classical_rank for r in got if r.source == "S3") == [1, 2, 3, 4, 5]
    assert [(r.target_id, r.classical_rank, r.classical_route_count) for r in got if r.source == "S2"] == [("S2-1", 1, 5)]
    many = [("S1-1", f"S3-{i:02}", "S3", 0.9, False) for i in range(9)] + [("S1-1", "S2-1", "S2", 0.1, False)]
    df = spark.createDataFrame(many, "s1_id string, target_id string, source string, retrieval_priority double, is_match boolean")
    for capped in (pairs.cap_negatives(df, 3), pairs.cap_candidates(df, 3)):
        assert {r.target_id for r in capped.collect()} == {"S3-00", "S3-01", "S3-02", "S2-1"}
    vec = lambda i, x: (f"S{i}", "A", f"S{i[0]}", [float(x), 1.0])
    base = spark.createDataFrame([vec(f"3-{k}", 9 - k) for k in range(5)] + [vec("2-0", 0)], "id string, country string, source string, vec array<float>")
    found = vectors.exact_top_k(spark.createDataFrame([("S1-1", "A", [1.0, 0.0])], "id string, country string, vec array<float>"), base, 2).collect()
    assert sorted((r.source, r.target_id, r.ann_rank) for r in found) == [("S2", "S2-0", 1), ("S3", "S3-0", 1), ("S3", "S3-1", 2)]


def test_equal_names_count_flat_and_uncapped_for_recall(spark):
    s1 = normalized_source(spark.createDataFrame([(f"S1-{i}", "Same Name", f"{i} Road", "US") for i in range(120)], SOURCE), 1, True)
    t = normalized_source(spark.createDataFrame([("S2-1", "Same Name", "7 Road", "US"), ("S2-2", "Same Name", "8 Road", "US")], SOURCE), 2)
    wanted = spark.createDataFrame([("S2-1",)], "target_id string")
    got = {r.s1_id: r for r in blocking.target_evidence(s1, t, wanted).collect()}
    assert len(got) == 120 and all(r.target_id == "S2-1" for r in got.values())
    assert got["S1-7"].classical_evidence > 10 and got["S1-8"].classical_evidence >= 5 and got["S1-8"].classical_best_df == 0


def test_unknown_country_is_an_error(spark):
    df = spark.createDataFrame([("S1-1", None)], "s1_id string, country string")
    with pytest.raises(Exception, match="missing S1 country of S1-1"):
        pairs.with_country(df).collect()


def test_partial_ratio_tries_every_stretch():
    import random

    from weftlink.functions.similarity import common_subsequence, likenesses, partial_ratio

    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(1, n))) for n in (8, 30))
        short, long = sorted((a, b), key=len)
        best = max(common_subsequence(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))
        assert partial_ratio(a, b) == best / len(short)
    assert partial_ratio("needle here 1234", "xxx a needle here 1234 yyy") == 1.0
    assert likenesses("", "") == (1.0, 0.0, 0.0) and likenesses("a b", "a b") == (1.0, 1.0, 1.0)


def test_large_centroids_join_instead(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(f"S2-{i}", rng.choice("AB"), "S2", [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, country string, source string, vec array<float>")
    cells = vectors.centroids(df, 3)
    near = lambda: sorted((r.id, r.cell) for r in vectors._cells(df, cells, 2).collect())
    sent = near()
    monkeypatch.setattr(vectors, "CENTROID_BYTES", 0)
    assert near() == sent and len(sent) == 600


def test_features_of_missing_address(spark):
    p = spark.createDataFrame([("a b", "a b", "", "x", "S3", "US", 2.5)], "s1_name string, target_name string, s1_address string, target_address string, source string, country string, classical_evidence double")
    r = features.fuzzy_score(features.fuzzy_features(features.builtin_features(p))).first()
    assert (r.name_exact, r.address_missing, r.address_ratio, r.address_length_ratio, r.source_is_s3) == (1.0, 1.0, 0.0, 0.0, 1.0)
    assert abs(r.fuzzy_score - 0.95) < 1e-12


def test_model_learns_a_rule(spark):
    rows = [(f"S1-{i}", i / 100, i > 50, "train" if i % 5 else "calibration") for i in range(100)]
    df = spark.createDataFrame(rows, "s1_id string, f double, is_match boolean, validation_split string")
    m = model.fit_matcher(df, ["f"], rounds=3)
    scored = model.score_pairs(m, df, ["f"])
    assert scored.where("(score > 0.5) = is_match").count() >= 95
    assert model.feature_importance(m, ["f"], df).first().feature == "f"


def test_arriving_records_match(spark, tmp_path):
    s1, t = sides(spark)
    a, b = blocking.exploded_keys(s1), blocking.exploded_keys(t)
    index = blocking.blocking_index(a, b)
    write_table(s1, str(tmp_path / "in"))
    stream = spark.readStream.schema(s1.schema).parquet(str(tmp_path / "in"))
    q = start_matching(stream, index, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_search_meets_a_database_piece_by_piece(spark, monkeypatch):
    """Small parts, tiles and Arrow batches, ties and NULLs give what all pairs give, and no task needs its queries beside the whole database."""
    import random

    import numpy as np

    for name, value in (("QUERY_BYTES", 3 * 8 * 7), ("POINT_ROWS", 16), ("FIRST_POINTS", 4), ("TILE_ROWS", 3)):
        monkeypatch.setattr(vectors, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        rng = random.Random(5)
        rows = [(f"{s}-{i}", rng.choice("AB"), s, [float(rng.randint(-2, 2)) for _ in range(3)]) for s in ("S1", "S2") for i in range(150)] + [("S2-x", "A", "S2", None), ("S1-y", None, "S1", [1.0, 1.0, 1.0])]
        df = spark.createDataFrame(rows, "id string, country string, source string, vec array<float>")
        got = vectors.targets_to_s1(df.where("source = 'S2'"), df.where("source = 'S1'"), 6).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for i, c, s, v in rows:
        if s == "S2" and v:
            best = sorted((-float(np.dot(v, w)), j) for j, e, z, w in rows if z == "S1" and e == c)[:6]
            want |= {(i, "S2", j, c, -p + 0.0, k) for k, (p, j) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_search_memory_does_not_grow_with_the_database():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    found = vectors._Nearest(rng.normal(size=(2000, 64)), 20)
    points, ids = rng.normal(size=(40_000, 64)), np.array([f"{i:06d}" for i in range(40_000)], dtype=object)
    tracemalloc.start()
    found.meet(ids, points)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    best = np.argsort(-np.round(found.vecs[:50] @ points.T, 9), axis=1, kind="stable")[:, :20]
    assert (found.ids[:50] == ids[best]).all()


def test_products_beyond_single_precision(spark):
    """Large, missing and unlike vectors keep their ranks."""
    import numpy as np

    found = vectors._Nearest(np.array([[1e25, 0.0], [1.0, 1.0]]), 2)
    found.meet(np.array(["a", "b", "c"], dtype=object), np.array([[1e25, 1.0], [2e25, 1.0], [np.nan, 0.0]]))
    assert found.ids.tolist() == [["c", "b"], ["c", "b"]]


def test_vectors_of_many_texts_are_those_of_each():
    import numpy as np

    texts = ["", None, "a", "acme shop", "दुकान", "\ud800x", "acme shop"]
    many = vectors.text_vectors(texts)
    assert many.shape == (7, 64) and (many == np.concatenate([vectors.text_vectors([t]) for t in texts])).all()
    assert not many[:2].any() or np.allclose(np.linalg.norm(many[2:], axis=1), 1)
    assert (many[3] == many[6]).all()


def test_totals_count_each_pair_once_and_targets_that_have_any(spark):
    from weftlink.operators import evaluation

    found = spark.createDataFrame([("S2", "t1", "a", 4), ("S2", "t1", "a", 2), ("S2", "t1", "b", 1), ("S2", "t2", "a", 3), ("S3", "t3", "c", 9)], "source string, target_id string, s1_id string, r int")
    known = spark.createDataFrame([("a", "t1", "S2", "US"), ("c", "t2", "S2", "US"), ("c", "t3", "S3", None)], "s1_id string, target_id string, source string, country string")
    got = {(x.source, x.k): (x.links, x.retrieved, x.pairs, x.mean_candidates, x.uncut_recall) for x in evaluation.recall_totals(found, known, (1, 3), "r").collect()}
    assert got == {("S2", 1): (2, 0, 1, 1.0, 0.5), ("S2", 3): (2, 1, 3, 1.5, 0.5), ("S3", 1): (1, 0, 0, 0.0, 1.0), ("S3", 3): (1, 0, 0, 0.0, 1.0)}
    assert sorted(map(tuple, evaluation.link_ranks(found, known).select("target_id", "s1_id", "r").collect())) == [("t1", "a", 2), ("t1", "a", 4), ("t3", "c", 9)]


def test_reports_of_neighbours_keep_no_vectors(spark, monkeypatch):
    """What ann_recall_at_k and ann_recall_totals keep between their steps has texts or ranks, and no uncompressed checkpoint is made."""
    from weftlink.plans import linkage

    seen, real = [], linkage.kept
    monkeypatch.setattr(linkage, "kept", lambda df: seen.append(df.columns) or real(df))
    monkeypatch.setattr(linkage, "cut", lambda df: (_ for _ in ()).throw(AssertionError("checkpoint")))
    for name in ("ann_recall_at_k", "ann_recall_totals"):
        assert linkage.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert seen and not any({"ann_score", "name_compact"} & set(c) for c in seen)


def test_pairs_are_shuffled_once(spark):
    """Aggregating and ranking pairs share one shuffle, by the id that they are ranked by."""
    a, b = sides(spark)
    wanted = b.select(F.col("entity_id").alias("target_id"))
    plans = {"s1_id": blocking.classical_candidates(a, b), "target_id": blocking.ranked(blocking.target_evidence(a, b, wanted), ["target_id"], "s1_id", None, "rank")}
    for by, df in plans.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert sum(f"Exchange hashpartitioning({c}_id#" in x for x in plan.splitlines() for c in ("s1", "target")) == 1, plan
        assert df.count() == 4, by


def test_marginal_report_makes_no_checkpoint(spark, monkeypatch):
    from weftlink.plans import linkage

    monkeypatch.setattr(linkage, "cut", lambda df: (_ for _ in ()).throw(AssertionError("checkpoint")))
    got = linkage.ann_marginal_over_classical(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 12 and all(r["either"] == r["classical"] + r["marginal"] for r in got)


def _stored(spark, tmp_path):
    """Sides whose sizes the planner estimates from files, and the wanted targets."""
    out = []
    for n, df in enumerate(sides(spark)):
        df.write.parquet(str(tmp_path / str(n)))
        out.append(spark.read.parquet(str(tmp_path / str(n))))
    return *out, out[1].select(F.col("entity_id").alias("target_id"))


def test_recall_ranking_broadcasts_no_keys(spark, tmp_path):
    """Keys exploded from a small file are not collected on the driver, whatever their estimated size, nor shuffled for each use."""
    a, b, wanted = _stored(spark, tmp_path)
    df = blocking.target_evidence(a, b, wanted)
    assert df.count() == 4 and len(df.collect()) == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "ReusedExchange" in plan, plan


def test_candidates_broadcast_no_keys(spark, tmp_path):
    a, b, _ = _stored(spark, tmp_path)
    df = blocking.classical_candidates(a, b)
    assert len(df.collect()) == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan, plan
