import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink import session
from weftlink.llm import graph_match as g
from weftlink.llm.records import near, sound

SCHEMA = "entity_id string, business_name string, business_address string, country string, eid string"


def source(spark, n, rows):
    return spark.createDataFrame([(f"S{n}-{i}", *r, "clash") for i, r in enumerate(rows)], SCHEMA)


S1 = [
    ("Totak Luhinni Hardware Co", "417 Rahikkuk Drive, Momnat Creek 56830", "US"),
    ("Totak Luhinni Hardware Co", "12 Felbahor Street, Dejulville 55036", "US"),
    ("Hotal Voshikik Textiles Ltd", "523 Fibakvu Road, Sovohalli 780023", "India"),
    (None, None, "US"),
    ("Relnu Vojufo Dental Clinic LLC", "110 Zodukkos Boulevard, Gatbulville 13068", None),
    ("Minat Tenverkom Plumbing Co", "240 Bitkomdun Road, Zurhikburg 10654", "UK"),
]
S2 = [
    ("Luhinni Totak Hdwe Company", "Ste 1, 417 Rahikuk Dr., Momnat Creek", "US"),
    ("Totak Luhinni Hardware Co", "12 Felbahor Street, Dejulville 55036", "US"),
    ("H. Voshikik Textiles", "523 Fibakvu Rd, Sovohalli 780 023", " india "),
    ("Hotal Voshikik Textiles Ltd", "N/A", "India"),
    ("Totak Luhinni Hardware Co", None, "US"),
    ("Pudam Talgethor Logistics LLC", "417 Rahikkuk Drive, Momnat Creek 56830", "US"),
    ("Relnu Vojufo Dental Clinic LLC", "110 Zodukkos Boulevard, Gatbulville 13068", "US"),
    (None, "", "US"),
    ("Minat Tenverkom Plumbing Co", "240 Bitkomdun Road, Zurhikburg 10654", "US"),
    ("Other Name Foods Ltd", "110 Zodukkos Boulevard, Gatbulville 13068", "US"),
]


def test_matches_without_labels(spark):
    s1, s2 = source(spark, 1, S1), source(spark, 2, S2)
    got = {(r.s1_id, r.target_id): r.confidence for r in g.match_entities(s1, [s2, s2.limit(0)], None).collect()}
    assert set(got) == {("S1-0", "S2-0"), ("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-2", "S2-3"), ("S1-4", "S2-6")}
    assert all(0.5 <= c <= 1 for c in got.values())


def test_repeated_rows_and_empty_tables(spark):
    s1, s2 = source(spark, 1, S1), source(spark, 2, S2)
    once = sorted(map(tuple, g.match_entities(s1, [s2], None).select("s1_id", "target_id").collect()))
    twice = sorted(map(tuple, g.match_entities(s1.union(s1), [s2.union(s2)], None).select("s1_id", "target_id").collect()))
    assert once == twice
    assert g.match_entities(s1.limit(0), [s2.limit(0)], None).count() == 0


def test_a_bucket_with_most_rows_is_parted(spark, monkeypatch):
    monkeypatch.setattr(g, "BUCKET_PAIRS", 1000)
    rows = [("Totak Luhinni Hardware Co", f"{i} Rahikkuk Drive, Momnat Creek 56830", "US") for i in range(100)]
    got = g.match_entities(source(spark, 1, rows), [source(spark, 2, rows)], None).collect()
    assert {(r.s1_id, r.target_id) for r in got} == {(f"S1-{i}", f"S2-{i}") for i in range(100)}


def test_known_links(spark):
    m = spark.createDataFrame([("S1-1", " S2-1, S3-2 ,S2-1"), ("S1-1", "S2-1"), ("S1-2", None), ("S1-3", ""), (None, "S2-9")], "source1_entity_id string, matched_entity_ids string")
    assert {tuple(r) for r in g.match_links(m).collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-2"), ("S1-2", None), ("S1-3", None)}


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 2))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(1 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert np.allclose(g.fit_logistic(x, y), [1, 2, -1], atol=0.3)


def test_vectors_draw_shared_contexts_together():
    records = [g.record_texts(g.record_parts("Acme Bakery", f"{i} Main Street, Oldtown 12345")) for i in range(200)]
    v = g.train_vectors(records)
    assert v.shape == (g.TOKENS, g.DIMENSIONS) and np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-3)
    assert np.array_equal(v, g.train_vectors(records))
    assert g.train_vectors([]).shape == v.shape


def test_contradictions_are_refused():
    a = ("kalu misrak", "bakery", "ltd", "12", "mirnikot", "road", "jiviford", "34685")
    assert g.pair_features(a, a) is not None
    for k, other in ((3, "13"), (5, "street"), (1, "plumbing"), (0, "tenmar vasdikor"), (4, "kolvasdir")):
        assert g.pair_features(a, (*a[:k], other, *a[k + 1 :])) is None
    none = ("", "", "", "", "", "", "", "")
    assert g.pair_features(none, none) is None


@pytest.mark.parametrize("name", [None, "", "x" * 50_000])
def test_any_text_hashes(name):
    tokens = g.record_texts(g.record_parts(name, name))
    sig_name, _, hashes, has = g.hash_records([tokens], g.train_vectors([]))
    assert g.token_table([tokens])[1].shape == (1, 9)
    assert len(sig_name) == 1 and hashes.shape == has.shape


def test_features_cover_all_columns(spark):
    s1, s2 = source(spark, 1, S1), source(spark, 2, S2)
    c = g.scored_candidates(s1, [s2])
    assert c.columns == ["s1_id", "target_id", *g.FEATURES] and c.where(F.col("rivals") < 0).count() == 0


def test_a_hot_bucket_loses_no_pair(spark, monkeypatch):
    one = [("Totak Luhinni Hardware Co", f"{i} Rahikkuk Drive, Momnat Creek 56830" if i % 3 else None, "US") for i in range(12)]
    two = [("Totak Luhinni Hardware Co", f"{i} Felbahor Street, Dejulville 55036" if i % 4 else "N/A", "US") for i in range(12)] + one[1:3]
    candidates = lambda: sorted(map(tuple, g.scored_candidates(source(spark, 1, one), [source(spark, 2, two)]).collect()))
    whole = candidates()
    assert {(r[0], r[1]) for r in whole} >= {("S1-0", f"S2-{k}") for k in range(12)} | {(f"S1-{k}", "S2-0") for k in range(12)}
    monkeypatch.setattr(g, "BUCKET_PAIRS", 1)
    monkeypatch.setattr(g, "BLOCK_RECORDS", 3, raising=False)
    assert candidates() == whole


def test_pairs_of_other_trades_are_not_shuffled_for_scoring(spark, monkeypatch):
    trades = ["Bakery", "Plumbing", "Logistics", "Textiles", "Pharmacy"]
    rows = [(f"Totak Luhinni {t} Ltd", "417 Rahikkuk Drive, Momnat Creek 56830", "US") for t in trades]
    met = []
    meetings = g._meetings
    monkeypatch.setattr(g, "_meetings", lambda records: met.append(meetings(records)) or met[0])
    got = {(r[0], r[1]) for r in g.scored_candidates(source(spark, 1, rows), [source(spark, 2, [*rows, ("Totak Luhinni", rows[0][1], "US")])]).collect()}
    assert got == {(f"S1-{i}", f"S2-{j}") for i in range(5) for j in (i, 5)}
    assert met[0].count() == len(got)


def test_trades_whose_bits_fall_together_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(g, "TRADE_BITS", 1)
    s1, s2 = source(spark, 1, S1), source(spark, 2, S2)
    got = {(r.s1_id, r.target_id) for r in g.match_entities(s1, [s2], None).collect()}
    assert got == {("S1-0", "S2-0"), ("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-2", "S2-3"), ("S1-4", "S2-6")}


def test_a_kept_table_leaves_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    setting = spark.conf.get(session._CLEAN_UP, None)
    t = session.kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not files() - before
    assert spark.conf.get(session._CLEAN_UP, None) == setting
    assert t.count() == 7 and t.agg(F.sum("count")).first()[0] == 1000


def test_sums_of_vectors_do_not_depend_on_the_batch():
    texts = [g.record_texts(g.record_parts(n, a)) for n, a, _ in [*S1, *S2]] + [g.record_texts(g.record_parts("x" * 3000, None))]
    vectors = g.train_vectors([])
    whole, counts = g.group_vectors(texts, vectors)
    flat, _ = g.token_table(texts)
    ends = np.cumsum(counts.ravel())
    for (row, group), n, end in zip(np.ndindex(counts.shape), counts.ravel(), ends):
        total = vectors[flat[end - n : end]].sum(axis=0)
        assert np.allclose(whole[row, group], total / max(np.linalg.norm(total), 1e-6), atol=1e-4)
    assert all(np.array_equal(g.group_vectors([x], vectors)[0][0], whole[i]) for i, x in enumerate(texts))


def test_words_in_one_spelling_join_as_they_sound():
    for core in ("abap hola", "kalu umisra", "abo oke", "abe eki", "kalu misrak", "a a", "abk kol"):
        one, two = core.split()
        texts = g.record_texts((core, *[""] * 8))
        assert texts[:2] == (sound(one + two), sound(two + one))


def test_distances_agree_with_plain_edit_distance():
    def plain(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = np.random.default_rng(3)
    for _ in range(2000):
        a, b = ("".join(rng.choice(list("abcdef"), rng.integers(0, 7))) for _ in range(2))
        assert all(near(a, b, most) == min(plain(a, b), most + 1) for most in (1, 2, 3))
