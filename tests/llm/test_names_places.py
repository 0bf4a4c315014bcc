import pytest

from weftlink.llm import name_variants
from weftlink.llm.name_variants import canonical_core, core_likeness, organisation_members, rewritings, variant_pairs
from weftlink.llm.places import same_place_pairs
from weftlink.llm.records import edit_keys, near, parse_address, parse_name

SCHEMA = "entity_id string, business_name string, business_address string, country string, id string, node string"


def frame(spark, names=(), addresses=(), country="US"):
    rows = [(f"S1-{i}", n, None, country, "x", "y") for i, n in enumerate(names)] + [(f"S1-{i}", None, a, country, "x", "y") for i, a in enumerate(addresses)]
    return spark.createDataFrame(rows, SCHEMA)


def pairs(df):
    return {(int(a[3:]), int(b[3:])) for a, b in (sorted((r[0], r[1]), key=lambda s: int(s[3:])) for r in df.collect())}


@pytest.mark.parametrize(
    "text, parts",
    [
        ("M/s Kargil  Takvenim Bkry (P) Ltd.", ("kargil takvenim", "bakery", "pvt ltd")),
        ("The Losme Vostirim Plumbing Limited Liability Company", ("losme vostirim", "plumbing", "llc")),
        ("Dardat Helfekves Almacén S.L.", ("dardat helfekves", "almacen", "sl")),
        ("Jisbon Hotkidor Bros n Sons", ("jisbon hotkidor", "brothers", "sons")),
        (None, ("", "", "")), ("", ("", "", "")), ("Ltd", ("", "", "ltd")),
    ],
)
def test_parse_name(text, parts):
    assert parse_name(text) == parts


@pytest.mark.parametrize(
    "text, parts",
    [
        ("Suite 29, 431 Limgetmim St, Hifimton 59848", ("431", "limgetmim", "street", "hifimton", "59848", "29")),
        ("13068 Gatbulville, No. 110 Zodukkos Boulevard", ("110", "zodukkos", "boulevard", "gatbulville", "13068", "")),
        ("#40, 884 Tatgerrim, Kisbanburg 20834", ("884", "tatgerrim", "", "kisbanburg", "20834", "40")),
        ("Calle Kedanvi 428, Bisfeillo 46571", ("428", "kedanvi", "calle", "bisfeillo", "46571", "")),
        ("Kukgekninstrasse 876, Perukbrück 73061", ("876", "kukgeknin", "strasse", "perukbruck", "73061", "")),
        ("152 Kikvalgul Colony, Opposite Karjem School, Sakuknagar 265 090", ("152", "kikvalgul", "colony", "sakuknagar", "265090", "")),
        ("Two Zolnisyas Court, Dinyiville 62888", ("2", "zolnisyas", "court", "dinyiville", "62888", "")),
        ("923 Rue Hinterdul, Bureau 1, 19951, Porkak-sur-Vey", ("923", "hinterdul", "rue", "porkak sur vey", "19951", "1")),
        ("N/A", ("",) * 6), (None, ("",) * 6), ("", ("",) * 6),
    ],
)
def test_parse_address(text, parts):
    assert parse_address(text) == parts


def test_very_long_texts():
    assert parse_name("word " * 50_000)[0] and parse_address("12 road " * 20_000)
    assert rewritings("x" * 100_000, "") and len(rewritings("ab cde " * 5_000, "")) < 100_000


def _edits(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_near_against_table():
    words = ["", "a", "ab", "ba", "abcd", "abdc", "acbd", "xbcd", "abcde", "bcdea", "kitten", "sitting"]
    for a in words:
        for b in words:
            assert near(a, b, 2) == min(_edits(a, b), 3)


def test_core_likeness():
    assert core_likeness(canonical_core("liz holvumfon"), canonical_core("elizabeth holvumfon")) == 1.0
    assert core_likeness("j kulumoto", "joseph kulumoto") == 0.75
    assert core_likeness("kulumoto", "joseph kulumoto") == 0.7
    assert core_likeness("joseph kulumoto", "tenmar vasdikor") == 0.0
    assert core_likeness("b somamum", "buzansomamum") > 0.6


def test_name_pairs(spark):
    names = ["Elizabeth Holvumfon Trading LLC", "Liz Holvumfon Trading Limited Liability Company", "Holvumfon Elizabeth Trdg", "ElizabethHolvumfon Trading LLC", "Elizabeth Holvunfon Trading LLC", "E. Holvumfon Trading LLC", "Elizabeth Ronpilzun Trading LLC", "Elizabeth Holvumfon Trading LLC", None, ""]
    got = pairs(variant_pairs(frame(spark, names)))
    same = [0, 1, 2, 3, 4, 5, 7]
    assert got == {(a, b) for a in same for b in same if a < b and names[a] != names[b]}


def test_names_of_other_countries_and_trades(spark):
    df = frame(spark, ["Kalju Fimmebet Foods Ltd"]).union(frame(spark, ["Kalju Fimebet Foods Ltd"], country="UK")).union(frame(spark, ["Kalju Fimmebet Foods Ltd."], country=None))
    assert variant_pairs(df).count() == 0
    df = frame(spark, ["Kalju Fimmebet Foods Ltd", "Kalju Fimebbet Plumbing Ltd"])
    assert variant_pairs(df).count() == 0


def test_a_weak_name_of_two_organisations_joins_neither(spark):
    df = frame(spark, ["Rupor Bonninges Foods", "Rostok Bonninges Foods", "R Bonninges Foods"])
    assert variant_pairs(df).count() == 0


def test_an_organisation_with_most_rows(spark):
    df = frame(spark, ["Kalju Fimmebet Foods Ltd"] * 3000 + ["Kalju Fimebbet Foods Ltd"])
    assert variant_pairs(df).count() == 3000


def test_an_organisation_with_most_names(spark, monkeypatch):
    base = "kulmotvardi"
    names = [base] + [base[:k] + x + base[k:] for k in range(1, 11) for x in "bgnprz" if x not in base[k - 1 : k + 1]]
    df = frame(spark, [f"{n} Foods Ltd" for n in names] + ["Tenmar Foods Ltd", f"{base} Plumbing Ltd"])
    members = lambda: sorted((r.id, r.organisation) for r in organisation_members(df).collect())
    got = dict(members())
    assert len({got[f"S1-{i}"] for i in range(len(names))}) == 1 and len(set(got.values())) == 3
    monkeypatch.setattr(name_variants, "HOT_FORM", 4)
    assert dict(members()) == got


def shares(a, b):
    return {f for _, f, _ in rewritings(*a)} & {f for _, f, _ in rewritings(*b)}


def test_rewritings_of_long_and_many_words():
    import random

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abdegiklmnoprstuz") for _ in range(n))
    for size in (5, 12, 24, 25, 26, 40, 70, 300):
        for _ in range(30):
            w = word(size)
            k = rng.randrange(size)
            for t in (w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "x" + w[k + 1 :], w[:k] + w[k : k + 2][::-1] + w[k + 2 :]):
                if len(t) > 5 < len(w):
                    assert shares((w, ""), (t, ""))
                m = rng.randrange(len(t))
                twice = t[:m] + t[m + 1 :]
                if len(twice) > 4 < len(w):
                    assert edit_keys(w, 2) & edit_keys(twice, 2)
    three, initial, left, typo = "kulmot misrak vasdikor", "k misrak vasdikor", "misrak vasdikor", "kulmot misrk vasdikor"
    for other in (initial, left, typo):
        assert shares((three, ""), (other, "")) and core_likeness(three, other) >= 0.55
    assert core_likeness(three, "kulmot tenmar jivford") == 0.0 and core_likeness(three, "vasdikor misrak kulmot") > 0.9


def test_pairs_of_long_and_many_words(spark):
    long = "kalmirsovantegdulfimokresbinjapuvolzetharundimokastelvibrangosemyutildep"
    names = [f"{long} Foods Ltd", f"{long[:30]}{long[31:]} Foods Ltd", "Kulmot Misrak Vasdikor Foods", "K Misrak Vasdikor Foods", "Kulmot Misrk Vasdikor Foods", "Vasdikor Kulmot Misrak Foods", "Tenmar Jivford Holvum Foods"]
    assert pairs(variant_pairs(frame(spark, names))) == {(0, 1), *((a, b) for a in range(2, 6) for b in range(2, 6) if a < b)}


def test_common_forms_lose_no_alike_names(spark, monkeypatch):
    """Every pair that all pairs of every form would accept is met where forms are common, too."""
    import random

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("bdgklmnrstvz") + rng.choice("aeiou") for _ in range(n))
    names = []
    for _ in range(14):
        family = word(4)
        k = rng.randrange(len(family) - 1)
        for x in (family, family[:k] + family[k + 1 :], family[:k] + family[k + 1] + family[k] + family[k + 2 :]):
            names += [f"Robert {x}", f"{x} Robert", f"Robret {x}", f"R {x}", f"Robert {x} Foods"]
    names += ["Robert", "Robert Foods", "R Foods"]
    df = frame(spark, names)
    whole = {(r.id, r.organisation) for r in organisation_members(df).collect()}
    monkeypatch.setattr(name_variants, "HOT_FORM", 2)
    assert {(r.id, r.organisation) for r in organisation_members(df).collect()} == whole


def test_a_chain_of_400_has_one_root(spark):
    from weftlink.llm.pairing import roots

    nodes = spark.range(400).withColumnRenamed("id", "node")
    parents = spark.range(399).selectExpr("id AS node", "id + 1 AS parent")
    assert [r.root for r in roots(nodes, parents).select("root").distinct().collect()] == [399]


def test_place_pairs(spark):
    a = ["540 Mirnikot Road, Jiviford 34685", "Flat 3, 540 Mirnikot Rd, Jiviford", "540 MIRNIKOT ROAD, 34685", "540 Mirnikot, Jiviford 34685", "540 Mirnikto Road, Jiviford 34685", "34685 Jiviford, No. 540 Mirnikot Road", "540 Mirnikot Street, Jiviford 34685", "541 Mirnikot Road, Jiviford 34685", "540 Mirnikot Road, Jiviford 34685", "N/A", "", None, "540 Mirnikot Road, Jivifrod 34685"]
    got = pairs(same_place_pairs(frame(spark, addresses=a)))
    same = [0, 1, 2, 4, 5, 8, 12]
    assert {(x, y) for x in same for y in same if x < y and a[x] != a[y]} <= got
    assert not any(x in (6, 7, 9, 10, 11) or y in (7, 9, 10, 11) for x, y in got)


def test_places_of_other_countries_and_empty(spark):
    df = frame(spark, addresses=["540 Mirnikot Road, Jiviford 34685"]).union(frame(spark, addresses=["540 Mirnikot Rd, Jiviford 34685"], country="UK"))
    assert same_place_pairs(df).count() == 0
    assert same_place_pairs(df.limit(0)).count() == 0 and variant_pairs(df.limit(0)).count() == 0
