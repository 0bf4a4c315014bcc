from pyspark.sql import functions as F

from weftlink.functions.similarity import common_subsequence, ratio, token_set_ratio, weighted_ratio
from weftlink.functions.text import affix_keys, compact, digit_jaccard, id_list, length_ratio, list_cardinality, long_numbers, normalize_text, normalized, qgrams, split_of, word_tokens


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column.alias("v")).collect()]


def test_normalized(spark):
    given = ["  Payne--ENTERPRISES, LLC ", "École", None, "", "Ｆｕｌｌ　ﬁt", "ß"]
    assert values(spark, normalized(F.col("x")), *given) == ["payne enterprises llc", "ecole", "", "", "full fit", "ß"]
    assert values(spark, normalized(F.col("x"), strip_marks=False), "एसएस फ़ूड", "École") == ["एसएस फ़ूड", "école"]
    assert values(spark, compact(normalized(F.col("x"))), "A b-C") == ["abc"]


def test_tokens_and_grams(spark):
    assert values(spark, word_tokens(F.col("x")), "ab abc 123 abc x12", "") == [["abc", "x12"], []]
    assert values(spark, long_numbers(F.col("x")), "12 1234 560001 1234", "") == [["1234", "560001"], []]
    assert values(spark, qgrams(F.col("x"), 4), "abcdefg", "abc", "aaaaaa") == [["abcd", "bcde", "cdef", "defg"], [], ["aaaa"]]
    tokens = F.split("x", " ")
    assert values(spark, affix_keys(tokens, False), "abcdef abcdzz four") == [["abcd"]]
    assert values(spark, affix_keys(tokens, True), "abcdef abcdzz four") == [["cdef", "cdzz"]]


def test_lists_and_splits(spark):
    assert values(spark, id_list(F.col("x")), None, "", "S2-1, S3-2,S2-1 ,") == [[], [], ["S2-1", "S3-2"]]
    assert values(spark, list_cardinality(F.col("x")), None, "a", "a,a") == [0, 1, 2]
    assert values(spark, split_of(F.col("x")), "S1-79", "S1-180", "S1-90") == ["train", "calibration", "holdout"]


def test_pair_measures(spark):
    df = spark.createDataFrame([("a 12 7", "b 12"), ("", ""), ("abcd", "ab")], "x string, y string")
    got = df.select(digit_jaccard(F.col("x"), F.col("y")), length_ratio(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [(0.5, 4 / 6), (0.0, 1.0), (0.0, 0.5)]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_common_subsequence_against_table():
    words = ["", "a", "kitten", "sitting", "abcabc", "cbacba", "zzzz", "über", "naïve names"]
    for a in words:
        for b in words:
            assert common_subsequence(a, b) == _lcs(a, b)


def test_ratios():
    assert ratio("", "") == 1.0 and ratio("abc", "") == 0.0
    assert token_set_ratio("acme shop", "shop acme ltd") == 1.0
    assert token_set_ratio("", "a") == 0.0
    assert weighted_ratio("acme shop", "shop acme") >= 0.95
    assert 0 <= weighted_ratio("abc", "xyz") < 0.2


def test_scalar_normalizer():
    assert normalize_text(None) == "" and normalize_text("एसएस फ़ूड") == "एसएस फ़ूड"
    assert normalize_text("École Straße", strip_marks=True) == "ecole strasse"
