import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftlink.llm.glyphs import consistent_token, is_confusable, latin_fold, resolved_scripts, visual_key
from weftlink.llm.lookalikes import consistent_texts, lookalike_pairs

FIELDS = ["business_name", "business_address"]


@pytest.mark.parametrize(
    "a, b",
    [
        ("Vоkpі Аgencіeѕ", "Vokpi Agencies"), ("Ｃｏｒｐ　２７", "Corp 27"), ("Café", "Café"), ("a b", "a b"), ("a b c", "a b c"), ("﻿a​b⁠­", "ab"),
        ("Ofﬁce", "Office"), ("  x​ ", "x"), ("Сο", "Co"), ("Рadaria", "Padaria"), ("ज़", "ज़"),
    ],
)
def test_same_look(a, b):
    assert visual_key(a) == visual_key(b)


@pytest.mark.parametrize("a, b", [("Co", "co"), ("Cafe", "Café"), ("a  b", "a b"), ("a.", "a"), ("Рим", "Pum"), ("x²", "x2"), ("l", "I"), ("0", "O")])
def test_other_look(a, b):
    assert visual_key(a) != visual_key(b)


def test_scripts_of_a_token():
    assert "LATIN" in resolved_scripts("Сорр") and resolved_scripts("Рим") == {"CYRILLIC"}
    assert resolved_scripts("42-7") is None
    assert is_confusable("Аgency") and is_confusable("Со") and not is_confusable("Agency") and not is_confusable("Рим")
    assert consistent_token("Pим") == "Рим"
    assert visual_key(None) is None and visual_key("​  ") == "" and latin_fold(None) == ""
    assert visual_key("а" * 200_000) == "a" * 200_000


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_key_is_stable(text):
    key = visual_key(text)
    assert visual_key(key) == key


def test_sounded_out():
    assert latin_fold("कुक्ज़ी वोस्पामोस") == "kukzi vospamos"
    assert latin_fold("Großhandel ÉÑ") == "grosshandel en"


def test_pairs(spark):
    rows = [("S1-3", "Corp", None, "x"), ("S1-1", "Сorp", "", "x"), ("S1-1", "Сorp", "", "x"), ("S1-2", "Corp", "​", "x"), ("S1-4", "corp", "1 Road ", None), ("S1-5", None, "1 Road", "x"), (None, "Corp", "1 Road", "x")]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, field_name string")
    got = {tuple(r) for r in lookalike_pairs(df, FIELDS, "entity_id").collect()}
    assert got == {("business_name", "S1-1", "S1-2"), ("business_name", "S1-1", "S1-3"), ("business_address", "S1-4", "S1-5")}
    assert lookalike_pairs(df.limit(0), FIELDS, "entity_id").count() == 0
    assert consistent_texts(df, FIELDS, "entity_id").where("stored = 'Сorp'").first().confusable_words == 1


def test_copies_of_one_text_cost_no_square(spark):
    rows = [(f"S1-{i}", "Corp" if i else "Сorp", None) for i in range(5000)]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string")
    assert lookalike_pairs(df, FIELDS, "entity_id").count() == 4999


def test_scripts_written_together_are_no_confusables():
    from weftlink.llm.glyphs import is_confusable, resolved_scripts

    assert not any(map(is_confusable, ("東京タワー", "ー", "カー", "한국", "漢字", "hotel")))
    assert all(map(is_confusable, ("\u0430bc", "\u13aapple", "Яndex")))
    assert resolved_scripts("ー") == {"HIRAGANA", "KATAKANA", "JAPANESE"}


def test_characters_beyond_the_basic_plane():
    from weftlink.llm.glyphs import visual_key

    assert visual_key("a\U000e0041b\U000e0100c") == "abc"
    assert visual_key("\u13aapple \u0261o\u217d") == "Apple goc"
    assert visual_key("𝕏 é") == "𝕏 é"
