"""Problem 5: postal addresses of one place, resolved over a gazetteer built from the table itself.

The gazetteer has localities (spellings of a city clustered within a country), streets (spellings
clustered within a locality, one identifier a cluster and type) and house numbers of streets. An
address is resolved by a beam over it: its readings of the locality (the city as spelled, else
the cities its postcode is used in), each with its readings of the street (as spelled, within one edit, the type left out), scored and cut to the
best ``BEAM``; the best complete reading gives the street identifier. Addresses with one
street identifier and house number are one place. Unit, floor and landmark are parsed off.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.llm.pairing import different_pairs, roots
from weftlink.llm.records import country_key, edit_keys, near, parse_address, sound
from weftlink.session import cut

#: Readings of one address that are kept at each step of the beam.
BEAM = 4
ADDRESS_PARTS = ("number", "street", "stype", "city", "postcode", "unit")


def _sound_words(words: str) -> str:
    return " ".join(map(sound, words.split())) if " " in words else sound(words)


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("country", *ADDRESS_PARTS)]))
def parse_address_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Of country and address: parts, street and city in one spelling of their sound and without blanks."""
    for countries, addresses in parts:
        known = {c: country_key(c) for c in countries.unique()}
        rows = [(known[c], n, _sound_words(s).replace(" ", ""), t, _sound_words(w).replace(" ", ""), p, u) for c, (n, s, t, w, p, u) in zip(countries, map(parse_address, addresses))]
        yield pd.DataFrame(rows, columns=["country", *ADDRESS_PARTS])


@F.pandas_udf(T.ArrayType(T.StringType()))
def deletions_udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Forms that words within one edit share; words under five letters have only themselves."""
    for part in parts:
        yield pd.Series([sorted(edit_keys(s, 1)) if len(s) >= 5 else [s] for s in part])


@F.pandas_udf(T.IntegerType())
def near_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edit distance, 3 for more than 2."""
    for a, b in parts:
        yield pd.Series([near(x, y, 2) for x, y in zip(a, b)], dtype="int32")


def cluster_spellings(nodes: DataFrame, block: list[str], word: str) -> DataFrame:
    """Spellings clustered within blocks: ``nodes`` (node, *block, word, n) → (node, root).

    A spelling attaches to the most frequent one of its block within one letter left out on either
    side, if that one is more frequent (equally frequent ones: the earlier in the alphabet stays).
    """
    forms = nodes.select("node", "n", word, F.explode(deletions_udf(word)).alias("d"), *block)
    forms = forms.select("node", "n", word, F.xxhash64(*block, "d").alias("form"))
    shared = forms.groupBy("form").agg(F.count("*").alias("k"), F.max(F.struct("n", F.col(word).alias("w"), "node")).alias("top")).where("k > 1")
    # Each spelling meets the most frequent one of each of its forms: a star, never all pairs.
    met = forms.join(shared.select("form", "top").hint("merge"), "form").where(F.col("node") != F.col("top.node"))
    met = met.groupBy("node").agg(F.max("top").alias("top"), F.first("n").alias("n"), F.first(word).alias("w"))
    met = met.where(F.struct("n", "w", "node") < F.col("top")).withColumn("edits", near_udf("w", F.col("top.w"))).where("edits <= 2")
    return roots(nodes, cut(met.select("node", F.col("top.node").alias("parent"))))


def address_records(df: DataFrame, id_col: str, address_col: str, country_col: str) -> DataFrame:
    """(id, address, country, number, street, stype, city, postcode, unit); NULL addresses and ids are left out."""
    rows = df.select(F.col(id_col).alias("id"), F.col(address_col).alias("address"), F.col(country_col).alias("c")).where("id IS NOT NULL AND address IS NOT NULL").distinct()
    rows = rows.withColumn("p", parse_address_udf("c", "address"))
    return rows.select("id", "address", "p.country", *(f"p.{c}" for c in ADDRESS_PARTS))


def _same_house_streets(typed: DataFrame) -> DataFrame:
    """Streets two edits apart that share a house number and postcode become one: (node, root) of street ids.

    Two writings of one house agree in everything but the spelling; the rarer street joins the
    more frequent one. Blocks are houses, so they stay as small as a house has spellings.
    """
    rows = typed.where("postcode <> ''").where(F.length("street") >= 5).select(F.xxhash64("country", "loc", "stype", "number", "postcode").alias("house"), "street", F.struct("weight", "sid").alias("s")).distinct()
    a, b = (rows.select("house", F.col("street").alias(f"street_{x}"), F.col("s").alias(x)) for x in "ab")
    met = a.join(b.hint("merge"), "house").where("a < b").withColumn("edits", near_udf("street_a", "street_b")).where("edits <= 2")
    parents = cut(met.groupBy(F.col("a.sid").alias("node")).agg(F.max("b").alias("m")).select("node", F.col("m.sid").alias("parent")))
    return roots(typed.select(F.col("sid").alias("node")).distinct(), parents)


def resolve_addresses(records: DataFrame) -> DataFrame:
    """Adds ``place`` to records of :func:`address_records`; without those that name no building.

    An address needs a house number, a street, and a city or a postcode. A record without a country
    takes that of its city where nine tenths of the records of that city have it, else it is left out.
    """
    records = records.where("number <> '' AND street <> '' AND (city <> '' OR postcode <> '')")
    records = records.withColumn("q", F.xxhash64("country", "city", "postcode", "street", "stype", "number"))
    asked = records.groupBy("q", "country", "city", "postcode", "street", "stype", "number").agg(F.count("*").alias("n"))
    lost = asked.where("country = '' AND city <> ''")
    home = asked.where("country <> ''").join(lost.select("city").distinct(), "city", "left_semi").groupBy("city", "country").agg(F.sum("n").alias("n")).groupBy("city").agg(F.sum("n").alias("all"), F.max(F.struct("n", "country")).alias("m"))
    home = home.where("m.n >= 0.9 * all").select("city", F.col("m.country").alias("home"))
    lost = lost.join(home, "city").withColumn("country", F.col("home")).select(asked.columns)
    asked = cut(asked.where("country <> ''").unionByName(lost).withColumn("node", F.xxhash64("country", "city")))

    # Localities.
    cities = asked.where("city <> ''").groupBy("node", "country", "city").agg(F.sum("n").alias("n"))
    loc = cluster_spellings(cities, ["country"], "city").withColumnRenamed("root", "loc")
    spelled = asked.where("city <> ''").join(loc.hint("merge"), "node").drop("node").withColumn("node", F.xxhash64("country", "loc", "street", "stype"))
    spelled = cut(spelled)
    share = Window.partitionBy("country", "postcode")
    codes = spelled.where("postcode <> ''").groupBy("country", "postcode", "loc").agg(F.sum("n").alias("k")).withColumn("cost", -F.log(F.col("k") / F.sum("k").over(share)))
    likeliest = F.row_number().over(Window.partitionBy("country", "postcode").orderBy("cost", "loc"))
    codes = codes.withColumn("k", likeliest).where(F.col("k") <= BEAM).groupBy("country", "postcode").agg(F.collect_list(F.struct("cost", "loc")).alias("locs"))

    # Streets: typed spellings of addresses with a city, clustered within locality and type.
    streets = spelled.where("stype <> ''").groupBy("node", "country", "loc", "street", "stype").agg(F.sum("n").alias("n"))
    sid = cluster_spellings(streets, ["country", "loc", "stype"], "street").withColumnRenamed("root", "sid")
    weight = sid.join(streets.select("node", "n").hint("merge"), "node").groupBy("sid").agg(F.sum("n").alias("weight"))
    typed = cut(spelled.where("stype <> ''").join(sid.hint("merge"), "node").join(weight.hint("merge"), "sid"))
    houses = _same_house_streets(typed)
    typed = cut(typed.withColumnRenamed("sid", "old").join(houses.select(F.col("node").alias("old"), F.col("root").alias("sid")).hint("merge"), "old").select("q", "country", "loc", "street", "stype", "number", "sid"))
    entries = typed.select("country", "loc", "sid", F.col("street").alias("e_street"), F.col("stype").alias("e_type")).distinct()
    known = typed.select(F.xxhash64("sid", "number").alias("house")).distinct().withColumn("known", F.lit(1))

    # Beam over the rest: readings of the locality, then of the street, then whether the house is known.
    by_code = asked.where("city = ''").join(codes.hint("merge"), ["country", "postcode"]).withColumn("r", F.explode("locs"))
    cols = ["q", "country", "street", "stype", "number"]
    open_ = cut(spelled.where("stype = ''").select(*cols, "loc", F.lit(0.0).alias("loc_cost")).unionByName(by_code.select(*cols, F.col("r.loc").alias("loc"), F.col("r.cost").alias("loc_cost"))))
    q_forms = open_.withColumn("d", F.explode(deletions_udf("street"))).withColumn("form", F.xxhash64("country", "loc", "d")).drop("country", "loc", "d")
    e_forms = entries.withColumn("d", F.explode(deletions_udf("e_street"))).select(F.xxhash64("country", "loc", "d").alias("form"), "sid", "e_street", "e_type")
    readings = q_forms.join(e_forms.hint("merge"), "form").where("stype = '' OR stype = e_type").withColumn("edits", near_udf("street", "e_street")).where("edits <= 2")
    readings = readings.withColumn("house", F.xxhash64("sid", "number")).join(known.hint("merge"), "house", "left")
    cost = F.col("edits") + 0.3 * F.col("loc_cost") + F.when(F.col("known").isNull(), 2.0).otherwise(0.0)
    beam = readings.groupBy("q").agg(F.min(F.struct(cost.alias("cost"), "sid")).alias("best")).select("q", F.col("best.sid").alias("found"))
    # What the gazetteer has no entry for stands for itself, under its likeliest locality.
    own = open_.groupBy("q", "country", "street", "stype").agg(F.min(F.struct("loc_cost", "loc")).alias("l"))
    rest = own.join(beam.hint("merge"), "q", "left").select("q", "country", F.coalesce("found", F.xxhash64("country", "l.loc", "street", "stype")).alias("sid"))
    resolved = cut(typed.select("q", "country", "sid").unionByName(rest))
    out = records.join(resolved.withColumnRenamed("country", "in_country").hint("merge"), "q")
    return out.withColumn("place", F.xxhash64("in_country", "sid", "number"))


def same_place_pairs(df: DataFrame, id_col: str = "entity_id", address_col: str = "business_address", country_col: str = "country") -> DataFrame:
    """Pairs of ids at one place whose addresses differ as stored: entity_id_a < entity_id_b.

    Missing, empty and filler addresses, and those without a house number, are at no place.
    """
    records = cut(address_records(df, id_col, address_col, country_col))
    pairs = different_pairs(resolve_addresses(records).select("place", "id", "address"), ["place"], "id", "address")
    return pairs.select(F.col("id_a").alias("entity_id_a"), F.col("id_b").alias("entity_id_b")).distinct()
