"""Normalisation, tokens and keys as JVM-side column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Routes with weight, most S1 records and most target records a key may have.
ROUTES = {
    "exact_name": (5.0, 100, 500),
    "exact_address": (5.0, 100, 500),
    "name_tokens": (1.0, 100, 2000),
    "address_tokens": (1.0, 100, 2000),
    "address_numbers": (1.25, 100, 2000),
    "name_char4": (0.20, 50, 1000),
    "address_char5": (0.20, 50, 1000),
}
THRESHOLDS = (1, 2, 5, 10, 20, 50, 100)
#: Routes of whole words and numbers, of word beginnings and ends (reported, not retrieved by), of letter runs.
TOKEN_ROUTES = ("name_tokens", "address_tokens", "address_numbers")
AFFIX_ROUTES = ("name_prefixes", "name_suffixes", "address_prefixes", "address_suffixes")
GRAM_ROUTES = ("name_char4", "address_char5")


def normalize_text(value: str | None, strip_marks: bool = False) -> str:
    """Scalar form for single values: case-folded words parted by single blanks; NULL becomes "".

    Unlike :func:`normalized` it folds case fully (ß becomes ss) and, with ``strip_marks``, only
    non-spacing marks go, while other marks part words.

    >>> normalize_text("  Payne--ENTERPRISES, LLC "), normalize_text("École", strip_marks=True)
    ('payne enterprises llc', 'ecole')
    """
    text = unicodedata.normalize("NFKD" if strip_marks else "NFKC", value or "").casefold()
    kinds = ((ch, unicodedata.category(ch)) for ch in text)
    if strip_marks:
        return " ".join("".join(ch if ch.isalnum() else " " for ch, kind in kinds if kind != "Mn").split())
    return " ".join("".join(ch if ch.isalnum() or kind.startswith("M") else " " for ch, kind in kinds).split())


def normalized(text: Column, strip_marks: bool = True) -> Column:
    """Lower-case words parted by single blanks; NULL becomes "".

    With ``strip_marks`` compatibility decomposition and all marks deleted, else compatibility
    composition and marks kept inside words. Letters, digits (and marks) of any script stay.
    """
    form = "decompose" if strip_marks else "compose"
    out = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(form), F.coalesce(text, F.lit("")), F.lit(True))
    if strip_marks:
        out = F.regexp_replace(out, r"\p{M}+", "")
    keep = r"[^\p{L}\p{N}]+" if strip_marks else r"[^\p{L}\p{N}\p{M}]+"
    return F.trim(F.regexp_replace(F.lower(out), keep, " "))


def compact(norm: Column) -> Column:
    """Normalised text without its blanks."""
    return F.replace(norm, F.lit(" "), F.lit(""))


def word_tokens(norm: Column) -> Column:
    """Distinct words of at least three characters with a letter."""
    return F.array_distinct(F.filter(F.split(norm, " "), lambda w: (F.length(w) >= 3) & w.rlike(r"\p{L}")))


def long_numbers(norm: Column) -> Column:
    """Distinct runs of at least four digits of any script."""
    return F.array_distinct(F.regexp_extract_all(norm, F.lit(r"\p{Nd}{4,}"), F.lit(0)))


def affix_keys(tokens: Column, suffix: bool) -> Column:
    """Distinct first (or last) four characters of tokens of at least five."""
    long = F.filter(tokens, lambda w: F.length(w) >= 5)
    return F.array_distinct(F.transform(long, lambda w: F.right(w, F.lit(4)) if suffix else F.left(w, F.lit(4))))


def qgrams(text: Column, size: int) -> Column:
    """Distinct overlapping runs of ``size`` characters; a shorter text has none."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=(.{{{size}}}))"), F.lit(1)))


def route_keys(name_norm: Column, address_norm: Column) -> dict[str, Column]:
    """Key array of each blocking route from the normalised name and address."""
    name, address = compact(name_norm), compact(address_norm)
    return {
        "exact_name": F.array(name),
        "exact_address": F.array(address),
        "name_tokens": word_tokens(name_norm),
        "address_tokens": word_tokens(address_norm),
        "address_numbers": long_numbers(address_norm),
        "name_char4": qgrams(name, 4),
        "address_char5": qgrams(address, 5),
        **{f"{side}_{end}": affix_keys(word_tokens(c), end == "suffixes") for side, c in (("name", name_norm), ("address", address_norm)) for end in ("prefixes", "suffixes")},
    }


def id_list(text: Column) -> Column:
    """Distinct ids of a comma list in order, blanks trimmed; NULL and blank lists give []."""
    ids = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(ids)


def list_cardinality(text: Column) -> Column:
    """Entries of a comma list by its commas, repeated ones included; 0 for NULL."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(",")) + 1).cast("bigint")


def numeric_id(entity: Column) -> Column:
    """Number behind the source's prefix."""
    return F.regexp_replace(entity, r"^S\d+-", "").cast("bigint")


def split_of(entity: Column) -> Column:
    """train, calibration or holdout (80/10/10) by the id's last two digits."""
    part = F.pmod(numeric_id(entity), F.lit(100))
    return F.when(part < 80, "train").when(part < 90, "calibration").otherwise("holdout")


def in_sample(entity: Column, per_mille: int) -> Column:
    """The last ``per_mille`` of a thousand ids; at most 10 lies inside the holdout."""
    return F.pmod(numeric_id(entity), F.lit(1000)) >= 1000 - per_mille


def shard_of(entity: Column, shards: int) -> Column:
    """Number of the shard of an entity, by its id."""
    return F.pmod(numeric_id(entity), F.lit(shards))


def all_filled(*keys: Column) -> Column:
    """True where no key is NULL or empty."""
    return reduce(lambda a, b: a & b, [F.coalesce(k, F.lit("")) != "" for k in keys])


def eligible(address: Column, view: str) -> Column:
    """Whether a record has a text to search by in a view: the address view needs an address."""
    return F.trim(F.coalesce(address, F.lit(""))) != "" if view == "address" else F.lit(True)


def view_text(name: Column, address: Column, view: str) -> Column:
    """Text to embed for a view: name, address or both."""
    n, a = (F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "") for c in (name, address))
    if view == "name":
        return F.concat(F.lit("query: "), n)
    if view == "address":
        return F.concat(F.lit("query: "), a)
    if view == "combined":
        return F.concat(F.lit("query: business name: "), n, F.lit("; business address: "), a)
    raise ValueError(f"unknown view: {view}")


def digit_sets(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{Nd}+"), F.lit(0)))


def digit_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the digit runs; 0 without any."""
    x, y = digit_sets(a), digit_sets(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer length; 1 for two empty texts."""
    x, y = F.length(a), F.length(b)
    return F.when(F.greatest(x, y) == 0, 1.0).otherwise(F.least(x, y) / F.greatest(x, y))
