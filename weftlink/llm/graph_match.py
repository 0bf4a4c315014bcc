"""Problem 1: records of several sources that denote one business, matched without a common key.

Records, their attributes (name, address) and the attributes' tokens form a graph. Random walks
over it train skip-gram vectors of the tokens; an attribute's vector is the weighted sum of its
tokens'. Tables of random hyperplanes hash the vectors, each table over other tokens of the record,
so that a pair with a typing error, a word left out or a part of the address missing still falls
into one bucket somewhere; buckets lie within a country. Pairs met are first held against short
signatures of either attribute, then scored exactly: cosines of the attributes' vectors, likeness of the
parsed parts, and what is missing. A logistic curve fitted on labelled records turns scores into
confidences. An exact check refuses pairs whose house numbers, street types or trades contradict
each other; a record without an address goes to the one S1 record that its name leaves.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.llm.name_variants import canonical_core, compatible, core_likeness
from weftlink.llm.records import country_key, name_words, near, parse_address, parse_name, sound, sound_of
from weftlink.session import cut, kept, uncollected

#: Token nodes: words and letter groups hash to so many rows of the vector table.
TOKENS = 1 << 15
DIMENSIONS = 32
#: Records (the least by hash of their id) whose walks train the vectors; every record is hashed and matched.
FIT_RECORDS = 6000
#: Labelled S1 records (the least by hash) on which confidences are fitted.
FIT_LABELLED = 4000
#: Candidates of theirs (the least by hash) that are fitted.
FIT_ROWS = 200_000
BITS = 20
#: Bits of the name's and the address's signature and the house number's hash; with three flags they fill one long.
NAME_BITS, ADDRESS_BITS, NUMBER_BITS = 32, 12, 15
#: Bits of the trades' signature: one for each trade word, by its hash.
TRADE_BITS = 31
#: Rows up to which a table is sent to all tasks.
BROADCAST_ROWS = 100_000
#: Tables: tokens of which attribute a record is hashed by.
TABLES = ("name", "longest word", "other word and trade", "number and street", "number and city", "number and postcode")
NAME_TABLES = 3
#: Pairs of one bucket above which it is parted by house number, which loses no pair.
BUCKET_PAIRS = 250_000
#: Records a side of one block of what is still too large then.
BLOCK_RECORDS = 2_000
FEATURES = ("name", "cos_name", "cos_address", "trade", "legal", "number", "street", "stype", "city", "postcode", "no_address", "no_name", "rivals")
#: Weights for a corpus without labels, on the features as they stand.
UNFITTED = np.array([-14.0, 12.0, 1.0, 1.0, 1.0, 0.5, 4.0, 3.0, 1.0, 1.0, 1.0, 4.0, 2.0, -6.0])


def record_parts(name: str | None, address: str | None) -> tuple[str, ...]:
    """(core, trade, legal, number, street, stype, city, postcode, unit) in one spelling of their sounds."""
    core, trade, legal = parse_name(name)
    if not core and name:
        core, trade, legal = " ".join(name_words(name)), "", ""
    number, street, stype, city, postcode, unit = parse_address(address)
    return canonical_core(core), trade, legal, number, sound_of(street.replace(" ", "")), stype, sound(city.replace(" ", "")), postcode, unit


def record_texts(parts: tuple[str, ...]) -> tuple[str, ...]:
    """Texts of the record by group: core, core in the other order, longest core word, its other words, street, city; trade, number, postcode.

    The first six give their letter triples as tokens, the others themselves.
    """
    core, trade, _, number, street, stype, city, postcode, _ = parts
    words = core.split()
    if len(words) == 2:
        one, two = words
        # Words in one spelling of their sounds change at most where they meet.
        plain = one[-1] != two[0] and one[0] != two[-1] and two[0] != "h" != one[0]
        longest, other = (one, two) if len(one) >= len(two) else (two, one)
        return one + two if plain else sound_of(one + two), two + one if plain else sound_of(two + one), longest, other if one is not two else "", street, city, trade, number, postcode
    longest = max(words, key=len) if words else ""
    other = "".join(w for w in words if w is not longest) if len(words) > 1 else ""
    return sound_of("".join(words)), "", longest, other, street, city, trade, number, postcode


GRAM_GROUPS = 6
#: Records hashed and groups summed at once: their vectors stay in the processor's cache.
HASHED, SUMMED = 2000, 8192


def token_table(texts: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all records and groups in order, tokens a record and group) of a batch of texts."""
    flat = [f"^{t}$" if t and k < GRAM_GROUPS else t for row in texts for k, t in enumerate(row)]
    lengths = np.array([len(t) for t in flat], dtype=np.int64).reshape(len(texts), -1)
    kinds = np.tile(np.array([1, 1, 1, 2, 3, 4, 5, 6, 7], dtype=np.uint64), len(texts))
    counts = lengths.copy()
    counts[:, :GRAM_GROUPS] = np.maximum(lengths[:, :GRAM_GROUPS] - 2, 0)
    counts[:, GRAM_GROUPS:] = lengths[:, GRAM_GROUPS:] > 0
    points = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    points = np.concatenate([points, np.zeros(2, dtype=np.uint64)])
    triples = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    starts = np.concatenate([[0], np.cumsum(lengths.ravel())])[:-1]
    sizes = counts.ravel()
    owner = np.repeat(np.arange(len(flat)), sizes)
    within = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)
    values = triples[starts[owner] + within] if len(owner) else np.zeros(0, dtype=np.uint64)
    whole = owner % lengths.shape[1] >= GRAM_GROUPS
    values[whole] = [zlib.crc32(flat[i].encode()) for i in owner[whole]]
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + kinds[owner] * np.uint64(0x94D049BB133111EB)
    return ((values ^ (values >> np.uint64(29))) & np.uint64(TOKENS - 1)).astype(np.int64), counts


#: Weight of each group of tokens in the name and the address vector (groups as in record_tokens).
NAME_WEIGHTS = {0: 1.0}
ADDRESS_WEIGHTS = {7: 1.0, 4: 1.0, 5: 0.5, 8: 0.5}
#: Groups whose vectors the rerank needs.
RERANKED = frozenset(NAME_WEIGHTS) | frozenset(ADDRESS_WEIGHTS)
#: Table (index in TABLES) and weights of the groups that a record is hashed by.
TABLE_WEIGHTS = ((0, {0: 1.0}), (0, {1: 1.0}), (1, {2: 1.0}), (2, {3: 1.0, 6: 1.0}), (3, {7: 1.0, 4: 1.0}), (4, {7: 1.0, 5: 1.0}), (5, {7: 1.0, 8: 1.0}))
#: Groups that make up the attributes of the graph.
ATTRIBUTES = ((0, 6), (4, 5, 7, 8))


def train_vectors(records: list[tuple[str, ...]], seed: int = 7, walks: int = 4, length: int = 6, rate: float = 0.05) -> np.ndarray:
    """Skip-gram vectors of the token nodes of records' texts, trained on walks record - attribute - token - attribute - record.

    Tokens that no walk meets keep their start, a random direction of their own.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((TOKENS, DIMENSIONS)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    tokens, counts = token_table(records) if records else (np.zeros(0, dtype=np.int64), np.zeros((0, 9), dtype=np.int64))
    ends = np.cumsum(counts.ravel())
    group = [tokens[e - n : e] for e, n in zip(ends, counts.ravel())]
    attributes = [np.unique(np.concatenate([group[r * counts.shape[1] + g] for g in part])) for r in range(len(records)) for part in ATTRIBUTES]
    sizes = np.array([len(a) for a in attributes], dtype=np.int64)
    if not sizes.sum():
        return vectors
    flat = np.concatenate(attributes)
    start = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(attributes)), sizes)
    order = np.argsort(flat, kind="stable")
    by_token, token_start = owner[order], np.searchsorted(flat[order], np.arange(TOKENS + 1))
    at = np.tile(np.flatnonzero(sizes > 0), walks)
    steps = []
    for _ in range(length):
        token = flat[start[at] + (rng.random(len(at)) * sizes[at]).astype(np.int64)]
        steps.append(token)
        many = token_start[token + 1] - token_start[token]
        attribute = by_token[token_start[token] + (rng.random(len(at)) * many).astype(np.int64)]
        other = attribute ^ 1  # the record's other attribute, half the time
        at = np.where((rng.random(len(at)) < 0.5) & (sizes[other] > 0), other, attribute)
    pairs = np.concatenate([np.stack([steps[i], steps[j]], axis=1) for i in range(length) for j in range(max(0, i - 2), min(length, i + 3)) if i != j])
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    rng.shuffle(pairs)
    context = np.zeros_like(vectors)
    noise = flat[rng.integers(0, len(flat), size=(len(pairs), 3))]
    for low in range(0, len(pairs), 2048):
        c, o, neg = pairs[low : low + 2048, 0], pairs[low : low + 2048, 1], noise[low : low + 2048]
        v = vectors[c]
        targets = np.concatenate([o[:, None], neg], axis=1)
        u = context[targets]
        score = 1 / (1 + np.exp(-np.clip(np.einsum("bd,bkd->bk", v, u), -20, 20)))
        score[:, 0] -= 1
        np.add.at(context, targets, (-rate * score[:, :, None] * v[:, None, :]).astype(np.float32))
        np.add.at(vectors, c, (-rate * np.einsum("bk,bkd->bd", score, u)).astype(np.float32))
    # Without what all share (mean and first directions), hyperplanes part the vectors evenly.
    met = np.unique(flat)
    known = vectors[met] - vectors[met].mean(axis=0)
    _, _, top = np.linalg.svd(known, full_matrices=False)
    vectors[met] = known - known @ top[:2].T @ top[:2]
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def _planes(seed: int, count: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((DIMENSIONS, count)).astype(np.float32)


def _packed(signs: np.ndarray) -> np.ndarray:
    return signs @ (1 << np.arange(signs.shape[1], dtype=np.int64))


def group_vectors(texts: list[tuple[str, ...]], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of the groups of each record's tokens, tokens a record and group) of a batch."""
    flat, counts = token_table(texts)
    sums = np.zeros((counts.size, DIMENSIONS), dtype=np.float32)
    sizes = counts.ravel()
    starts = np.cumsum(sizes) - sizes
    # Groups with most tokens first, so the k-th tokens are added to a first part of the sums.
    order = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]
    for low in range(0, len(order), SUMMED):
        at = order[low : low + SUMMED]
        first, size = starts[at], sizes[at]
        total = vectors.take(flat[first], axis=0)
        for k in range(1, size[0]):
            n = np.searchsorted(-size, -k)
            total[:n] += vectors.take(flat[first[:n] + k], axis=0)
        total /= np.maximum(np.sqrt(np.einsum("ij,ij->i", total, total)), 1e-6)[:, None]
        sums[at] = total
    return sums.reshape(*counts.shape, DIMENSIONS), counts


def attribute_vectors(part: np.ndarray, weights: dict[int, float]) -> np.ndarray:
    """Vectors of an attribute: the weighted sums of its groups'."""
    return reduce(np.add, [part[:, g] if w == 1 else part[:, g] * np.float32(w) for g, w in weights.items()])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that of ``b``; 0 for vectors of length 0."""
    length = np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
    return np.einsum("ij,ij->i", a, b) / np.maximum(length, 1e-12)


def hash_records(texts: list[tuple[str, ...]], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name signatures, address signatures, table hashes, which tables the record has) of a batch."""
    part, counts = group_vectors(texts, vectors)

    def signs(weights: dict[int, float], planes: np.ndarray) -> np.ndarray:
        return _packed(attribute_vectors(part, weights) @ planes > 0)

    hashes = [signs(w, _planes(200 + k, BITS)) * len(TABLES) + k for k, w in TABLE_WEIGHTS]
    has = [(counts[:, list(w)] > 0).all(axis=1) for _, w in TABLE_WEIGHTS]
    return signs(NAME_WEIGHTS, _planes(101, NAME_BITS)), signs(ADDRESS_WEIGHTS, _planes(102, ADDRESS_BITS)), np.stack(hashes, axis=1), np.stack(has, axis=1)


PARTS = ("core", "trade", "legal", "number", "street", "stype", "city", "postcode")
_RECORD_SCHEMA = "side int, country string, city string, postcode string, sig bigint, trades int, tables array<int>, parts string"
#: Places of the house number's, the address's and the name's bits in a record's signature.
AT_NUMBER, AT_ADDRESS, AT_NAME = 3, 3 + NUMBER_BITS, 3 + NUMBER_BITS + ADDRESS_BITS
_TWO_WORDS = re.compile(r"\w{2,} \w{2,}")


def number_and_flags(core: str, number: str) -> int:
    """Low bits of a signature: hash of the house number; has a name, has a number, has a name of one word or with an initial."""
    return zlib.crc32(number.encode()) % (1 << NUMBER_BITS) << AT_NUMBER | bool(core) | 2 * bool(number) | 4 * (not _TWO_WORDS.match(core))


def texts_of(column: pa.Array) -> list[str | None]:
    return column.to_numpy(zero_copy_only=False).tolist()


def hashed_records(records: DataFrame, model) -> DataFrame:
    """``records`` (eid, side, name, address, country) parsed, with signatures and table hashes; ``model`` holds the vectors for all workers.

    ``parts`` are those of PARTS and the id in one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, str] = {}
        bits: dict[str, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            eid, name, address, country = (texts_of(batch.column(c)) for c in (0, 2, 3, 4))
            parts = [record_parts(n, a) for n, a in zip(name, address)]
            texts = [record_texts(p) for p in parts]
            sig_name, sig_address, hashes, has = map(np.concatenate, zip(*(hash_records(texts[low : low + HASHED], model.value) for low in range(0, len(texts), HASHED))))
            for c in country:
                if c not in known:
                    known[c] = country_key(c)
            for p in parts:
                if p[1] not in bits:
                    bits[p[1]] = reduce(int.__or__, (1 << zlib.crc32(w.encode()) % TRADE_BITS for w in p[1].split()), 0)
            offsets = np.concatenate([[0], np.cumsum(has.sum(axis=1))]).astype(np.int32)
            tables = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[has].astype(np.int32)))
            sig = sig_name << AT_NAME | sig_address << AT_ADDRESS | np.array([number_and_flags(p[0], p[3]) for p in parts])
            city, postcode = ([p[PARTS.index(c)] for p in parts] for c in ("city", "postcode"))
            joined = ["\t".join((*p[: len(PARTS)], e)) for p, e in zip(parts, eid)]
            cols = [batch.column(1), *(pa.array(c, pa.string()) for c in ([known[c] for c in country], city, postcode)), pa.array(sig), pa.array([bits[p[1]] for p in parts], pa.int32()), tables, pa.array(joined, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["side", "country", "city", "postcode", "sig", "trades", "tables", "parts"])

    return records.mapInArrow(uncollected(run), _RECORD_SCHEMA)


def deliveries(df: DataFrame, side: int) -> DataFrame:
    """(eid, side, name, address, country) of every delivery of an entity; without NULL ids."""
    return df.where("entity_id IS NOT NULL").select(F.col("entity_id").alias("eid"), F.lit(side).alias("side"), F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country")


def _at_home(records: DataFrame) -> DataFrame:
    """Gives records without a country that of their city, else postcode, where nine tenths of its records have it.

    Only cities and postcodes of such records are counted.
    """
    out = records.where("country <> ''")
    lost = records.where("country = ''")
    few = lost.count() < BROADCAST_ROWS
    for place in ("city", "postcode"):
        asked = lost.where(f"{place} <> ''").select(place).distinct()
        asked = F.broadcast(asked) if few else asked
        home = records.where(f"country <> '' AND {place} <> ''").select(place, "country").join(asked, place, "left_semi").groupBy(place, "country").agg(F.count("*").alias("n"))
        home = home.groupBy(place).agg(F.sum("n").alias("all"), F.max(F.struct("n", "country")).alias("m")).where("m.n >= 0.9 * all").select(place, F.col("m.country").alias("home"))
        lost = lost.join(home, place, "left").withColumn("country", F.when(F.col("country") == "", F.coalesce("home", F.lit(""))).otherwise(F.col("country"))).select(records.columns)
    return out.unionByName(kept(lost.where("country <> ''")))


def _meetings(records: DataFrame) -> DataFrame:
    """(a, b): ids of S1 and target records that share a bucket and whose signatures are near and trades compatible.

    Buckets with more than BUCKET_PAIRS pairs are parted by house number, as different ones
    contradict each other: records that have one meet those of the same, and those without one
    meet all of the bucket. Parts of more than BLOCK_RECORDS a side become a grid of blocks, of
    which each pair of records has one, so no task holds a hot bucket and none of its pairs is lost.
    """
    known = _at_home(records.select("rid", "side", "country", "city", "postcode", "tables", "sig", "trades"))
    rows = known.withColumn("table", F.explode("tables")).withColumn("key", F.xxhash64("country", "table"))

    def heavy(part: DataFrame, by: str) -> DataFrame:
        n = part.groupBy(by).agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2"))
        return cut(n.where(F.col("n1") * F.col("n2") > BUCKET_PAIRS).select(by))

    def meet(part: DataFrame) -> DataFrame:
        a, b = (part.where(f"side = {s}").select("key", F.col("sig").alias(f"sig_{x}"), F.col("rid").alias(x), F.col("trades").alias(f"trades_{x}")) for s, x in ((1, "a"), (2, "b")))
        off = F.col("sig_a").bitwiseXOR(F.col("sig_b"))
        part = lambda low, bits: F.shiftrightunsigned(off, low).bitwiseAND(F.lit((1 << bits) - 1))
        off_name, off_address, off_number = F.bit_count(part(AT_NAME, NAME_BITS)), F.bit_count(part(AT_ADDRESS, ADDRESS_BITS)), part(AT_NUMBER, NUMBER_BITS)
        # Of trades neither of which holds the other, the bits do so only where they fall together.
        common = F.col("trades_a").bitwiseAND(F.col("trades_b"))
        met = a.join(b, "key").where((common == F.col("trades_a")) | (common == F.col("trades_b"))).select("a", "b", off_name.alias("off_name"), off_address.alias("off_address"), off_number.alias("off_number"), F.col("sig_a").bitwiseAND(F.col("sig_b")).alias("both"), F.col("sig_a").bitwiseOR(F.col("sig_b")).alias("any"))
        named, placed, weak = F.expr("both & 1 <> 0"), F.expr("both & 2 <> 0"), F.expr("any & 4 <> 0")
        n, p = F.col("off_name"), F.col("off_address")
        # House numbers that differ contradict each other here already, by their hash.
        close = F.when(named & placed, (F.col("off_number") == 0) & ((n <= 15) | weak & (p <= 4))).when(named, n <= 14).otherwise(p <= 5)
        return met.where(close).select("a", "b")

    def in_blocks(part: DataFrame) -> DataFrame:
        n = part.groupBy("key").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2"))
        n = cut(n.where((F.col("n1") > 0) & (F.col("n2") > 0) & (F.greatest("n1", "n2") > BLOCK_RECORDS)))
        grid = n.select("key", *(F.ceil(F.col(f"n{s}") / BLOCK_RECORDS).cast("int").alias(f"g{s}") for s in (1, 2)))
        placed = part.join(F.broadcast(grid) if n.count() < BROADCAST_ROWS else grid, "key", "left").fillna(1, ["g1", "g2"])
        own, other = (F.when(F.col("side") == s, F.col("g1")).otherwise(F.col("g2")) for s in (1, 2))
        placed = placed.withColumn("own", F.pmod(F.xxhash64("rid"), own)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), other.cast("bigint") - 1)))
        block = F.when(F.col("side") == 1, F.struct(F.col("own").alias("x"), F.col("other").alias("y"))).otherwise(F.struct(F.col("other").alias("x"), F.col("own").alias("y")))
        return placed.withColumn("block", block).select("rid", "side", "sig", "trades", F.when(F.col("g1") * F.col("g2") > 1, F.xxhash64("key", "block.x", "block.y")).otherwise(F.col("key")).alias("key"))

    # Buckets are first counted by hash classes, which combine before the shuffle; only the few
    # classes that could hold a heavy bucket are counted key by key.
    entries = known.agg(F.sum(F.size("tables"))).first()[0] or 0
    classes = 1 << max(10, (entries // 128).bit_length())
    classed = rows.select("key", "side", F.pmod("key", F.lit(classes)).alias("class"))
    suspect = heavy(classed, "class")
    many = suspect.count()
    hot = heavy(classed.join(F.broadcast(suspect) if many < BROADCAST_ROWS else suspect, "class", "left_semi"), "key") if many else None
    if hot is None or hot.isEmpty():
        met = meet(rows)
    else:
        small = F.broadcast(hot) if hot.count() < BROADCAST_ROWS else hot
        one, placed, named_table = F.col("side") == 1, F.col("sig").bitwiseAND(F.lit(2)) != 0, F.col("table") % len(TABLES) < NAME_TABLES
        same = F.shiftrightunsigned("sig", AT_NUMBER).bitwiseAND(F.lit((1 << NUMBER_BITS) - 1))
        # Parts: a house number; -1, S1 records without one and all targets; -2, S1 records with one and targets without.
        parts = F.array_compact(
            F.array(
                F.when(placed, same),
                F.when(named_table & ~(one & placed), F.lit(-1).cast("bigint")),
                F.when(named_table & (one == placed), F.lit(-2).cast("bigint")),
            )
        )
        parted = kept(rows.join(small, "key")).withColumn("part", F.explode(parts)).withColumn("key", F.xxhash64("key", "part")).select("rid", "side", "sig", "trades", "key")
        met = meet(rows.join(small, "key", "left_anti")).unionByName(meet(in_blocks(parted)))
    return kept(met.dropDuplicates(["a", "b"]))


def pair_features(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, ...] | None:
    """Features of a pair in the order of FEATURES without the last, the cosines left 0; None where parts contradict.

    Parts are those of PARTS. Contradictions: both have house numbers and they differ; both have
    street types and they differ; trades of which neither holds the other; streets or names that
    have nothing in common.
    """
    core_a, trade_a, legal_a, number_a, street_a, stype_a, city_a, postcode_a = a
    core_b, trade_b, legal_b, number_b, street_b, stype_b, city_b, postcode_b = b
    no_name = not core_a or not core_b
    no_address = not (number_a or street_a) or not (number_b or street_b)
    if no_name and no_address or not compatible(trade_a, trade_b):
        return None
    if not no_address and (number_a and number_b and number_a != number_b or stype_a and stype_b and stype_a != stype_b):
        return None
    number = street = stype = city = postcode = name = 0.0
    if not no_address:
        number = float(bool(number_a) and number_a == number_b)
        d = near(street_a, street_b, 2) if street_a and street_b else 2
        if d > 2 or d == 2 and min(len(street_a), len(street_b)) < 5:
            return None
        street = 1 - d / 3
        stype = 1.0 if stype_a == stype_b else 0.5
        if city_a and city_b:
            e = near(city_a, city_b, 2)
            city = 1 - e / 2
            if e > 2 and postcode_a and postcode_b and postcode_a != postcode_b:
                return None
        postcode = 1.0 if postcode_a and postcode_a == postcode_b else -1.0 if postcode_a and postcode_b else 0.0
    if not no_name:
        name = core_likeness(core_a, core_b, loose=not no_address)
        if name < 0.55:
            return None
    legal = 1.0 if legal_a == legal_b else 0.5 if compatible(legal_a, legal_b) else 0.0
    trade = 1.0 if trade_a == trade_b else 0.5
    return name, 0.0, 0.0, trade, legal, number, street, stype, city, postcode, float(no_address), float(no_name)


_FEATURE_SCHEMA = "s1_id string, target_id string, " + ", ".join(f"{f} double" for f in FEATURES[:-1])


def _score_pairs(pairs: DataFrame, model) -> DataFrame:
    """(s1_id, target_id, features) of pairs (parts_a, parts_b), parts in one text.

    Pairs whose parts contradict each other leave first; of the rest the cosines are those of the
    attributes' whole vectors.
    """
    width = len(PARTS)
    at_name, at_address, at_no_address, at_no_name = (FEATURES.index(f) for f in ("cos_name", "cos_address", "no_address", "no_name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept_rows: list[tuple] = []
            place: dict[tuple[str, ...], int] = {}
            sides: list[tuple[int, int]] = []
            for left, right in zip(*map(texts_of, batch.columns)):
                *a, s1_id = left.split("\t", width)
                *b, target_id = right.split("\t", width)
                f = pair_features(tuple(a), tuple(b))
                if f is not None:
                    kept_rows.append((s1_id, target_id, *f))
                    sides.append(tuple(place.setdefault(tuple(x), len(place)) for x in (a, b)))
            cols: list = list(zip(*kept_rows)) or [()] * (2 + len(FEATURES) - 1)
            if kept_rows:
                part, _ = group_vectors([tuple(t if k in RERANKED else "" for k, t in enumerate(record_texts((*x, "")))) for x in place], model.value)
                left, right = np.array(sides, dtype=np.int64).T
                for at, weights, missing in ((at_name, NAME_WEIGHTS, at_no_name), (at_address, ADDRESS_WEIGHTS, at_no_address)):
                    vector = attribute_vectors(part, weights)
                    cols[2 + at] = np.where(np.array(cols[2 + missing]) == 1, 0.0, cosines(vector[left], vector[right]).astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols[:2]] + [pa.array(c, pa.float64()) for c in cols[2:]], names=["s1_id", "target_id", *FEATURES[:-1]])

    return pairs.mapInArrow(uncollected(run), _FEATURE_SCHEMA)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights (first the constant) of a logistic curve by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def match_links(matches: DataFrame) -> DataFrame:
    """(s1_id, target_id) of the known matches, each once, and of labelled records without any a NULL target."""
    rows = matches.where("source1_entity_id IS NOT NULL").select(F.trim("source1_entity_id").alias("s1_id"), F.explode_outer(F.split("matched_entity_ids", ",")).alias("t"))
    return rows.select("s1_id", F.when(F.trim("t") != "", F.trim("t")).alias("target_id")).distinct()


def least_by_hash(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The ``n`` rows of least hash of ``by``, all of a smaller table.

    Only rows below the hash that twice as many are expected under are sorted, so that no task
    sends its own ``n`` rows to the driver.
    """
    total = df.count()
    if total > 2 * n:
        df = df.where(F.shiftrightunsigned(F.xxhash64(*by), 1) < F.lit(int(2 * n / total * 2**63)))
    return df.orderBy(F.shiftrightunsigned(F.xxhash64(*by), 1), *by).limit(n)


def scored_candidates(source1: DataFrame, targets: list[DataFrame]) -> DataFrame:
    """(s1_id, target_id, features): every pair that shares a bucket and contradicts itself nowhere.

    Every delivery of an entity counts, so a pair of which texts were corrected has several rows.
    """
    records = reduce(DataFrame.unionByName, [deliveries(source1, 1), *(deliveries(t, 2) for t in targets)])
    sample = least_by_hash(records, FIT_RECORDS, "eid", "name", "address").collect()
    vectors = train_vectors([record_texts(record_parts(r.name, r.address)) for r in sample])
    model = records.sparkSession.sparkContext.broadcast(vectors)
    records = kept(hashed_records(records, model).withColumn("rid", F.monotonically_increasing_id()))
    met = _meetings(records)
    a, b = (records.where(f"side = {s}").select(F.col("rid").alias(x), F.col("parts").alias(f"parts_{x}")) for s, x in ((1, "a"), (2, "b")))
    pairs = met.join(a, "a").join(b, "b").select("parts_a", "parts_b")
    scored = kept(_score_pairs(pairs, model))
    # S1 records that would do as well for the target: names decide only where they leave one.
    level = F.round(F.when(F.col("no_address") == 1, F.col("name")).otherwise(F.col("street") + F.col("city")), 2)
    # Only pairs that lack a name or an address are counted, as the others have no use for it.
    incomplete = (F.col("no_address") == 1) | (F.col("no_name") == 1)
    partial = scored.where(incomplete)
    best = partial.groupBy("target_id", "no_address", "no_name").agg(F.max(level).alias("top"))
    tied = partial.join(best, ["target_id", "no_address", "no_name"]).where(level >= F.col("top") - 0.11).groupBy("target_id", "no_address", "no_name").agg((F.count_distinct("s1_id") - 1).cast("double").alias("r"))
    partial = partial.join(tied, ["target_id", "no_address", "no_name"]).withColumn("rivals", F.least("r", F.lit(5.0))).select("s1_id", "target_id", *FEATURES)
    return scored.where(~incomplete).withColumn("rivals", F.lit(0.0)).unionByName(partial)


def calibrated(candidates: DataFrame, matches: DataFrame | None) -> DataFrame:
    """Adds ``confidence``, by a logistic curve fitted on FIT_ROWS candidates, at most, of FIT_LABELLED labelled records."""
    weights = UNFITTED
    if matches is not None:
        labelled = F.trim("source1_entity_id").alias("s1_id")
        labelled = least_by_hash(matches.select(labelled).dropna().distinct(), FIT_LABELLED, "s1_id")
        links = match_links(matches.join(F.broadcast(labelled), F.trim("source1_entity_id") == labelled.s1_id, "left_semi"))
        known = candidates.join(F.broadcast(labelled), "s1_id").join(links.where("target_id IS NOT NULL").withColumn("y", F.lit(1.0)), ["s1_id", "target_id"], "left").fillna(0.0, ["y"])
        fit = least_by_hash(kept(known), FIT_ROWS, "s1_id", "target_id").select(*FEATURES, "y").toPandas()
        if fit.y.nunique() > 1:
            weights = fit_logistic(fit[list(FEATURES)].to_numpy(), fit.y.to_numpy())
    score = reduce(lambda s, kw: s + F.col(kw[0]) * float(kw[1]), zip(FEATURES, weights[1:]), F.lit(float(weights[0])))
    return candidates.withColumn("confidence", 1 / (1 + F.exp(-score)))


def match_entities(source1: DataFrame, targets: list[DataFrame], matches: DataFrame | None, least: float = 0.5) -> DataFrame:
    """(s1_id, target_id, confidence) of pairs that are one organisation at one place.

    Sources have entity_id, business_name, business_address and country; an entity delivered
    several times matches by any of its texts. A record without a country that its city or postcode
    tells, or without name and address, matches nothing. A target takes the S1 record of highest
    confidence, or all of one highest confidence.
    """
    scored = calibrated(scored_candidates(source1, targets), matches).where(F.col("confidence") >= least)
    # By target, so that one shuffle and one sort serve all that follows.
    scored = scored.select("s1_id", "target_id", "confidence").withColumn("top", F.max("confidence").over(Window.partitionBy("target_id")))
    return scored.where("confidence >= top - 1e-9").groupBy("s1_id", "target_id").agg(F.max("confidence").alias("confidence"))
