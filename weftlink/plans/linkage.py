"""Queries of the record-linkage operators, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions.text import AFFIX_ROUTES, GRAM_ROUTES, ROUTES, THRESHOLDS, TOKEN_ROUTES, eligible, id_list, in_sample, list_cardinality, long_numbers, qgrams, shard_of, split_of, view_text, word_tokens
from weftlink.operators import blocking, evaluation, features, metrics, output, pairs, vectors
from weftlink.operators.model import feature_importance, fit_matcher, score_pairs
from weftlink.sources.readers import latest_entities, normalized_source, truth_links
from weftlink.session import cut, kept, spread
from weftlink.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- views, here and in SQL


def s1(spark: SparkSession, d: str) -> DataFrame:
    return normalized_source(spread(latest_entities(table(spark, d, "train_source1"))), 1, with_split=True)


def targets(spark: SparkSession, d: str) -> DataFrame:
    two, three = (normalized_source(spread(latest_entities(table(spark, d, f"train_source{n}"))), n) for n in (2, 3))
    return two.unionByName(three)


def links(spark: SparkSession, d: str) -> DataFrame:
    return truth_links(table(spark, d, "train_matches"))


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs as scored last; NaN priorities count as none."""
    p = table(spark, d, "pairs").withColumn("retrieval_priority", F.when(~F.isnan("retrieval_priority"), F.col("retrieval_priority")))
    cols = [c for c in p.columns if c not in ("s1_id", "target_id", "scored_at")]
    last = p.where("s1_id IS NOT NULL AND target_id IS NOT NULL").groupBy("s1_id", "target_id").agg(F.max(F.struct("scored_at", "retrieval_priority", *(c for c in cols if c != "retrieval_priority"))).alias("m"))
    return last.select("s1_id", "target_id", "m.*")


def known_links(spark: SparkSession, d: str) -> DataFrame:
    """Known links with the S1 record's country and the target's source."""
    a = s1(spark, d).select(F.col("entity_id").alias("s1_id"), "country")
    return links(spark, d).join(blocking.merged(a), "s1_id")


def vector_records(spark: SparkSession, d: str, number: int | None = None) -> DataFrame:
    """Vectors as records: id and source by vec_id modulo 3, the label as country."""
    e = table(spark, d, "embeddings").select(F.col("vec_id"), (F.pmod(F.col("vec_id"), F.lit(3)) + 1).alias("s"), F.col("embedding").alias("vec"), F.concat(F.lit("L"), F.col("label")).alias("country"))
    e = e.withColumn("id", F.concat(F.lit("S"), F.col("s"), F.lit("-"), F.col("vec_id")))
    return e.where(F.col("s") == number if number else F.col("s") > 1).select("id", "country", F.concat(F.lit("S"), F.col("s")).alias("source"), "vec", "vec_id")


FULL_WIDTH = "".join(chr(0xFF01 + i) for i in range(94))
ASCII = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def sql_norm(col: str) -> str:
    text = f"translate(replace(replace(coalesce({col}, ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '{FULL_WIDTH}', '{ASCII}')"
    return f"trim(regexp_replace(lower(regexp_replace(strip_accents({text}), '\\p{{M}}+', '', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _sql_entities(n: int) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ("loaded_at", "business_name", "business_address", "country"))
    return f"SELECT entity_id, business_name, business_address, country, 'S{n}' AS source FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {order}) AS k FROM train_source{n} WHERE entity_id IS NOT NULL) WHERE k = 1"


VIEWS = f"""WITH raw_e AS ({_sql_entities(1)} UNION ALL {_sql_entities(2)} UNION ALL {_sql_entities(3)}),
e0 AS (SELECT entity_id, coalesce(business_name, '') AS business_name, coalesce(business_address, '') AS business_address, country, source, {sql_norm('business_name')} AS name_norm, {sql_norm('business_address')} AS address_norm FROM raw_e),
e AS MATERIALIZED (SELECT *, replace(name_norm, ' ', '') AS name_compact, replace(address_norm, ' ', '') AS address_compact FROM e0),
s1 AS (SELECT *, CASE WHEN CAST(substr(entity_id, 4) AS BIGINT) % 100 < 80 THEN 'train' WHEN CAST(substr(entity_id, 4) AS BIGINT) % 100 < 90 THEN 'calibration' ELSE 'holdout' END AS split FROM e WHERE source = 'S1'),
t AS (SELECT * FROM e WHERE source <> 'S1'),
links AS MATERIALIZED (SELECT DISTINCT source1_entity_id AS s1_id, target_id, CASE WHEN target_id LIKE 'S2-%' THEN 'S2' WHEN target_id LIKE 'S3-%' THEN 'S3' END AS source FROM (SELECT source1_entity_id, trim(unnest(string_split(matched_entity_ids, ','))) AS target_id FROM train_matches) WHERE target_id <> ''),
kl AS (SELECT links.*, s1.country FROM links JOIN s1 ON s1.entity_id = s1_id)
"""
_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')".format
_GRAM = "list_distinct(list_transform(range(1, greatest(length({c}) - {n} + 2, 1)), lambda i: substr({c}, i, {n})))"
_TOKENS = "list_distinct(list_filter(string_split({c}, ' '), lambda x: length(x) >= 3 AND regexp_matches(x, '\\p{{L}}')))"
_NUMBERS = "list_distinct(regexp_extract_all({c}, '\\p{{Nd}}{{4,}}'))"
_ROUTE_SQL = {
    "exact_name": "[name_compact]",
    "exact_address": "[address_compact]",
    "name_tokens": _TOKENS.format(c="name_norm"),
    "address_tokens": _TOKENS.format(c="address_norm"),
    "address_numbers": _NUMBERS.format(c="address_norm"),
    "name_char4": _GRAM.format(c="name_compact", n=4),
    "address_char5": _GRAM.format(c="address_compact", n=5),
}
_AFFIX_SQL = {f"{side}_{end}": f"list_distinct(list_transform(list_filter({_TOKENS.format(c=side + '_norm')}, lambda x: length(x) >= 5), lambda x: {'right' if end == 'suffixes' else 'left'}(x, 4)))" for side in ("name", "address") for end in ("prefixes", "suffixes")}


def _keys_sql(name: str, routes: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT entity_id AS id, source, country, '{r}' AS route, unnest({x}) AS key FROM e" for r, x in routes.items())
    return f", {name} AS MATERIALIZED (SELECT DISTINCT * FROM ({rows}) WHERE key <> '')"


KEYS = (
    VIEWS
    + _keys_sql("k", _ROUTE_SQL)
    + ", caps(route, w, m1, m2) AS (VALUES "
    + ", ".join(f"('{r}', CAST({w} AS DOUBLE), {a}, {b})" for r, (w, a, b) in ROUTES.items())
    + ")"
    + """, s1k AS (SELECT * FROM k WHERE source = 'S1'), tk AS (SELECT * FROM k WHERE source <> 'S1'),
all_df AS (SELECT route, country, key, count(*) AS df FROM s1k GROUP BY ALL),
sdf AS (SELECT a.* FROM all_df a JOIN caps USING (route) WHERE df <= m1),
tdf AS (SELECT tk.source, route, country, key, count(*) AS target_df FROM tk JOIN sdf USING (route, country, key) GROUP BY ALL),
idx AS (SELECT tk.id AS target_id, tk.source, route, country, key, df AS s1_df, target_df FROM tk JOIN sdf USING (route, country, key) JOIN tdf USING (source, route, country, key) JOIN caps USING (route) WHERE target_df <= m2),
sc AS (SELECT s1k.id AS s1_id, target_id, idx.source, country, route, key, CAST(round(w / sqrt(s1_df) * 1e12) AS BIGINT) AS route_score, s1_df FROM s1k JOIN idx USING (route, country, key) JOIN caps USING (route)),
ev AS (SELECT s1_id, target_id, source, country, CAST(sum(route_score) AS DOUBLE) / 1e12 AS classical_evidence, count(DISTINCT route) AS classical_route_count, count(*) AS classical_shared_keys, min(s1_df) AS classical_best_df FROM sc GROUP BY ALL)
"""
)
_RANK = "classical_evidence DESC, classical_route_count DESC, classical_shared_keys DESC, classical_best_df ASC"
CANDIDATES = KEYS + f", cand AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id, source ORDER BY {_RANK}, target_id) AS INTEGER) AS classical_rank FROM ev) WHERE classical_rank <= 30)"
PAIRS = """WITH p0 AS (SELECT * REPLACE (CASE WHEN isnan(retrieval_priority) THEN NULL ELSE retrieval_priority END AS retrieval_priority) FROM pairs WHERE s1_id IS NOT NULL AND target_id IS NOT NULL),
p AS MATERIALIZED (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, target_id ORDER BY scored_at DESC NULLS LAST, retrieval_priority DESC NULLS LAST, source DESC NULLS LAST, country DESC NULLS LAST, classical_evidence DESC NULLS LAST, classical_route_count DESC NULLS LAST, classical_shared_keys DESC NULLS LAST, classical_best_df DESC NULLS LAST) AS k FROM p0) WHERE k = 1)
"""
_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))"
VECTORS = "WITH v AS (SELECT vec_id, 'S' || (vec_id % 3 + 1) || '-' || vec_id AS id, vec_id % 3 + 1 AS s, 'L' || label AS country, embedding FROM embeddings)"


def _top_sql(name: str, k: int, a: str = "embedding") -> str:
    return f"{name} AS (SELECT * FROM (SELECT a.id AS s1_id, b.id AS target_id, a.country, 'S' || b.s AS source, round({_DOT}, 9) + 0 AS ann_score, CAST(row_number() OVER (PARTITION BY a.id, b.s ORDER BY round({_DOT}, 9) DESC, b.id) AS INTEGER) AS ann_rank FROM v a JOIN v b ON a.country = b.country AND a.s = 1 AND b.s > 1) WHERE ann_rank <= {k})"


# ---------------------------------------------------------------- sources, normalisation, audit


@query(
    " UNION ALL ".join(
        f"SELECT 'S{n}' AS source, count(*) AS n_rows, count(DISTINCT entity_id) AS unique_ids, CAST(count(*) FILTER (entity_id NOT LIKE 'S{n}-%') AS BIGINT) AS bad_prefixes, count(*) FILTER (business_name IS NULL) AS null_business_name, count(*) FILTER (business_address IS NULL) AS null_business_address, count(*) FILTER (country IS NULL) AS null_country FROM train_source{n}"
        for n in (1, 2, 3)
    )
)
def audit_source(spark, d):
    one, two, three = (evaluation.audit_source(table(spark, d, f"train_source{n}"), f"S{n}") for n in (1, 2, 3))
    return one.unionByName(two).unionByName(three)


@query(" UNION ALL ".join(f"SELECT 'S{n}' AS source, country, count(*) AS n_rows FROM train_source{n} GROUP BY country" for n in (1, 2, 3)))
def audit_countries(spark, d):
    return evaluation.audit_countries({f"S{n}": table(spark, d, f"train_source{n}") for n in (1, 2, 3)})


@query(VIEWS + "SELECT CAST(substr(entity_id, 4) AS BIGINT) % 7 AS shard, split, count(*) AS n FROM s1 GROUP BY ALL")
def shard_counts(spark, d):
    """Records of each of seven shards by id and of each split."""
    return s1(spark, d).groupBy(shard_of(F.col("entity_id"), 7).alias("shard"), "split").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_rows, count(DISTINCT source1_entity_id) AS unique_ids, count(*) FILTER (matched_entity_ids IS NULL) AS singletons, CAST(sum(c) AS BIGINT) AS links, round(avg(c), 6) AS mean_links, max(c) AS most_links FROM (SELECT *, CAST(CASE WHEN matched_entity_ids IS NULL THEN 0 ELSE length(matched_entity_ids) - length(replace(matched_entity_ids, ',', '')) + 1 END AS BIGINT) AS c FROM train_matches)")
def audit_ground_truth(spark, d):
    t = table(spark, d, "train_matches").withColumn("c", list_cardinality(F.col("matched_entity_ids")))
    return t.agg(F.count("*").alias("n_rows"), F.count_distinct("source1_entity_id").alias("unique_ids"), F.count_if(F.col("matched_entity_ids").isNull()).alias("singletons"), F.sum("c").alias("links"), F.round(F.avg("c"), 6).alias("mean_links"), F.max("c").alias("most_links"))


@query("SELECT CAST(CASE WHEN matched_entity_ids IS NULL THEN 0 ELSE length(matched_entity_ids) - length(replace(matched_entity_ids, ',', '')) + 1 END AS BIGINT) AS links, count(*) AS n_rows FROM train_matches GROUP BY 1")
def audit_cardinalities(spark, d):
    return table(spark, d, "train_matches").groupBy(list_cardinality(F.col("matched_entity_ids")).alias("links")).agg(F.count("*").alias("n_rows"))


@query(VIEWS + "SELECT split, country, count(*) AS n FROM s1 GROUP BY ALL")
def split_counts(spark, d):
    return s1(spark, d).groupBy("split", "country").agg(F.count("*").alias("n"))


@query(VIEWS + "SELECT entity_id FROM s1 WHERE CAST(substr(entity_id, 4) AS BIGINT) % 1000 >= 990")
def holdout_sample(spark, d):
    return s1(spark, d).where(in_sample(F.col("entity_id"), 10)).select("entity_id")


@query(VIEWS + "SELECT entity_id, source, name_norm, address_norm FROM e")
def normalize_text_fields(spark, d):
    cols = ["entity_id", "source", "name_norm", "address_norm"]
    return s1(spark, d).select(cols).unionByName(targets(spark, d).select(cols))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Normalised records of all three sources."""
    return s1(spark, d).drop("split").unionByName(targets(spark, d))


@query(VIEWS + "SELECT entity_id, name_compact, address_compact FROM e")
def compact_keys(spark, d):
    return entities(spark, d).select("entity_id", "name_compact", "address_compact")


def _joined(f, column):
    return lambda spark, d: entities(spark, d).select("entity_id", F.array_join(F.array_sort(f(F.col(column))), "|").alias("items"))


for _name, _f, _col, _sql in (
    ("word_tokens", word_tokens, "name_norm", _TOKENS.format(c="name_norm")),
    ("address_word_tokens", word_tokens, "address_norm", _TOKENS.format(c="address_norm")),
    ("long_numbers", long_numbers, "address_norm", _NUMBERS.format(c="address_norm")),
    ("qgrams_4", lambda c: qgrams(c, 4), "name_compact", _GRAM.format(c="name_compact", n=4)),
    ("qgrams_5", lambda c: qgrams(c, 5), "address_compact", _GRAM.format(c="address_compact", n=5)),
):
    QUERIES[_name] = _joined(_f, _col)
    ORACLE[_name] = VIEWS + f"SELECT entity_id, coalesce(array_to_string(list_sort({_sql}), '|'), '') AS items FROM e"


@query(VIEWS + "SELECT entity_id, country, " + ", ".join(f"coalesce(array_to_string(list_sort({x}), '|'), '') AS {n}" for n, x in _AFFIX_SQL.items()) + " FROM e")
def affix_keys(spark, d):
    out = blocking.affixes(entities(spark, d))
    return out.select("entity_id", "country", *(F.array_join(F.array_sort(c), "|").alias(c) for c in out.columns[2:]))


@query(VIEWS + f"SELECT entity_id, 'query: ' || {_STRIP('business_name')} AS name_text, 'query: ' || {_STRIP('business_address')} AS address_text, 'query: business name: ' || {_STRIP('business_name')} || '; business address: ' || {_STRIP('business_address')} AS combined_text FROM e")
def view_texts(spark, d):
    n, a = F.col("business_name"), F.col("business_address")
    return entities(spark, d).select("entity_id", *(view_text(n, a, v).alias(f"{v}_text") for v in ("name", "address", "combined")))


@query("SELECT source1_entity_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(matched_entity_ids, ''), ','), lambda x: trim(x)), lambda x: x <> ''))), ',') AS ids FROM train_matches")
def parse_id_lists(spark, d):
    return table(spark, d, "train_matches").select("source1_entity_id", F.array_join(F.array_sort(id_list(F.col("matched_entity_ids"))), ",").alias("ids"))


@query(VIEWS + "SELECT * FROM links")
def truth_link_rows(spark, d):
    return links(spark, d)


# ---------------------------------------------------------------- blocking and evaluation


def _normalized(spark, d):
    """S1 and target records with their texts normalised once, for plans that explode them several times."""
    cols = ["entity_id", "source", "country", "name_norm", "address_norm", "name_compact", "address_compact"]
    return kept(s1(spark, d).select(cols)), kept(targets(spark, d).select(cols))


def _keys(spark, d, routes=tuple(ROUTES)):
    return tuple(blocking.exploded_keys(df, routes) for df in _normalized(spark, d))


@query(KEYS + "SELECT route, country, key, df FROM all_df")
def document_frequency(spark, d):
    return blocking.document_frequency(blocking.exploded_keys(s1(spark, d)))


@query(KEYS + "SELECT route, country, key, df AS s1_df FROM sdf")
def s1_df_capped(spark, d):
    return blocking.capped_frequency(blocking.exploded_keys(s1(spark, d)))


@query(KEYS + "SELECT target_id, source, country, route, key, s1_df, target_df FROM idx")
def blocking_index(spark, d):
    return blocking.blocking_index(*_keys(spark, d))


_EXACT = {"exact_name": "name_compact", "exact_address": "address_compact"}


@query(VIEWS + " UNION ALL ".join(f"SELECT s1.entity_id AS s1_id, t.entity_id AS target_id, t.source, s1.country, '{r}' AS route, CAST(5.0 AS DOUBLE) AS score, 1 AS shared, 0 AS best_df FROM s1 JOIN t ON s1.country = t.country AND s1.{c} = t.{c} WHERE s1.{c} <> ''" for r, c in _EXACT.items()))
def exact_pairs(spark, d):
    return blocking.exact_pairs(s1(spark, d), targets(spark, d), _EXACT)


def _exact(spark, d):
    cols = ["entity_id", "source", "country", "name_compact", "address_compact"]
    return s1(spark, d).select(cols), targets(spark, d).select(cols)


@query(
    VIEWS
    + "SELECT a AS name_volume, b AS address_volume, c AS both_volume, a + b - c AS union_volume FROM "
    + ", ".join(f"(SELECT CAST(count(*) AS BIGINT) AS {n} FROM s1 JOIN t ON s1.country = t.country AND {on})" for n, on in (("a", "s1.name_compact = t.name_compact AND s1.name_compact <> ''"), ("b", "s1.address_compact = t.address_compact AND s1.address_compact <> ''"), ("c", "s1.name_compact = t.name_compact AND s1.name_compact <> '' AND s1.address_compact = t.address_compact AND s1.address_compact <> ''")))
)
def exact_candidate_volume(spark, d):
    a, b = _exact(spark, d)
    parts = [blocking.join_volume(a, b, ["country", *k]).select(F.col("volume").alias(n)) for n, k in (("name_volume", ["name_compact"]), ("address_volume", ["address_compact"]), ("both_volume", ["name_compact", "address_compact"]))]
    out = parts[0].crossJoin(parts[1]).crossJoin(parts[2])
    return out.withColumn("union_volume", F.expr("name_volume + address_volume - both_volume"))


def _sql_plain(col: str) -> str:
    text = f"nfc_normalize(translate(replace(replace(coalesce({col}, ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '{FULL_WIDTH}', '{ASCII}'))"
    return f"replace(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g')), ' ', '')"


_FOUR = "x AS MATERIALIZED (SELECT entity_id, source, country, name_compact AS name_folded, address_compact AS address_folded, " + ", ".join(f"{_sql_plain('business_' + c)} AS {c}_plain" for c in ("name", "address")) + " FROM e)"
_SAME = {k: f"(a.{k} <> '' AND a.{k} = b.{k})" for k in blocking.EXACT_KEYS}


@query(VIEWS.rstrip() + ", " + _FOUR + " SELECT entity_id, source, country, " + ", ".join(blocking.EXACT_KEYS) + " FROM x")
def exact_keys(spark, d):
    return blocking.exact_keys(entities(spark, d)).select("entity_id", "source", "country", *blocking.EXACT_KEYS)


@query(
    VIEWS.rstrip() + ", " + _FOUR + ", f AS (SELECT b.source, a.country, " + ", ".join(f"{c} AS {k}" for k, c in _SAME.items()) + " FROM links JOIN x a ON a.entity_id = s1_id JOIN x b ON b.entity_id = target_id)"
    + ", r AS (SELECT source, country, count(*) AS links, " + ", ".join(f"count(*) FILTER ({k}) AS {k}_links" for k in _SAME) + f", count(*) FILTER ({' OR '.join(_SAME)}) AS union_links, grouping(country) = 1 AS is_total FROM f GROUP BY GROUPING SETS ((source, country), (source)))"
    + " SELECT *, round(union_links / links, 6) AS union_recall FROM r"
)
def exact_recall(spark, d):
    return evaluation.exact_recall(links(spark, d), blocking.exact_keys(s1(spark, d)), blocking.exact_keys(targets(spark, d)), blocking.EXACT_KEYS)


@query(KEYS + "SELECT s1_id, target_id, source, country, route, CAST(sum(route_score) AS DOUBLE) / 1e12 AS evidence, count(*) AS shared, min(s1_df) AS best_df FROM sc WHERE route NOT LIKE 'exact%' GROUP BY ALL")
def key_pairs(spark, d):
    """Evidence of each pair by route, of all routes that count by frequency."""
    routes = tuple(r for r in ROUTES if not r.startswith("exact"))
    a, b = _keys(spark, d, routes)
    scores = blocking.route_scores(a, blocking.blocking_index(a, b))
    return scores.groupBy("s1_id", "target_id", "source", "country", "route").agg((F.sum("route_score") / blocking.UNIT).alias("evidence"), F.count("*").alias("shared"), F.min("s1_df").alias("best_df"))


_EVERY = tuple(ROUTES) + AFFIX_ROUTES
MINIMA = (
    KEYS.rstrip()
    + _keys_sql("ak", _AFFIX_SQL)
    + """, ks1 AS MATERIALIZED (SELECT * FROM s1k UNION ALL SELECT * FROM ak WHERE source = 'S1'), kt AS (SELECT * FROM tk UNION ALL SELECT * FROM ak WHERE source <> 'S1'),
every_df AS (SELECT route, country, key, count(*) AS df FROM ks1 GROUP BY ALL),
mins AS MATERIALIZED (SELECT s1_id, target_id, ks1.route, min(df) AS min_df FROM links JOIN ks1 ON ks1.id = s1_id JOIN kt ON kt.id = target_id AND kt.country = ks1.country AND kt.route = ks1.route AND kt.key = ks1.key JOIN every_df ON every_df.route = ks1.route AND every_df.country = ks1.country AND every_df.key = ks1.key GROUP BY s1_id, target_id, ks1.route)
"""
)


def _minima(spark, d, routes=_EVERY):
    """Labelled pairs and the rarest key they share by route; target keys are exploded for labelled targets only."""
    a, b = _normalized(spark, d)
    known = links(spark, d)
    few = b.join(known.select(F.col("target_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    keys = blocking.exploded_keys(a, routes)
    mine = blocking.exploded_keys(a.join(known.select(F.col("s1_id").alias("entity_id")).distinct(), "entity_id", "left_semi"), routes)
    minima = evaluation.minimum_shared_df(known, mine, blocking.exploded_keys(few, routes), blocking.document_frequency(keys))
    return evaluation.labelled_pairs(known, a, b), minima


@query(MINIMA + "SELECT s1_id, target_id, route, min_df FROM mins")
def min_shared_df(spark, d):
    return _minima(spark, d)[1]


def _occurrences_sql(keys: str, df: str, sides: str = "ks1") -> str:
    ths = ", ".join(f"(CAST({t} AS BIGINT))" for t in THRESHOLDS)
    return f", tall AS (SELECT source, route, country, key, count(*) AS target_df FROM {keys} GROUP BY ALL), occ AS (SELECT tall.source, a.route, a.country, threshold, CAST(sum(a.df * target_df) AS BIGINT) AS occurrences, count(*) AS eligible_keys FROM {df} a JOIN tall USING (route, country, key) JOIN (VALUES {ths}) AS th(threshold) ON a.df <= threshold GROUP BY ALL)"


_STEPS = MINIMA + _occurrences_sql("kt", "every_df")


def _occurrences(spark, d):
    a, b = _keys(spark, d, _EVERY)
    frequency = blocking.document_frequency(a)
    return evaluation.candidate_occurrences(frequency, frequency.withColumnRenamed("df", "s1_df"), b)


@query(_STEPS + "SELECT * FROM occ")
def candidate_occurrences(spark, d):
    return _occurrences(spark, d)


@query(_STEPS + "SELECT source, route, threshold, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM occ GROUP BY ALL")
def candidate_distribution(spark, d):
    return _occurrences(spark, d).groupBy("source", "route", "threshold").agg(F.sum("occurrences").alias("occurrences"))


def _any_sql(routes, limit="threshold") -> str:
    return "(" + " OR ".join(f"coalesce({r} <= {limit}, false)" for r in routes) + ")"


_TOKEN_HIT, _AFFIX_HIT = _any_sql(TOKEN_ROUTES), _any_sql(AFFIX_ROUTES)
_WIDE = (
    MINIMA
    + ", wide AS (SELECT s1_id, target_id, "
    + ", ".join(f"min(min_df) FILTER (route = '{r}') AS {r}" for r in _EVERY)
    + " FROM mins GROUP BY s1_id, target_id)"
    + ", base AS (SELECT links.s1_id, links.target_id, t.source, s1.country, (s1.name_compact <> '' AND s1.name_compact = t.name_compact OR s1.address_compact <> '' AND s1.address_compact = t.address_compact) AS x, "
    + ", ".join(r for r in _EVERY)
    + " FROM links JOIN s1 ON s1.entity_id = s1_id JOIN t ON t.entity_id = target_id LEFT JOIN wide ON wide.s1_id = links.s1_id AND wide.target_id = links.target_id), th(threshold) AS (VALUES "
    + ", ".join(f"(CAST({t} AS BIGINT))" for t in THRESHOLDS)
    + ")"
)
_COUNTS = {f"{r}_links": _any_sql([r]) for r in TOKEN_ROUTES + AFFIX_ROUTES} | {
    "union_links": f"{_TOKEN_HIT} OR {_AFFIX_HIT}", "token_links": _TOKEN_HIT, "char_links": _AFFIX_HIT, "exact_links": "x", "marginal_links": f"({_TOKEN_HIT} OR {_AFFIX_HIT}) AND NOT x",
    "char_marginal_links": f"{_AFFIX_HIT} AND NOT {_TOKEN_HIT} AND NOT x", "combined_links": f"{_TOKEN_HIT} OR {_AFFIX_HIT} OR x",
}
_NAME_GRAM, _ADDRESS_GRAM = (_any_sql([r]) for r in GRAM_ROUTES)
_BASE_HIT = f"(x OR {_any_sql(TOKEN_ROUTES, '100')})"
_GRAM_COUNTS = {
    "baseline_links": _BASE_HIT, "name_gram_links": _NAME_GRAM, "address_gram_links": _ADDRESS_GRAM, "name_gram_marginal": f"{_NAME_GRAM} AND NOT {_BASE_HIT}",
    "address_gram_marginal": f"{_ADDRESS_GRAM} AND NOT {_NAME_GRAM} AND NOT {_BASE_HIT}", "combined_links": f"{_BASE_HIT} OR {_NAME_GRAM} OR {_ADDRESS_GRAM}",
}


def _recall_sql(counts: dict[str, str], shares: tuple[str, ...]) -> str:
    rec = ", rec AS (SELECT source, threshold, country, count(*) AS links, " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in counts.items()) + " FROM base CROSS JOIN th GROUP BY source, threshold, country)"
    return _WIDE + rec + ", rated AS (SELECT *, " + ", ".join(f"round({n}_links / links, 6) AS {n}_recall" for n in shares) + " FROM rec)"


RECALL = _recall_sql(_COUNTS, ("union", "exact", "combined"))


def _recall(spark, d):
    return evaluation.recall_table(*_minima(spark, d, TOKEN_ROUTES + AFFIX_ROUTES))


@query(RECALL + "SELECT * FROM rated")
def retrieval_recall_table(spark, d):
    return _recall(spark, d)


@query(RECALL + "SELECT source, threshold, CAST(sum(links) AS BIGINT) AS links, CAST(sum(token_links) AS BIGINT) AS token_links, CAST(sum(char_links) AS BIGINT) AS char_links, CAST(sum(combined_links) AS BIGINT) AS combined_links FROM rec GROUP BY source, threshold")
def retrieval_recall_summary(spark, d):
    return _recall(spark, d).groupBy("source", "threshold").agg(*(F.sum(c).alias(c) for c in ("links", "token_links", "char_links", "combined_links")))


@query(_recall_sql(_GRAM_COUNTS, ("baseline", "combined")) + "SELECT * FROM rated")
def qgram_recall_table(spark, d):
    return evaluation.qgram_recall_table(*_minima(spark, d, TOKEN_ROUTES + GRAM_ROUTES))


@query(CANDIDATES + "SELECT s1_id, target_id, source, country, round(classical_evidence, 6) AS classical_evidence, classical_route_count, classical_shared_keys, classical_best_df, classical_rank FROM cand")
def classical_candidates_topk(spark, d):
    return blocking.classical_candidates(*_normalized(spark, d)).withColumn("classical_evidence", F.round("classical_evidence", 6))


_BY_TARGET = (
    KEYS.rstrip()
    + """, wk AS (SELECT * FROM tk WHERE id IN (SELECT target_id FROM links)),
xsc AS (SELECT s1k.id AS s1_id, wk.id AS target_id, wk.source, country, route, CASE WHEN route LIKE 'exact%' THEN 5000000000000 ELSE CAST(round(w / sqrt(df) * 1e12) AS BIGINT) END AS score, CASE WHEN route LIKE 'exact%' THEN 0 ELSE df END AS df FROM s1k JOIN wk USING (route, country, key) JOIN all_df USING (route, country, key) JOIN caps USING (route) WHERE route LIKE 'exact%' OR df <= m1),
xev AS (SELECT s1_id, target_id, source, country, CAST(sum(score) AS DOUBLE) / 1e12 AS classical_evidence, count(DISTINCT route) AS classical_route_count, count(*) AS classical_shared_keys, min(df) AS classical_best_df FROM xsc GROUP BY ALL)"""
    + f", ranked AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY {_RANK}, s1_id) AS INTEGER) AS rank FROM xev)"
)


def _by_target(spark, d):
    return blocking.ranked(blocking.target_evidence(*_normalized(spark, d), links(spark, d)), ["target_id"], "s1_id", None, "rank")


@query(_BY_TARGET + "SELECT target_id, s1_id, source, round(classical_evidence, 6) AS classical_evidence, classical_route_count, classical_shared_keys, classical_best_df, rank FROM ranked WHERE rank <= 20")
def ranked_by_evidence(spark, d):
    return _by_target(spark, d).where("rank <= 20").select("target_id", "s1_id", "source", F.round("classical_evidence", 6).alias("classical_evidence"), "classical_route_count", "classical_shared_keys", "classical_best_df", "rank")


_KS = (1, 2, 3, 5, 10, 20)
_K_VALUES = "(VALUES " + ", ".join(f"(CAST({k} AS BIGINT))" for k in _KS) + ") AS kk(k)"


def _recall_at_sql(ranked: str, rank: str, links: str = "kl") -> str:
    return f" SELECT {links}.source, {links}.country, k, count(*) AS links, count(*) FILTER ({rank} <= k) AS retrieved, round(count(*) FILTER ({rank} <= k) / count(*), 6) AS recall FROM {links} LEFT JOIN (SELECT s1_id, target_id, min({rank}) AS {rank} FROM {ranked} GROUP BY ALL) q USING (s1_id, target_id) CROSS JOIN {_K_VALUES} GROUP BY ALL"


def _totals_sql(ranked: str, rank: str, links: str = "kl") -> str:
    best = f"(SELECT source, s1_id, target_id, min({rank}) AS r FROM {ranked} GROUP BY ALL)"
    return (
        f" SELECT source, k, links, retrieved, round(retrieved / links, 6) AS recall, coalesce(pairs, 0) AS pairs, coalesce(mean_candidates, 0) AS mean_candidates, round(uncut / links, 6) AS uncut_recall FROM (SELECT {links}.source, k, count(*) AS links, count(*) FILTER (r <= k) AS retrieved, count(r) AS uncut FROM {links} LEFT JOIN (SELECT s1_id, target_id, r FROM {best}) q USING (s1_id, target_id) CROSS JOIN {_K_VALUES} GROUP BY ALL)"
        f" LEFT JOIN (SELECT source, k, CAST(sum(n) AS BIGINT) AS pairs, round(avg(n), 6) AS mean_candidates FROM (SELECT source, k, target_id, count(*) AS n FROM {best} b JOIN {_K_VALUES} ON r <= k GROUP BY ALL) GROUP BY source, k) USING (source, k)"
    )


@query(_BY_TARGET + _recall_at_sql("ranked", "rank"))
def recall_at_k(spark, d):
    return evaluation.recall_at(_by_target(spark, d), known_links(spark, d), _KS, "rank")


@query(_BY_TARGET + _totals_sql("ranked", "rank"))
def recall_totals(spark, d):
    return evaluation.recall_totals(cut(_by_target(spark, d)), known_links(spark, d), _KS, "rank")


@query(_BY_TARGET + "SELECT source, count(*) AS groups, round(avg(n), 6) AS mean, median(n) AS median, CAST(quantile_disc(n, 0.95) AS DOUBLE) AS p95, max(n) AS most FROM (SELECT source, target_id, count(*) AS n FROM ranked GROUP BY ALL) GROUP BY source")
def candidate_count_distribution(spark, d):
    return evaluation.count_distribution(_by_target(spark, d), "target_id")


# ---------------------------------------------------------------- vectors


@query(VECTORS + ", " + _top_sql("ann", 20) + " SELECT * FROM ann")
def ann_exact_topk(spark, d):
    return vectors.exact_top_k(vector_records(spark, d, 1), vector_records(spark, d), 20)


def _fixed_cells(spark, d):
    """The four lowest vectors of each country and source as centroids, so that SQL can name them."""
    order = evaluation.Window.partitionBy("country", "source").orderBy("vec_id")
    ranked = vector_records(spark, d).withColumn("cell", F.row_number().over(order))
    return ranked.where("cell <= 4").select("country", "source", "cell", F.col("vec").alias("centroid"))


@query(
    VECTORS
    + ", c AS (SELECT country, s AS of, embedding, cell FROM (SELECT *, row_number() OVER (PARTITION BY country, s ORDER BY vec_id) AS cell FROM v WHERE s > 1) WHERE cell <= 4)"
    + f", n AS (SELECT a.id, a.s, b.of, a.country, a.embedding, b.cell, row_number() OVER (PARTITION BY a.id, b.of ORDER BY round({_DOT}, 9) DESC, b.cell) AS r FROM v a JOIN c b ON a.country = b.country AND (a.s = 1 OR a.s = b.of))"
    + f" SELECT * FROM (SELECT a.id AS s1_id, b.id AS target_id, a.country, 'S' || b.s AS source, round({_DOT}, 9) AS ann_score, CAST(row_number() OVER (PARTITION BY a.id, b.s ORDER BY round({_DOT}, 9) DESC, b.id) AS INTEGER) AS ann_rank FROM n a JOIN n b ON a.country = b.country AND a.of = b.of AND a.cell = b.cell AND a.s = 1 AND b.s > 1 AND a.r <= 2 AND b.r = 1) WHERE ann_rank <= 20"
)
def ann_ivf_topk(spark, d):
    return vectors.inverted_top_k(vector_records(spark, d, 1), vector_records(spark, d), _fixed_cells(spark, d), 20, 2)


#: Lists a country, at most, and probes of the search on fitted centroids.
_LISTS, _PROBES = 16, 3


@query()
def ann_ivf_fitted_topk(spark, d):
    base = vector_records(spark, d)
    return vectors.inverted_top_k(vector_records(spark, d, 1), base, vectors.centroids(base, _LISTS), 20, _PROBES)


@query()
def ann_ivf_recall(spark, d):
    """Share of the exact search's 20 neighbours that the search on fitted centroids finds."""
    found = ann_ivf_fitted_topk(spark, d).select("s1_id", "target_id", F.lit(1).alias("hit"))
    both = ann_exact_topk(spark, d).select("s1_id", "target_id").join(found, ["s1_id", "target_id"], "left")
    return both.agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


_TEXT_VIEWS = ("name", "address", "combined")
_ONE = "CASE WHEN c // 64 % 2 = 0 THEN 1 ELSE -1 END"
TEXT_VECTORS = """, tx AS (SELECT * FROM (SELECT entity_id AS id, source, country, 'name' AS view, name_norm AS text FROM e UNION ALL SELECT entity_id, source, country, 'address', address_norm FROM e UNION ALL SELECT entity_id, source, country, 'combined', name_norm || ' ' || address_norm FROM e) WHERE trim(text) <> ''),
tc AS (SELECT id, source, country, view, unicode(substr(t, i, 1)) * 961 + unicode(substr(t, i + 1, 1)) * 31 + unicode(substr(t, i + 2, 1)) AS c FROM (SELECT *, ' ' || text || ' ' AS t, unnest(range(1, length(text) + 1)) AS i FROM tx)),
tv AS MATERIALIZED (SELECT id, source, country, view, CAST([""" + ", ".join(f"sum(CASE WHEN c % 64 = {k} THEN {_ONE} ELSE 0 END)" for k in range(64)) + """] AS DOUBLE[]) AS raw FROM tc GROUP BY ALL),
tu AS MATERIALIZED (SELECT id, source, country, view, CASE WHEN n = 0 THEN raw ELSE list_transform(raw, lambda x: x / n) END AS vec FROM (SELECT *, sqrt(list_inner_product(raw, raw)) AS n FROM tv))
"""  # fmt: skip


@query(VIEWS.rstrip() + TEXT_VECTORS + "SELECT id, source, view, array_to_string(list_transform(vec, lambda x: CAST(round(x * 1e6) AS BIGINT)), ',') AS vec FROM tu")
def text_view_vectors(spark, d):
    out = vectors.view_vectors(entities(spark, d))
    return out.select("id", "source", "view", F.array_join(F.transform("vec", lambda x: F.round(x * 1e6).cast("bigint").cast("string")), ",").alias("vec"))


def _text_neighbours(spark, d):
    """S1 records nearest to each labelled target by each view of its text."""
    cols = ["entity_id", "source", "country", "name_norm", "address_norm"]
    few = targets(spark, d).select(cols).join(blocking.merged(links(spark, d).select(F.col("target_id").alias("entity_id")).distinct()), "entity_id", "left_semi")
    base, asked = (vectors.view_texts(df).withColumnRenamed("text", "vec") for df in (kept(s1(spark, d).select(cols)), kept(few)))
    return vectors.targets_to_s1(asked, base, max(_KS), ("view",)).withColumnRenamed("view", "ann_view")


_TEXT_ANN = VIEWS.rstrip() + TEXT_VECTORS.rstrip() + f""", ann AS MATERIALIZED (SELECT * FROM (SELECT b.id AS target_id, b.source, a.id AS s1_id, a.country, round(list_inner_product(a.vec, b.vec), 9) + 0 AS ann_score, CAST(row_number() OVER (PARTITION BY b.id, b.view ORDER BY round(list_inner_product(a.vec, b.vec), 9) DESC, a.id) AS INTEGER) AS ann_rank, a.view AS ann_view FROM tu a JOIN tu b ON a.country = b.country AND a.view = b.view AND a.source = 'S1' AND b.source <> 'S1' AND b.id IN (SELECT target_id FROM links)) WHERE ann_rank <= {max(_KS)})
"""
_ANN_VIEWS = {**{v: f"(SELECT * FROM ann WHERE ann_view = '{v}')" for v in _TEXT_VIEWS}, "union": "ann"}


@query(_TEXT_ANN + "SELECT target_id, source, s1_id, country, ann_view, ann_rank, ann_score FROM ann")
def ann_targets_to_s1(spark, d):
    return _text_neighbours(spark, d)


@query(_TEXT_ANN + " UNION ALL ".join(f"SELECT '{v}' AS ann_view, * FROM ({_recall_at_sql(x, 'ann_rank')})" for v, x in _ANN_VIEWS.items()))
def ann_recall_at_k(spark, d):
    """Known links among the first k neighbours of each view, and of all views together."""
    known = kept(known_links(spark, d))
    found = kept(evaluation.link_ranks(_text_neighbours(spark, d).select("target_id", "s1_id", "ann_view", "ann_rank"), known))
    parts = [evaluation.recall_at(found if v == "union" else found.where(F.col("ann_view") == v), known, _KS, "ann_rank").withColumn("ann_view", F.lit(v)) for v in _ANN_VIEWS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(_TEXT_ANN + _totals_sql("ann", "ann_rank"))
def ann_recall_totals(spark, d):
    return evaluation.recall_totals(_text_neighbours(spark, d), kept(known_links(spark, d)), _KS, "ann_rank")


@query(
    _BY_TARGET + TEXT_VECTORS.rstrip() + _TEXT_ANN[len(VIEWS.rstrip() + TEXT_VECTORS.rstrip()) :]
    + f"SELECT *, round(classical / links, 6) AS classical_recall, round(ann / links, 6) AS ann_recall, round(either / links, 6) AS either_recall FROM (SELECT kl.source, k, count(*) AS links, count(c.s1_id) AS classical, count(*) FILTER (r <= k) AS ann, count(*) FILTER (r <= k AND c.s1_id IS NOT NULL) AS both, count(*) FILTER (r <= k AND c.s1_id IS NULL) AS marginal, count(*) FILTER (coalesce(r <= k, false) OR c.s1_id IS NOT NULL) AS either FROM kl LEFT JOIN (SELECT s1_id, target_id, min(ann_rank) AS r FROM ann GROUP BY ALL) q USING (s1_id, target_id) LEFT JOIN (SELECT DISTINCT s1_id, target_id FROM ranked WHERE rank <= 20) c USING (s1_id, target_id) CROSS JOIN {_K_VALUES} GROUP BY ALL)"
)
def ann_marginal_over_classical(spark, d):
    """What neighbours of all views add to the best 20 candidates of the classical routes."""
    return evaluation.marginal_over(known_links(spark, d), _by_target(spark, d).where("rank <= 20"), _text_neighbours(spark, d), _KS, "ann_rank")


def _view_candidates(spark, d):
    """Three views of a vector: its first half, its second half, the whole."""
    cuts = {"name": F.slice("vec", 1, 32), "address": F.slice("vec", 33, 32), "combined": F.col("vec")}
    views = F.explode(F.array(*(F.struct(F.lit(v).alias("ann_view"), c.alias("vec")) for v, c in cuts.items()))).alias("x")
    q, b = (vector_records(spark, d, n).select("id", "country", "source", views).select("id", "country", "source", "x.*") for n in (1, None))
    return vectors.exact_top_k(q, b, 5, ("ann_view",))


def _view_sql(view: str, low: int, high: int) -> str:
    dot = _DOT.replace("range(1, 65)", f"range({low}, {high})")
    return f"SELECT *, '{view}' AS ann_view FROM (SELECT a.id AS s1_id, b.id AS target_id, 'S' || b.s AS source, a.country, round({dot}, 9) AS ann_score, row_number() OVER (PARTITION BY a.id, b.s ORDER BY round({dot}, 9) DESC, b.id) AS ann_rank FROM v a JOIN v b ON a.country = b.country AND a.s = 1 AND b.s > 1) WHERE ann_rank <= 5"


@query(
    VECTORS
    + f", av AS ({_view_sql('name', 1, 33)} UNION ALL {_view_sql('address', 33, 65)} UNION ALL {_view_sql('combined', 1, 65)}) SELECT s1_id, target_id, source, country, max(ann_score) AS retrieval_ann_best_score, CAST(min(ann_rank) AS INTEGER) AS retrieval_ann_best_rank, count(DISTINCT ann_view) AS retrieval_ann_view_count, "
    + ", ".join(f"max(ann_score) FILTER (ann_view = '{v}') AS retrieval_ann_{v}_score" for v in ("name", "address", "combined"))
    + " FROM av GROUP BY s1_id, target_id, source, country"
)
def ann_view_rollup(spark, d):
    return pairs.roll_up_views(_view_candidates(spark, d))


# ---------------------------------------------------------------- pair sets


def _routes(spark, d):
    p = scored_pairs(spark, d)
    classical = p.where("classical_evidence IS NOT NULL").select(*pairs.KEYS, *pairs.CLASSICAL)
    ann = p.where("retrieval_ann_best_score IS NOT NULL").select(*pairs.KEYS, "retrieval_ann_best_score", "retrieval_ann_best_rank", "retrieval_ann_view_count")
    return classical, ann


def _split_s1(spark, d):
    return s1(spark, d).select(F.col("entity_id").alias("s1_id"), "country", "split")


UNION = VIEWS.rstrip() + ", " + PAIRS.removeprefix("WITH ").rstrip() + """, u AS (SELECT s1_id, target_id, source, country, classical_evidence, retrieval_ann_best_score, greatest(coalesce(retrieval_ann_best_score, -1), least(greatest(coalesce(classical_evidence, 0) / 5, 0), 1)) AS retrieval_priority FROM p WHERE classical_evidence IS NOT NULL OR retrieval_ann_best_score IS NOT NULL)
"""


@query(UNION + "SELECT s1_id, target_id, source, country, classical_evidence, retrieval_ann_best_score, retrieval_priority FROM u")
def pair_union(spark, d):
    return pairs.unite_routes(*_routes(spark, d)).select("s1_id", "target_id", "source", "country", "classical_evidence", "retrieval_ann_best_score", "retrieval_priority")


def _forced_sql(splits: str) -> str:
    return UNION + f""", f AS (SELECT l.s1_id, l.target_id, l.source FROM links l JOIN s1 ON s1.entity_id = l.s1_id WHERE s1.split IN ({splits})),
ks AS (SELECT s1_id, target_id, source FROM u UNION SELECT s1_id, target_id, source FROM f),
lab AS (SELECT ks.s1_id, ks.target_id, ks.source, s1.country, s1.split AS validation_split, u.retrieval_priority, l.s1_id IS NOT NULL AS is_match FROM ks LEFT JOIN u USING (s1_id, target_id, source) LEFT JOIN (SELECT DISTINCT s1_id, target_id FROM links) l USING (s1_id, target_id) LEFT JOIN s1 ON s1.entity_id = ks.s1_id)
"""


def _forced(spark, d, splits):
    return pairs.force_truth(pairs.unite_routes(*_routes(spark, d)), links(spark, d), _split_s1(spark, d), splits).select("s1_id", "target_id", "source", "country", "validation_split", "retrieval_priority", "is_match")


@query(_forced_sql("'train'") + "SELECT * FROM lab")
def pair_union_forced(spark, d):
    return _forced(spark, d, ("train",))


@query(_forced_sql("'train', 'calibration', 'holdout'") + "SELECT * FROM lab")
def pair_union_force_all(spark, d):
    return _forced(spark, d, ("train", "calibration", "holdout"))


@query(_forced_sql("'train'") + "SELECT s1_id, target_id, is_match, 0 AS negative_rank FROM lab WHERE is_match UNION ALL SELECT s1_id, target_id, is_match, negative_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id, source ORDER BY retrieval_priority DESC NULLS LAST, target_id) AS INTEGER) AS negative_rank FROM lab WHERE NOT is_match) WHERE negative_rank <= 5")
def pairs_negative_capped(spark, d):
    return pairs.cap_negatives(_forced(spark, d, ("train",)), 5).select("s1_id", "target_id", "is_match", F.coalesce("negative_rank", F.lit(0)).alias("negative_rank"))


@query(UNION + "SELECT s1_id, target_id, CAST(candidate_rank AS INTEGER) AS candidate_rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, source ORDER BY retrieval_priority DESC NULLS LAST, target_id) AS candidate_rank FROM u) WHERE candidate_rank <= 40")
def pairs_test_capped(spark, d):
    return pairs.cap_candidates(pairs.unite_routes(*_routes(spark, d)), 40).select("s1_id", "target_id", "candidate_rank")


# ---------------------------------------------------------------- features, metrics, output


def _texts(spark, d):
    return features.attach_texts(scored_pairs(spark, d), s1(spark, d), targets(spark, d))


def _jaccard_sql(x: str, y: str) -> str:
    a, b = (f"list_distinct(regexp_extract_all({c}, '\\p{{Nd}}+'))" for c in (x, y))
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def _ratio_sql(x: str, y: str) -> str:
    return f"CASE WHEN greatest(length({x}), length({y})) = 0 THEN 1 ELSE least(length({x}), length({y})) / greatest(length({x}), length({y})) END"


TEXTS = VIEWS.rstrip() + ", " + PAIRS.removeprefix("WITH ").rstrip() + ", x AS (SELECT p.*, coalesce(s1.name_norm, '') AS n1, coalesce(s1.address_norm, '') AS a1, coalesce(t.name_norm, '') AS n2, coalesce(t.address_norm, '') AS a2 FROM p LEFT JOIN s1 ON s1.entity_id = p.s1_id LEFT JOIN t ON t.entity_id = p.target_id)\n"
_ROUND = lambda c: [(F.round(x, 6) + 0.0).alias(x) for x in c]


@query(
    TEXTS
    + f"SELECT s1_id, target_id, round({_ratio_sql('n1', 'n2')}, 6) AS name_length_ratio, round({_jaccard_sql('n1', 'n2')}, 6) AS name_digit_jaccard, CAST(n1 <> '' AND n1 = n2 AS DOUBLE) AS name_exact, CASE WHEN a1 = '' OR a2 = '' THEN 0 ELSE round({_ratio_sql('a1', 'a2')}, 6) END AS address_length_ratio, CASE WHEN a1 = '' OR a2 = '' THEN 0 ELSE round({_jaccard_sql('a1', 'a2')}, 6) END AS address_digit_jaccard, CASE WHEN a1 = '' OR a2 = '' THEN 0 ELSE CAST(a1 = a2 AS DOUBLE) END AS address_exact, CAST(a1 = '' OR a2 = '' AS DOUBLE) AS address_missing, CAST(source = 'S3' AS DOUBLE) AS source_is_s3, CAST(country = 'US' AS DOUBLE) AS country_is_us, CAST(country = 'India' AS DOUBLE) AS country_is_india FROM x"
)
def builtin_pair_features(spark, d):
    return features.builtin_features(_texts(spark, d)).select("s1_id", "target_id", *_ROUND(features.BUILTIN))


def _with_cosines(pairs_, vecs):
    """Products of the texts' vectors by view beside each pair; 0 where a side has no text."""
    wide = vecs.groupBy("id").pivot("view", list(_TEXT_VIEWS)).agg(F.first("vec"))
    for side, key in (("a", "s1_id"), ("b", "target_id")):
        pairs_ = pairs_.join(wide.select(F.col("id").alias(key), *(F.col(v).alias(f"_{v}_{side}") for v in _TEXT_VIEWS)), key, "left")
    cosines = {f"{v}_cos": vectors.dot(F.col(f"_{v}_a"), F.col(f"_{v}_b")) for v in _TEXT_VIEWS}
    return pairs_.withColumns(cosines).drop(*(f"_{v}_{x}" for v in _TEXT_VIEWS for x in "ab"))


@query(
    VIEWS.rstrip() + TEXT_VECTORS.rstrip() + ", " + PAIRS.removeprefix("WITH ").rstrip()
    + ", q AS (SELECT s1_id, target_id, " + ", ".join(f"coalesce(list_inner_product({v}1.vec, {v}2.vec), 0) AS {v}_cos" for v in _TEXT_VIEWS) + " FROM p "
    + " ".join(f"LEFT JOIN (SELECT id, vec FROM tu WHERE view = '{v}') {v}{n} ON {v}{n}.id = p.{key}" for v in _TEXT_VIEWS for n, key in ((1, "s1_id"), (2, "target_id")))
    + ") SELECT s1_id, target_id, " + ", ".join(f"round({v}_cos, 6) + 0 AS {v}_cos" for v in _TEXT_VIEWS) + ", round(greatest(name_cos, address_cos, combined_cos), 6) + 0 AS best_cos, round(combined_cos - name_cos, 6) + 0 AS combined_minus_name, round(combined_cos - address_cos, 6) + 0 AS combined_minus_address, round(name_cos * address_cos, 6) + 0 AS name_times_address FROM q"
)
def vector_pair_features(spark, d):
    out = features.vector_features(_with_cosines(scored_pairs(spark, d).select("s1_id", "target_id"), vectors.view_vectors(entities(spark, d))))
    return out.select("s1_id", "target_id", *_ROUND(["name_cos", "address_cos", "combined_cos", "best_cos", "combined_minus_name", "combined_minus_address", "name_times_address"]))


@query()
def lexical_fuzzy_features(spark, d):
    return features.fuzzy_features(_texts(spark, d)).select("s1_id", "target_id", *_ROUND(features.FUZZY))


@query()
def fuzzy_rerank(spark, d):
    scored = features.fuzzy_score(features.fuzzy_features(_texts(spark, d)))
    best = evaluation.rank_within(scored, "target_id", [F.desc("fuzzy_score"), F.asc("s1_id")], "rank")
    return best.where("rank <= 20").select("target_id", "s1_id", F.round("fuzzy_score", 6).alias("fuzzy_score"), "rank")


def _scored(spark, d):
    """Labelled pairs with a score; a pair without one scores 0."""
    p = scored_pairs(spark, d).where("is_match IS NOT NULL")
    return p.select("s1_id", "target_id", "is_match", F.coalesce("retrieval_priority", F.lit(0.0)).alias("score"))


SCORED = VIEWS.rstrip() + ", " + PAIRS.removeprefix("WITH ").rstrip() + """, sp AS (SELECT s1_id, target_id, is_match, coalesce(retrieval_priority, 0) AS score FROM p WHERE is_match IS NOT NULL),
en AS (SELECT DISTINCT source1_entity_id AS s1_id FROM train_matches),
tr AS (SELECT DISTINCT s1_id, target_id FROM links), nt AS (SELECT s1_id, count(*) AS n_true FROM tr GROUP BY s1_id)
"""
_FB = "CASE WHEN n_true = 0 AND n_predicted = 0 THEN 1.0 WHEN n_hits = 0 THEN 0.0 ELSE 1.25 * n_hits / (0.25 * n_true + n_predicted) END"


def _entities(spark, d):
    return table(spark, d, "train_matches").select(F.col("source1_entity_id").alias("s1_id")).distinct()


@query(SCORED + f"SELECT s1_id, n_true, n_predicted, n_hits, round(CAST({_FB} AS DOUBLE), 6) AS fbeta FROM (SELECT en.s1_id, coalesce(n_true, 0) AS n_true, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_hits, 0) AS n_hits FROM en LEFT JOIN nt USING (s1_id) LEFT JOIN (SELECT sp.s1_id, count(*) AS n_predicted, count(tr.s1_id) AS n_hits FROM sp LEFT JOIN tr USING (s1_id, target_id) WHERE score >= 0.7 GROUP BY sp.s1_id) USING (s1_id))")
def entity_fbeta(spark, d):
    e = metrics.entity_fbeta(_entities(spark, d), links(spark, d), _scored(spark, d).where("score >= 0.7"))
    return e.withColumn("fbeta", F.round("fbeta", 6))


_SWEEP_SQL = (
    SCORED
    + ", th AS (SELECT * FROM (VALUES "
    + ", ".join(f"(CAST({t} AS DOUBLE))" for t in metrics.SWEEP)
    + f") AS th(threshold)), pt AS (SELECT threshold, sp.s1_id, count(*) AS n_predicted, count(tr.s1_id) AS n_hits FROM sp JOIN th ON score >= threshold LEFT JOIN tr ON tr.s1_id = sp.s1_id AND tr.target_id = sp.target_id GROUP BY threshold, sp.s1_id), sweep AS (SELECT threshold, count(*) AS entities, avg(CAST({_FB} AS DOUBLE)) AS macro_fbeta, CAST(sum(n_predicted) AS BIGINT) AS predicted_links FROM (SELECT threshold, en.s1_id, coalesce(n_true, 0) AS n_true, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_hits, 0) AS n_hits FROM en CROSS JOIN th LEFT JOIN nt USING (s1_id) LEFT JOIN pt USING (threshold, s1_id)) GROUP BY threshold)"
)


def _sweep(spark, d):
    return metrics.threshold_sweep(_entities(spark, d), links(spark, d), _scored(spark, d).join(_entities(spark, d), "s1_id", "left_semi"))


@query(_SWEEP_SQL.replace("FROM sp JOIN th", "FROM (SELECT * FROM sp WHERE s1_id IN (SELECT s1_id FROM en)) sp JOIN th") + " SELECT threshold, entities, round(macro_fbeta, 6) AS macro_fbeta, predicted_links FROM sweep")
def threshold_sweep(spark, d):
    return _sweep(spark, d).withColumn("macro_fbeta", F.round("macro_fbeta", 6))


@query(_SWEEP_SQL.replace("FROM sp JOIN th", "FROM (SELECT * FROM sp WHERE s1_id IN (SELECT s1_id FROM en)) sp JOIN th") + " SELECT threshold, round(macro_fbeta, 6) AS macro_fbeta FROM sweep ORDER BY round(macro_fbeta, 9) DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    return metrics.best_threshold(_sweep(spark, d)).select("threshold", F.round("macro_fbeta", 6).alias("macro_fbeta"))


@query(SCORED + f"SELECT count(*) AS entities, round(avg(f), 6) AS macro_fbeta, round(avg(f) FILTER (n_true = 0), 6) AS singleton_fbeta, round(avg(f) FILTER (n_true > 0), 6) AS linked_fbeta, CAST(sum(n_predicted) AS BIGINT) AS predicted_links FROM (SELECT *, CAST({_FB} AS DOUBLE) AS f FROM (SELECT en.s1_id, coalesce(n_true, 0) AS n_true, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_hits, 0) AS n_hits FROM en LEFT JOIN nt USING (s1_id) LEFT JOIN (SELECT sp.s1_id, count(*) AS n_predicted, count(tr.s1_id) AS n_hits FROM sp LEFT JOIN tr USING (s1_id, target_id) WHERE score >= 0.7 GROUP BY sp.s1_id) USING (s1_id)))")
def macro_fbeta(spark, d):
    known = _scored(spark, d).where("score >= 0.7").join(_entities(spark, d), "s1_id", "left_semi")
    out = metrics.macro_fbeta(_entities(spark, d), links(spark, d), known)
    return out.select("entities", *_ROUND(["macro_fbeta", "singleton_fbeta", "linked_fbeta"]), "predicted_links")


@query(SCORED + "SELECT count(*) AS links, count(q.s1_id) AS retrieved, round(count(q.s1_id) / count(*), 6) AS recall FROM tr LEFT JOIN (SELECT DISTINCT s1_id, target_id FROM p) q USING (s1_id, target_id)")
def candidate_recall(spark, d):
    return metrics.candidate_recall(scored_pairs(spark, d), links(spark, d))


_BY_SCORE = SCORED + ", b AS (SELECT score, count(*) FILTER (is_match) AS pos, count(*) FILTER (NOT is_match) AS neg FROM sp GROUP BY score), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM b)"


def _labelled_scores(spark, d):
    return _scored(spark, d).select("score", F.col("is_match").alias("y"))


@query(_BY_SCORE + " SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM c")
def average_precision(spark, d):
    return metrics.average_precision(_labelled_scores(spark, d)).select(F.round("average_precision", 6).alias("average_precision"))


@query(_BY_SCORE + " SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c")
def roc_auc(spark, d):
    return metrics.roc_auc(_labelled_scores(spark, d)).select(F.round("roc_auc", 6).alias("roc_auc"))


_MODEL_FEATURES = list(features.MODEL)


def _features(spark, d):
    """The whole set of features of every scored pair."""
    texts = features.fuzzy_features(features.builtin_features(_texts(spark, d)))
    return features.vector_features(_with_cosines(texts, vectors.view_vectors(entities(spark, d))))


@query()
def pair_features(spark, d):
    return _features(spark, d).select("s1_id", "target_id", *_ROUND(_MODEL_FEATURES))


def _model(spark, d):
    rows = kept(_features(spark, d).select("s1_id", "target_id", "is_match", split_of(F.col("s1_id")).alias("validation_split"), *_MODEL_FEATURES))
    return fit_matcher(rows, _MODEL_FEATURES), rows


@query()
def match_model_scores(spark, d):
    model, rows = _model(spark, d)
    return score_pairs(model, rows, _MODEL_FEATURES).select("s1_id", "target_id", F.round("score", 6).alias("score"))


@query()
def model_feature_importance(spark, d):
    model, rows = _model(spark, d)
    return feature_importance(model, _MODEL_FEATURES, rows)


@query()
def model_matches(spark, d):
    """Matches by the model's scores: threshold by the calibration records, one S1 record a target, a row an S1 record."""
    model, rows = _model(spark, d)
    scored = kept(score_pairs(model, rows, _MODEL_FEATURES).select("s1_id", "target_id", "score"))
    held = s1(spark, d).where("split = 'calibration'").select(F.col("entity_id").alias("s1_id")).join(_entities(spark, d), "s1_id", "left_semi")
    known = links(spark, d).join(held, "s1_id", "left_semi")
    best = metrics.best_threshold(metrics.threshold_sweep(held, known, scored.join(held, "s1_id", "left_semi"))).first()
    return output.grouped_output(s1(spark, d).select(F.col("entity_id").alias("s1_id")), output.exclusive_matches(scored, best.threshold if best else 0.5))


_ALL_SCORED = VIEWS.rstrip() + ", " + PAIRS.removeprefix("WITH ").rstrip() + ", ex AS (SELECT s1_id, target_id, score FROM (SELECT s1_id, target_id, retrieval_priority AS score, row_number() OVER (PARTITION BY target_id ORDER BY retrieval_priority DESC, s1_id) AS k FROM p WHERE retrieval_priority >= 0.7) WHERE k = 1)\n"


def _exclusive(spark, d):
    return output.exclusive_matches(scored_pairs(spark, d).withColumn("score", F.col("retrieval_priority")), 0.7)


@query(_ALL_SCORED + "SELECT * FROM ex")
def target_exclusive_matches(spark, d):
    return _exclusive(spark, d)


@query(_ALL_SCORED + "SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM s1 LEFT JOIN (SELECT s1_id, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS ids FROM ex GROUP BY s1_id) g ON g.s1_id = entity_id")
def matching_output(spark, d):
    return output.grouped_output(s1(spark, d).select(F.col("entity_id").alias("s1_id")), _exclusive(spark, d))


@query(UNION.rstrip() + ", cc AS (SELECT s1_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, source ORDER BY retrieval_priority DESC NULLS LAST, target_id) AS k FROM u) WHERE k <= 40) SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM s1 LEFT JOIN (SELECT s1_id, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS ids FROM cc GROUP BY s1_id) g ON g.s1_id = entity_id")
def candidate_output(spark, d):
    """The capped candidates of each S1 record; the cap bounds the lists."""
    capped = pairs.cap_candidates(pairs.unite_routes(*_routes(spark, d)), 40)
    return output.grouped_output(s1(spark, d).select(F.col("entity_id").alias("s1_id")), capped)
