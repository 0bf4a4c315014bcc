"""Nearest neighbours by inner product within a country and source: exact, and over inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the queries' vectors that one task of the exact search holds.
QUERY_BYTES = 16 << 20
#: Points that are met at once, those met before any threshold is known, and queries of one product.
POINT_ROWS, FIRST_POINTS, TILE_ROWS = 2_048, 256, 512
#: Vectors of a country on which centroids are fitted, and rounds of it.
FIT_VECTORS = 8_192
FIT_ROUNDS = 10
#: Bytes of centroids that are sent to every worker; more are joined.
CENTROID_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; 0 if either vector is missing."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(total, F.lit(0.0))


def _rounded_top(pairs: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    order = Window.partitionBy("s1_id", "source", *by).orderBy(F.desc("ann_score"), F.asc("target_id"))
    return pairs.withColumn("ann_rank", F.row_number().over(order)).where(F.col("ann_rank") <= k)


class _Nearest:
    """Running best ``k`` of a block of queries over points that come in the order of their ids.

    Products are taken in single precision where that is safe, and only those that may enter the best
    ``k`` again in double precision. Of equal products the id that came first stays.
    """

    def __init__(self, vecs: np.ndarray, k: int) -> None:
        self.vecs, self.narrow, self.k, self.seen = vecs, vecs.astype(np.float32), k, 0
        self.norms = np.linalg.norm(vecs, axis=1)
        self.scores = np.full((len(vecs), k), -np.inf)
        self.ids = np.full((len(vecs), k), None, dtype=object)

    def meet(self, ids: np.ndarray, points: np.ndarray) -> None:
        low = 0
        while low < len(ids):  # few points at first, until the best k tell what may be left out
            high = min(len(ids), low + max(FIRST_POINTS, min(self.seen, POINT_ROWS)))
            self._meet(ids[low:high], points[low:high])
            self.seen += high - low
            low = high

    def _meet(self, ids: np.ndarray, points: np.ndarray) -> None:
        longest = float(np.linalg.norm(points, axis=1).max())
        safe = longest * float(self.norms.max()) < 1e30 and longest < 1e30 and self.norms.max() < 1e30
        other = np.ascontiguousarray((points.astype(np.float32) if safe else points).T)
        for low in range(0, len(self.vecs), TILE_ROWS):
            tile = slice(low, low + TILE_ROWS)
            least = self.scores[tile, -1] - 1e-8
            if safe:  # single precision errs by less than this
                least = (least - self.norms[tile] * longest * 3e-7 * max(8, points.shape[1] / 4)).astype(np.float32)
            out = (self.narrow if safe else self.vecs)[tile] @ other
            some = np.flatnonzero(~(out.max(axis=1) < least))
            if not len(some):
                continue
            at = np.flatnonzero(~(out[some] < least[some, None]))
            row, col = np.divmod(at, len(ids))
            row = some[row]
            mine = self.vecs[tile]
            exact = (mine @ points.T)[row, col] if len(at) * 32 > out.size else np.einsum("ij,ij->i", mine[row], points[col])
            exact = np.round(exact, 9) + 0.0
            exact[np.isnan(exact)] = np.inf  # first, as in ORDER BY ... DESC
            better = exact > self.scores[tile, -1][row]
            if better.any():
                self._keep(low, row[better], ids[col[better]], exact[better])

    def _keep(self, low: int, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, own = np.unique(row, return_inverse=True)
        at = rows + low
        group = np.concatenate([np.repeat(np.arange(len(rows)), self.k), own])
        scores, ids = np.concatenate([self.scores[at].ravel(), scores]), np.concatenate([self.ids[at].ravel(), ids])
        order = np.lexsort((-scores, group))
        size = np.bincount(group)
        best = order[(np.cumsum(size) - size)[:, None] + np.arange(self.k)]
        self.scores[at], self.ids[at] = scores[best], ids[best]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as they are, texts as :func:`text_vectors`."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return text_vectors(column.to_pylist())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[int, int]]:
    change = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for c in keys:
        x = batch.column(c)
        change |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
    return zip(edges[:-1], edges[1:])


def _top_k(queries: DataFrame, database: DataFrame, groups: list[str], k: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Best ``k`` products of each query (s1_id, vec) within its group of the database (target_id, vec), with the group's text columns and the query's ``carry``.

    The queries of a group are cut into parts of bounded size. Each part meets the whole database
    of its group, which comes sorted by id in Arrow batches beside it: a task holds one part and its best ``k``
    and some thousand points, however large the database is, and only results leave it, with their ``ann_rank``.
    ``vec`` may be a text, too, which is shorter to send than the vector that :func:`text_vectors` makes of it.
    """
    base, asked = (df.where(" AND ".join(f"{c} IS NOT NULL" for c in (*groups, "vec"))) for df in (database, queries))
    kinds = [df.schema["vec"].dataType for df in (database, queries)]
    kind = kinds[0] if kinds[0] == kinds[1] else T.ArrayType(T.DoubleType())
    width = [] if isinstance(kind, T.StringType) else database.select(F.size("vec").alias("n")).where("n > 0").limit(1).collect()
    rows = max(1, QUERY_BYTES // (8 * (width[0].n if width else TEXT_DIMENSIONS)))
    counts = asked.groupBy(*groups).agg(F.count("*").alias("_n"))
    # A group with many of all queries is cut further, so that all cores have a part of it.
    even = F.col("_n") / F.col("_all") * (4 * database.sparkSession.sparkContext.defaultParallelism)
    shares = F.broadcast(counts.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all")))).select(*groups, F.ceil(F.greatest(F.col("_n") / rows, even)).cast("int").alias("_shares")))
    keys = [*groups, "_share"]
    nothing = [F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in carry]
    points = base.join(shares, groups).select(*groups, F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"), F.lit(1).alias("_side"), F.col("target_id").alias("_id"), *nothing, F.col("vec").cast(kind))
    salted = asked.join(shares, groups).select(*groups, F.pmod(F.xxhash64("s1_id"), F.col("_shares")).cast("int").alias("_share"), F.lit(0).alias("_side"), F.col("s1_id").alias("_id"), *carry, F.col("vec").cast(kind))
    shown = [c for c in groups if c != "cell"]
    schema = T.StructType([T.StructField("s1_id", T.StringType()), T.StructField("target_id", T.StringType()), *(queries.schema[c] for c in (*shown, *carry)), T.StructField("ann_score", T.DoubleType()), T.StructField("ann_rank", T.IntegerType())])

    def results(asked_: list[pa.RecordBatch], found: _Nearest) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(asked_)
        for low in range(0, table.num_rows, 2048):
            part = slice(low, low + 2048)
            there = found.scores[part] > -np.inf
            row, rank = np.nonzero(there)
            own = {c: table.column(c).slice(low, 2048).take(pa.array(row)).combine_chunks() for c in table.column_names}
            made = [own["_id"], pa.array(found.ids[part][there], pa.string()), *(own[c] for c in (*shown, *carry)), pa.array(found.scores[part][there]), pa.array((rank + 1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(made, names=schema.names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine, found = None, [], None
        for batch in batches:
            for low, high in _runs(batch, [*keys, "_side"]) if batch.num_rows else ():
                run = batch.slice(low, high - low)
                here = tuple(run.column(c)[0].as_py() for c in keys)
                if here != key:
                    if found is not None:
                        yield from results(mine, found)
                    key, mine, found = here, [], None
                if run.column("_side")[0].as_py() == 0:
                    mine.append(run)
                elif mine:
                    if found is None:
                        found = _Nearest(np.concatenate([_matrix(x.column("vec")) for x in mine]), k)
                        mine = [x.select(["_id", *shown, *carry]) for x in mine]
                    found.meet(np.array(run.column("_id").to_pylist(), dtype=object), _matrix(run.column("vec")))
        if found is not None:
            yield from results(mine, found)

    met = points.unionByName(salted).repartition(_tasks(database.sparkSession), *keys).sortWithinPartitions(*keys, "_side", "_id")
    return met.mapInArrow(search, schema)


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _asked(queries: DataFrame, database: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row a query and source that the database has in its country."""
    sources = F.broadcast(database.select("country", "source", *by).distinct())
    return queries.select(F.col("id").alias("s1_id"), "country", *by, "vec").join(sources, ["country", *by])


def exact_top_k(queries: DataFrame, database: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(s1_id, target_id, country, source, ``by``, ann_score, ann_rank): ``k`` targets of each source with the largest product.

    ``queries`` have id, country, vec, the database also source. Only records of one country, and
    of one value of the text columns ``by`` (such as the view), meet. Scores are rounded to nine
    places and ties go by target id.
    """
    base = database.select(F.col("id").alias("target_id"), "country", "source", *by, "vec")
    return _rounded_top(_top_k(_asked(queries, database, by), base, ["country", "source", *by], k), k, by)


def centroids(database: DataFrame, lists: int) -> DataFrame:
    """(country, source, cell, centroid): unit centroids of spherical k-means, at most one list for 40 vectors.

    They are fitted on the FIT_VECTORS vectors of a country and source that are least by id hash, from the
    first of these; every vector is searched, whatever was fitted.
    """
    order = Window.partitionBy("country", "source").orderBy(F.xxhash64("id"), "id")
    size = database.groupBy("country", "source").agg(F.greatest(F.lit(1), F.least(F.lit(lists), F.floor(F.count("*") / 40))).alias("nlist"))
    ranked = database.where("vec IS NOT NULL").withColumn("cell", F.row_number().over(order)).where(F.col("cell") <= FIT_VECTORS)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        points = np.array(part.sort_values("cell")["vec"].tolist(), dtype=np.float64)
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        points = unit(points)
        centers = points[: int(part["nlist"].iloc[0])].copy()
        for _ in range(FIT_ROUNDS):
            near = np.argmax(points @ centers.T, axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, near, points)
            filled = np.bincount(near, minlength=len(centers)) > 0
            centers[filled] = unit(sums[filled])
        return pd.DataFrame({"country": part["country"].iloc[0], "source": part["source"].iloc[0], "cell": np.arange(1, len(centers) + 1, dtype=np.int32), "centroid": list(centers.astype(np.float32))})

    return ranked.join(size, ["country", "source"]).select("country", "source", "cell", "nlist", "vec").groupBy("country", "source").applyInPandas(fit, "country string, source string, cell int, centroid array<float>")


def _cells(points: DataFrame, cells: DataFrame, probes: int) -> DataFrame:
    """``points`` (with country, source, vec) once for each of their ``probes`` nearest cells.

    Centroids of up to CENTROID_BYTES go to the workers, which multiply batches of points with
    them; more are joined by country and source instead.
    """
    spark = points.sparkSession
    width = cells.select(F.size("centroid").alias("n")).limit(1).collect()
    if width and cells.count() * width[0].n * 8 > CENTROID_BYTES:
        key = F.struct("country", "source", points.columns[0])
        near = points.withColumn("_k", key).join(cells, ["country", "source"]).withColumn("s", F.round(dot(F.col("vec"), F.col("centroid")), 9))
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("s"), "cell")))
        return near.where(F.col("r") <= probes).select(*points.columns, "cell")
    table: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
    for r in cells.orderBy("country", "source", "cell").collect():
        table.setdefault((r.country, r.source), ([], []))[0].append(r.cell)
        table[r.country, r.source][1].append(r.centroid)
    model = spark.sparkContext.broadcast({key: (np.array(n, dtype=np.int32), np.array(c, dtype=np.float64)) for key, (n, c) in table.items()})
    schema = T.StructType([*(f for f in points.schema.fields), T.StructField("cell", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            area = pd.DataFrame({"c": batch.column("country").to_pylist(), "s": batch.column("source").to_pylist()})
            for key, rows in area.groupby(["c", "s"]).indices.items():
                if key not in model.value:
                    continue
                names, centers = model.value[key]
                part = batch.take(pa.array(rows))
                vec = np.array(part.column("vec").to_pylist(), dtype=np.float64)
                near = np.argsort(-np.round(vec @ centers.T, 9), axis=1, kind="stable")[:, :probes]
                out = part.take(pa.array(np.repeat(np.arange(len(rows)), near.shape[1])))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(names[near].ravel())], names=[*out.schema.names, "cell"])

    return points.where("vec IS NOT NULL").mapInArrow(assign, schema)


def inverted_top_k(queries: DataFrame, database: DataFrame, cells: DataFrame, k: int, probes: int) -> DataFrame:
    """As :func:`exact_top_k` over the ``probes`` lists nearest to each query, of each source apart."""
    base = database.select(F.col("id").alias("target_id"), "country", "source", "vec")
    met = _top_k(_cells(_asked(queries, database), cells, probes), _cells(base, cells, 1), ["country", "source", "cell"], k)
    return _rounded_top(met, k)


def targets_to_s1(queries: DataFrame, s1: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The other direction: the ``k`` S1 records nearest to each target, (target_id, source, s1_id, country, ``by``, ann_score, ann_rank).

    ``queries`` are targets with id, source, country, vec, a row each (and value of ``by``); S1 records are the database.
    Both may have texts as ``vec``.
    """
    base = s1.select(F.col("id").alias("target_id"), "country", *by, "vec")
    asked = queries.select(F.col("id").alias("s1_id"), "source", "country", *by, "vec")
    found = _top_k(asked, base, ["country", *by], k, ("source",))
    return found.select(F.col("s1_id").alias("target_id"), "source", F.col("target_id").alias("s1_id"), "country", *by, "ann_score", "ann_rank")


#: Dimensions of the vectors of texts.
TEXT_DIMENSIONS = 64


def text_vectors(texts: list[str | None]) -> np.ndarray:
    """Unit vectors of hashed letter triples, a row a text: an encoder that needs no model file.

    Each triple of code points x, y, z of the text between blanks has the number 961 x + 31 y + z;
    its last six bits are the dimension and the bit above them the sign. Texts without any have zeros.
    """
    padded = [f" {t or ''} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(padded)), np.fromiter(map(len, padded), dtype=np.int64, count=len(padded)))
    number = points[:-2] * 961 + points[1:-1] * 31 + points[2:]
    within = row[:-2] == row[2:]
    number, row = number[within], row[:-2][within]
    sign = 1.0 - 2 * (number >> 6 & 1)
    v = np.bincount(row * TEXT_DIMENSIONS + (number & TEXT_DIMENSIONS - 1), sign, len(padded) * TEXT_DIMENSIONS).astype(np.float64).reshape(-1, TEXT_DIMENSIONS)
    n = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return np.divide(v, n, out=v, where=n > 0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_text_vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """:func:`text_vectors` of a column."""
    for part in parts:
        yield pd.Series(list(text_vectors(part.tolist())), dtype=object)


def view_texts(entities: DataFrame, views: tuple[str, ...] = ("name", "address", "combined")) -> DataFrame:
    """(id, source, country, view, text): each view of each normalised record that has a text."""
    text = {"name": F.col("name_norm"), "address": F.col("address_norm"), "combined": F.concat_ws(" ", "name_norm", "address_norm")}
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("view"), text[v].alias("text")) for v in views))).alias("x")
    rows = entities.select(F.col("entity_id").alias("id"), "source", "country", each).where("trim(x.text) <> ''")
    return rows.select("id", "source", "country", "x.view", "x.text")


def view_vectors(entities: DataFrame, views: tuple[str, ...] = ("name", "address", "combined")) -> DataFrame:
    """(id, source, country, view, vec): a vector of each text of :func:`view_texts`."""
    return view_texts(entities, views).withColumn("vec", hashed_text_vectors("text")).drop("text")
