"""Problem 9: long spans that stand word for word in several documents, by level-wise doubling.

A span of ``span`` characters is looked for from short windows. Anchors choose them: the positions
whose gram of span/16 characters has the least hash of all that start in one stretch of a span.
The choice depends on the text alone, so a shared span holds the same anchors in either document,
and at least one. Anchors whose gram stands in two documents are extended to windows of span/4
about it, and windows that repeat to twice their length, to the right and to the left, and so on
until they are as long as the span or none survive. At full length this tries eight positions of a
span about each anchor, which meets all spans that are a fifth longer; windows of half the length
that repeat beside a document not yet found are then tried at every position, so shorter ones are
found too. Where shared characters are counted, windows that reach beyond what is found already
are tried beside every document. Windows are compared by 64-bit polynomial hashes, at full length by two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.session import cut

#: Characters that are hashed at once in memory; longer texts go in overlapping pieces.
PIECE = 1 << 20
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Hashes of any windows of a piece of text in constant time each."""

    def __init__(self, text: str, count: int = 1) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self.size = len(points)
        letters = _mixed((points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        room = max(PIECE + 4096, 1 << int(self.size).bit_length())
        self.sums = []
        for base in _BASES[:count]:
            power, inverse = _powers(base, room)
            total = np.zeros(self.size + 1, dtype=np.uint64)
            np.cumsum(letters * power[: self.size], out=total[1:])
            self.sums.append((total, inverse))

    def windows(self, starts: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        total, inverse = self.sums[which]
        return _mixed((total[starts + length] - total[starts]) * inverse[starts]).view(np.int64)

    def grams(self, length: int) -> np.ndarray:
        total, inverse = self.sums[0]
        return _mixed((total[length:] - total[:-length]) * inverse[: self.size - length + 1])


def _slide(a: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        a = pick(a[:-span], a[span:])
        span *= 2
    return pick(a[: -(width - span)], a[width - span :]) if width > span else a


def anchor_positions(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least gram of some ``width`` neighbours; of equal ones in a row the ends and one each half width."""
    if len(grams) < width:
        return np.zeros(0, dtype=np.int64)
    least = _slide(grams, width, np.minimum)
    pad = np.zeros(width - 1, dtype=grams.dtype)
    chosen = grams == _slide(np.concatenate([pad, least, pad]), width, np.maximum)
    same = np.zeros(len(grams) + 1, dtype=bool)
    same[1:-1] = chosen[1:] & chosen[:-1] & (grams[1:] == grams[:-1])
    inner = same[:-1] & same[1:]
    place = np.arange(len(grams))
    return np.flatnonzero(chosen & ~(inner & ((place - np.maximum.accumulate(np.where(inner, 0, place))) % max(1, width // 2) > 0)))


def _pieces(texts: list[tuple[int, str]], span: int) -> Iterator[tuple[list[tuple[int, int, int, int]], str]]:
    """Texts joined to pieces of about PIECE characters: ([(doc, first, from, to)], piece).

    ``first`` is the place in the document of the part that lies at from:to of the piece. Long
    texts are cut into parts that overlap by a span, so that every span lies whole in one.
    """
    parts: list[tuple[int, int, int, int]] = []
    held: list[str] = []
    size = 0
    for doc, text in texts:
        for first in range(0, max(1, len(text) - span), PIECE):
            part = text[first : first + PIECE + span]
            parts.append((doc, first, size, size + len(part)))
            held.append(part)
            size += len(part)
            if size >= PIECE:
                yield parts, "".join(held)
                parts, held, size = [], [], 0
    if parts:
        yield parts, "".join(held)


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _anchor_grams(span: int):
    """(doc, at, h): grams of span/16 at the anchors."""
    gram = span // 16

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((d, t) for d, t in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1))) if len(t) >= span)
            for parts, piece in _pieces(texts, span):
                grams = Hasher(piece).grams(gram)
                starts = anchor_positions(grams, span - gram + 1)
                doc, first, low, high = (np.array(c, dtype=np.int64) for c in zip(*parts))
                part = np.searchsorted(low, starts, side="right") - 1
                fits = starts + gram <= high[part]
                starts, part = starts[fits], part[fits]
                yield _batch([doc[part], (starts - low[part] + first[part]).astype(np.int32), grams[starts].view(np.int64)], ["doc", "at", "h"])

    return scan


def _extended(span: int):
    """(doc, at, h, half_k, full_kj): windows of span/4 about repeated grams, with those they extend to.

    A window that begins at ``at`` extends to ``half_0`` to the right and ``half_1`` to the left,
    either of these to ``full_k0`` to the right and ``full_k1`` to the left.
    """
    gram, quarter, half = span // 16, span // 4, span // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, places in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), batch.column(2).to_pylist()):
                places = np.unique(np.array(places, dtype=np.int64))
                for first in range(0, max(1, len(text) - span), PIECE):
                    piece = text[first : first + PIECE + span]
                    own = places[(places >= first) & (places + gram <= first + len(piece))] - first
                    hasher = Hasher(piece)
                    starts = np.unique(np.concatenate([own, own + gram - quarter]))
                    starts = starts[(starts >= 0) & (starts + quarter <= hasher.size)]
                    if not len(starts):
                        continue

                    def at(offset: int, length: int, starts=starts, hasher=hasher) -> pa.Array:
                        s = starts - offset
                        ok = (s >= 0) & (s + length <= hasher.size)
                        return pa.array(hasher.windows(np.where(ok, s, 0), min(length, hasher.size)), mask=~ok)

                    cols = [pa.array(np.full(len(starts), doc, dtype=np.int64)), pa.array((starts + first).astype(np.int32)), at(0, quarter)]
                    for k in (0, 1):
                        cols += [at(k * quarter, half), at(k * quarter, span), at(k * quarter + half, span)]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc", "at", "h", *(f"{n}_{k}{j}" for k in "01" for n, j in (("half", ""), ("full", "0"), ("full", "1")))])

    return scan


def _every_position(span: int):
    """(doc, at, f0, f1): all windows of the span that start in the stretches (lo, hi) given."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, places in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), batch.column(2).to_pylist()):
                for first in range(0, max(1, len(text) - span), PIECE):
                    hasher = Hasher(text[first : first + PIECE + span], 2)
                    mask = np.zeros(hasher.size + 1, dtype=bool)
                    for p in places:
                        mask[max(0, p["lo"] - first) : max(0, p["hi"] - first + 1)] = True
                    starts = np.flatnonzero(mask)
                    starts = starts[starts + span <= hasher.size]
                    if len(starts):
                        yield _batch([np.full(len(starts), doc, dtype=np.int64), (starts + first).astype(np.int32), hasher.windows(starts, span), hasher.windows(starts, span, 1)], ["doc", "at", "f0", "f1"])

    return scan


def _uncovered(span: int):
    """(h, near, far): how far before a repeated half window windows of the span start that add characters to those found.

    Rows are (doc, size, halves, full): the document's length, its half windows (at, h) and the
    places of its windows found. Windows inside what these cover add nothing.
    """
    half = span // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for size, halves, full in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                open_ = np.ones(size - span + 1, dtype=bool)
                low = high = -1
                for p in [*sorted(full or []), size + span]:
                    if p <= high:
                        high = p + span
                        continue
                    if low >= 0:
                        open_[low : high - span + 1] = False
                    low, high = p, p + span
                for x in halves:
                    starts = np.flatnonzero(open_[max(0, x["at"] - (span - half)) : x["at"] + 1])
                    if len(starts):
                        base = max(0, x["at"] - (span - half))
                        out.append((x["h"], int(x["at"] - base - starts[-1]), int(x["at"] - base - starts[0])))
            yield _batch([np.array(c, dtype=t) for c, t in zip(list(zip(*out)) or [()] * 3, (np.int64, np.int32, np.int32))], ["h", "near", "far"])

    return scan


def _repeated(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key stands in two documents. ``windows`` is read twice, so it should be kept."""
    both = windows.groupBy(*keys).agg(F.min("doc").alias("_lo"), F.max("doc").alias("_hi")).where("_lo <> _hi").select(*keys)
    return windows.join(both, keys, "left_semi")


def shared_windows(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", span: int = 600, whole: bool = False) -> DataFrame:
    """(doc, at): places of windows of ``span`` characters that another document has too.

    Every document that shares ``span`` or more consecutive characters (code points, exact) with a
    document of another id has at least one row; repeats inside one document give none. NULL ids
    and texts and texts shorter than ``span`` give nothing. ``span`` is a multiple of 4 and at
    least 64. With ``whole`` the windows cover every shared stretch of ``span`` or more to its ends.
    """
    if span % 4 or span < 64:
        raise ValueError("span must be a multiple of 4 and at least 64")
    corpus = documents.select(F.col(doc_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where(F.length("text") >= span).where("doc IS NOT NULL")
    grams = cut(corpus.mapInArrow(_anchor_grams(span), "doc bigint, at int, h bigint"))
    first = _repeated(grams, ["h"]).groupBy("doc").agg(F.collect_set("at").alias("places"))
    schema = "doc bigint, at int, h bigint, " + ", ".join(f"half_{k} bigint, full_{k}0 bigint, full_{k}1 bigint" for k in "01")
    quarters = cut(corpus.join(first, "doc").select("doc", "text", "places").mapInArrow(_extended(span), schema))
    wide = [F.struct((F.col("at") - k * (span // 4)).alias("at"), F.col(f"half_{k}").alias("h"), F.col(f"full_{k}0").alias("f0"), F.col(f"full_{k}1").alias("f1")) for k in (0, 1)]
    halves = _repeated(quarters, ["h"]).select("doc", F.explode(F.array(*wide)).alias("x")).select("doc", "x.*").where("h IS NOT NULL")
    halves = cut(_repeated(cut(halves), ["h"]))
    # The half's hash, equal where the whole is, makes the comparison one of 128 bits.
    wide = [F.struct((F.col("at") - j * (span // 2)).alias("at"), F.lit(j).alias("j"), F.col(f"f{j}").alias("f")) for j in (0, 1)]
    full = halves.select("doc", "h", F.explode(F.array(*wide)).alias("x")).select("doc", "h", "x.*").where("f IS NOT NULL")
    full = cut(_repeated(full, ["h", "j", "f"]).select("doc", "at").distinct())
    if whole:
        # Every shared stretch has a repeated half window in each of its windows; starts that add characters for any document are tried in all that have this half.
        sizes = corpus.groupBy("doc").agg(F.max(F.length("text")).alias("size"))
        known = halves.groupBy("doc").agg(F.collect_set(F.struct("at", "h")).alias("halves")).join(full.groupBy("doc").agg(F.collect_set("at").alias("full")), "doc", "left").join(sizes, "doc")
        keys = known.select("doc", "size", "halves", "full").mapInArrow(_uncovered(span), "h bigint, near int, far int").groupBy("h").agg(F.min("near").alias("near"), F.max("far").alias("far"))
        rest = halves.join(keys, "h")
    else:
        # Windows of half the length beside a document not found yet, at every position.
        open_ = halves.select("doc", "h", "at").join(full.select("doc").distinct().withColumn("done", F.lit(True)), "doc", "left")
        keys = open_.where("done IS NULL").select("h").distinct()
        rest = open_.join(keys, "h", "left_semi").withColumns({"near": F.lit(0), "far": F.lit(span - span // 2)})
    rest = rest.groupBy("doc").agg(F.collect_set(F.struct((F.col("at") - F.col("far")).alias("lo"), (F.col("at") - F.col("near")).alias("hi"))).alias("places"))
    every = corpus.join(rest, "doc").select("doc", "text", "places").mapInArrow(_every_position(span), "doc bigint, at int, f0 bigint, f1 bigint")
    return full.unionByName(_repeated(cut(every), ["f0", "f1"]).select("doc", "at"))


def shared_documents(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", span: int = 600) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share): documents with spans that stand elsewhere.

    ``shared_chars`` counts the characters of all stretches of ``span`` or more that stand in
    another document, each once.
    """
    at = shared_windows(documents, doc_col, text_col, span, whole=True).distinct()
    ordered = at.groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("places"))
    merged = F.aggregate("places", F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")), lambda acc, p: F.struct((p + span).alias("end"), (acc["sum"] + p + span - F.greatest(p, acc["end"])).alias("sum")))
    sizes = documents.select(F.col(doc_col).cast("bigint").alias("doc"), F.length(text_col).alias("n_chars")).groupBy("doc").agg(F.max("n_chars").alias("n_chars"))
    out = ordered.select("doc", merged["sum"].alias("shared_chars")).join(sizes, "doc")
    return out.select(F.col("doc").alias("doc_id"), "n_chars", "shared_chars", F.round(F.col("shared_chars") / F.col("n_chars"), 6).alias("shared_share"))
