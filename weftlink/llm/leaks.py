"""Problem 7: held-out test items in a corpus, by Wu-Manber search over words.

Words are runs of ASCII letters or digits, lower-cased. The patterns are all runs of ``run`` words
of every item. The search reads a document's words through a window of that length: the last two
words index the shift table, which says how far the window may move without passing a pattern
(run - 1 words for a pair that no pattern has); shift 0 leads to the bucket of patterns that end
so, and direct comparison of the whole window confirms. Item words covered by confirmed windows
are counted once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(rb"[a-z0-9]+")
#: Bytes of item text that one search holds, in tables of some thirty times as much; larger item sets are searched in several passes.
ITEM_BLOCK_BYTES = 2 << 20


def words_of(text: str | bytes) -> list[bytes]:
    """Words of a text; only ASCII letters change case.

    >>> words_of("Über-Flow: CAN't 42")
    [b'ber', b'flow', b'can', b't', b'42']
    """
    return _WORDS.findall((text.encode() if isinstance(text, str) else text).lower())


class WuManber:
    """Shift table and suffix buckets of one block of items.

    Patterns are not stored: a bucket holds the places (item, word) at which its two last words
    end a pattern, and the item's own words are compared there.
    """

    def __init__(self, items: list[tuple[int, str]], run: int = 8) -> None:
        self.run = run
        self.items = [item for item, _ in items]
        self.words: list[list[bytes]] = []
        self.buckets: dict[tuple[bytes, bytes], array] = {}
        self.shift: dict[tuple[bytes, bytes], int] = {}
        known: dict[bytes, bytes] = {}
        for k, (_, text) in enumerate(items):
            words = [known.setdefault(w, w) for w in words_of(text)]
            self.words.append(words)
            for end in range(1, len(words) if len(words) >= run else 0):
                # Behind the first pattern's end every pair ends a pattern; before it, one ends so many words later.
                pair = words[end - 1], words[end]
                self.shift[pair] = min(self.shift.get(pair, run), max(0, run - 1 - end))
                if end >= run - 1:
                    self.buckets.setdefault(pair, array("L")).extend((k, end - run + 1))
        self.last = {pair[1] for pair in self.shift}

    def search(self, words: list[bytes]) -> dict[int, set[int]]:
        """Place of an item → starts of its runs that the words contain."""
        found: dict[int, set[int]] = {}
        run, shift, last, buckets = self.run, self.shift, self.last, self.buckets
        at, size, miss = self.run - 1, len(words), self.run - 1
        while at < size:
            w = words[at]
            if w not in last:
                # No pattern has this word behind another: only as a first word could it count.
                at += miss
                continue
            pair = words[at - 1], w
            step = shift.get(pair, miss)
            if step:
                at += step
                continue
            bucket = buckets[pair]
            here = words[at - run + 1 : at + 1]
            for k, j in zip(bucket[::2], bucket[1::2]):
                if self.words[k][j : j + run] == here:
                    found.setdefault(k, set()).add(j)
            at += 1
        return found

    def leaks(self, text: bytes, least: float) -> Iterator[tuple[int, int, int]]:
        """(item, covered words, words) of items covered to at least the share ``least``."""
        for k, starts in self.search(words_of(text)).items():
            covered, end = 0, 0
            for j in sorted(starts):
                covered += j + self.run - max(j, end)
                end = j + self.run
            if covered >= least * len(self.words[k]):
                yield self.items[k], covered, len(self.words[k])


def find_leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "item_text", run: int = 8, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, covered_words, item_words, covered_share) of every leaked item, each pair once.

    A pair counts if at least the share ``least`` of the item's words lie in runs of ``run`` or
    more consecutive words that item and document share. NULL ids or texts, texts without words
    and items shorter than ``run`` words give nothing. Repeated rows of a document or item, with
    one text or several, give one row (the larger cover). Whole texts are searched. The items are the stated query set: they
    go to the executors in blocks of at most ``ITEM_BLOCK_BYTES``, one pass over the corpus each.
    """
    spark = documents.sparkSession
    out_schema = "doc_id bigint, item_id bigint, covered_words int, item_words int"
    items = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("t")).dropna().distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BLOCK_BYTES))
    corpus = documents.select(F.col(doc_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).dropna()
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        automaton = spark.sparkContext.broadcast(WuManber([(r.item_id, r.t) for r in rows], run))

        def scan(batches: Iterator[pa.RecordBatch], automaton=automaton) -> Iterator[pa.RecordBatch]:
            search = automaton.value
            for batch in batches:
                hits = [(d.as_py(), *hit) for d, t in zip(batch.column(0), batch.column(1)) for hit in search.leaks(t.as_py(), least)]
                cols = list(zip(*hits)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "item_id", "covered_words", "item_words"])

        part = corpus.mapInArrow(scan, out_schema)
        out = part if out is None else out.unionByName(part)
    out = out.groupBy("doc_id", "item_id").agg(F.max("covered_words").alias("covered_words"), F.max("item_words").alias("item_words"))
    return out.withColumn("covered_share", F.round(F.col("covered_words") / F.col("item_words"), 6))
