"""Fuzzy similarities as vectorised UDFs, for what no built-in expresses."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _places(a: str) -> dict[str, int]:
    """Positions of each character as bits."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    return at


def _subsequence(at: dict[str, int], size: int, b: str) -> int:
    full = (1 << size) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = (row + hit | row - hit) & full
    return size - row.bit_count()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over Python integers."""
    if a == b:
        return len(a)
    # What both begin and end with belongs to one of the longest.
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < high - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[low : len(a) - tail], b[low : len(b) - tail]
    return low + tail + (_subsequence(_places(a), len(a), b) if a and b else 0)


def ratio(a: str, b: str) -> float:
    """2 * LCS / total length; 1 for two empty texts."""
    total = len(a) + len(b)
    return 1.0 if not total else 2 * common_subsequence(a, b) / total


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio between the shared words, and the shared words with either side's rest; 0 if a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(z))])) for z in (x - y, y - x))
    if both and (x <= y or y <= x):
        return 1.0
    # The shared words begin either side, so they are what they have in common with it.
    begins = max(2 * len(both) / (len(both) + len(x)) for x in (left, right)) if both else 0.0
    return max(ratio(left, right), begins)


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Best ratio of the shorter text with any stretch of its length in the longer one, or ``least`` if none is above it.

    Stretches are tried in the order of the characters they share with the shorter text, counted
    while the stretch slides, until none left can be better.
    """
    short, long = sorted((a, b), key=len)
    size = len(short)
    if not short:
        return float(not long)
    if short in long:
        return 1.0
    wanted = Counter(short)
    shared, bounds = 0, []
    for i, ch in enumerate(long):
        if ch in wanted:
            shared += wanted[ch] > 0
            wanted[ch] -= 1
        if i >= size:
            gone = long[i - size]
            if gone in wanted:
                wanted[gone] += 1
                shared -= wanted[gone] > 0
        if i >= size - 1:
            bounds.append(shared)
    at, best = _places(short), least * size
    for i in sorted(range(len(bounds)), key=bounds.__getitem__, reverse=True):
        if bounds[i] <= best:
            break
        best = max(best, _subsequence(at, size, long[i : i + size]))
    return best / size


def likenesses(a: str, b: str) -> tuple[float, float, float]:
    """(plain ratio, weighted ratio, word-set ratio) of two texts, each part computed once.

    The weighted one is a composite of our own: the plain ratio, 0.95 of that over sorted or shared
    words, 0.9 of the partial one for texts of unlike lengths; 0 if a text is empty.
    """
    if not a or not b:
        return ratio(a, b), 0.0, 0.0
    if a == b:
        return 1.0, 1.0, token_set_ratio(a, b)
    plain, words = ratio(a, b), token_set_ratio(a, b)
    best = max(plain, 0.95 * words)
    if best < 0.95:
        best = max(best, 0.95 * ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
    if best < 0.9 and max(len(a), len(b)) > 1.5 * min(len(a), len(b)):
        best = max(best, 0.9 * partial_ratio(a, b, best / 0.9))
    return plain, best, words


def weighted_ratio(a: str, b: str) -> float:
    return likenesses(a, b)[1]


_SIDES = [f"{side}_{kind}" for side in ("name", "address") for kind in ("ratio", "wratio", "token_set")]


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in _SIDES]))
def likenesses_udf(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """All six likenesses of two names and two addresses in one pass; equal text pairs of a batch are compared once."""
    for columns in parts:
        names, addresses = ([(x or "", y or "") for x, y in zip(*pair)] for pair in (columns[:2], columns[2:]))
        known = {pair: likenesses(*pair) for pair in {*names, *addresses}}
        yield pd.DataFrame([known[n] + known[a] for n, a in zip(names, addresses)], columns=_SIDES, dtype="float64")
