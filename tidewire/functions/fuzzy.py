"""Fuzzy string scores from 0 to 100, by longest common subsequences; Arrow functions for columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one addition of whole numbers for each character of ``b``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    state = mask
    for c in b:
        hit = state & places.get(c, 0)
        state = (state + hit | state - hit) & mask
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common length over both lengths."""
    total = len(a) + len(b)
    return 200.0 * common_length(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a part of the longer one: a part of its length, or a shorter one at either end."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n = len(short)
    parts = [long[max(0, i - n) : i] for i in range(1, len(long) + 1)] + [long[i:] for i in range(len(long) - n + 1, len(long))]
    return max(ratio(short, part) for part in set(parts))


def token_set_ratio(a: str, b: str) -> float:
    """The best of three ratios: what only one side's words say against the other's, and the shared words against either side."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared, own, other = (" ".join(sorted(x)) for x in (left & right, left - right, right - left))
    if shared and not (own and other):
        return 100.0
    gap = bool(shared)
    whole = (len(shared) + gap + len(own), len(shared) + gap + len(other))
    best = 100.0 - 100.0 * (len(own) + len(other) - 2 * common_length(own, other)) / sum(whole)
    if shared:
        best = max(best, *(100.0 - 100.0 * (n - len(shared)) / (len(shared) + n) for n in whole))
    return best


def _scored(score, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def partial_ratio_of(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``partial_ratio`` of two string columns; null where either is."""
    for a, b in rows:
        yield _scored(partial_ratio, a, b)


@pandas_udf(DoubleType())
def token_set_ratio_of(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``token_set_ratio`` of two string columns; null where either is."""
    for a, b in rows:
        yield _scored(token_set_ratio, a, b)


class NameIndex:
    """Names that a text may hold misspelt, found by the letter pairs that they share.

    A partial ratio of ``least`` leaves few edits between a name of n letters
    and its place in the text: inserted and deleted letters are at most the
    share ``2 - least / 50`` of n, and each takes two of the name's n - 1 pairs
    at most.  So names with fewer pairs in the text, or much longer than it, are
    never compared; the others are verified.
    """

    def __init__(self, names: list[str], least: float = 92.0):
        self.names, self.least = names, least
        self.pairs: dict[str, dict[int, int]] = {}
        self.needed: list[int] = []
        for i, name in enumerate(names):
            for pair in zip(name, name[1:], strict=False):
                own = self.pairs.setdefault("".join(pair), {})
                own[i] = own.get(i, 0) + 1
            self.needed.append(len(name) - 1 - 2 * int(len(name) * (2 - least / 50) + 1e-9))
        self.always = [i for i, n in enumerate(self.needed) if n <= 0]
        self.compared = 0

    def candidates(self, text: str) -> list[int]:
        counts: dict[int, int] = {}
        for pair in {text[k : k + 2] for k in range(len(text) - 1)}:
            for i, n in self.pairs.get(pair, {}).items():
                counts[i] = counts.get(i, 0) + n
        # A name longer than the text is the one that a part is taken of: its pairs say nothing.
        longer = [i for i, name in enumerate(self.names) if len(name) > len(text)]
        return sorted({*self.always, *longer, *(i for i, n in counts.items() if n >= self.needed[i])})

    def best(self, text: str, top: int) -> list[tuple[int, float]]:
        """(number of the name, score) of the ``top`` names of the highest scores, the first named on ties, from ``least`` on."""
        found = self.candidates(text)
        self.compared += len(found)
        scored = [(i, partial_ratio(self.names[i], text)) for i in found]
        return sorted((x for x in scored if x[1] >= self.least), key=lambda x: (-x[1], x[0]))[:top]


def nearest_names(names: list[str], top: int = 3, least: float = 92.0):
    """An Arrow function: the ``top`` of ``names`` by partial ratio with a text, as (name, score); null of a null."""
    kind = ArrayType(StructType([StructField("name", StringType()), StructField("score", DoubleType())]))

    @pandas_udf(kind)
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = NameIndex(names, least)
        for texts in batches:
            yield pd.Series([None if t is None else [{"name": names[i], "score": s} for i, s in index.best(t, top)] for t in texts], dtype=object)

    return nearest
