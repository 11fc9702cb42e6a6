"""Fragments of an alignment of two token streams over the same bytes, and how they compose.

A fragment covers a range of bytes: the tokens of either stream that end in it.
Where tokens of both streams end, a group closes.  What comes before the first
such place and after the last one is open, as it belongs to a group that began
before the range, or ends after it:

    open prefix | closed groups | open suffix

Two neighbouring fragments compose to one: the left suffix and the right prefix
are joined, and make a group if both sides have a place where groups close.
Composition is associative, so any tree of it gives the same groups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tokens:
    """Ids and ends (byte offsets) of consecutive tokens of both streams."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([x, y]) for x, y in zip(self.parts(), other.parts(), strict=True)))

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.a, self.a_ends, self.b, self.b_ends

    def cut(self, i: int, j: int, k: int, m: int) -> Tokens:
        return Tokens(self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])

    def __len__(self) -> int:
        return len(self.a) + len(self.b)


NOTHING = Tokens(*(np.zeros(0, np.int64) for _ in range(4)))


@dataclass
class Fragment:
    """``closed`` says whether a group closes in the range; if none does, all tokens are in the prefix."""

    prefix: Tokens
    closed: bool
    suffix: Tokens


#: The name of each id with a separator after it: "," inside a stream's part of a group, "|" after the first stream's, ";" after the group.
Names = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Groups:
    """Whole groups in a row: their tokens, and where each ends in either stream."""

    tokens: Tokens = field(default_factory=lambda: NOTHING)
    a_cuts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    b_cuts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __len__(self) -> int:
        return len(self.a_cuts)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pairs of tokens whose bytes overlap, in order, and the byte offset at which the bytes of each end.

        Each token of a stream begins where the one before it ends, so every
        end of either stream closes the bytes that one pair shares.
        """
        t = self.tokens
        if not len(self):
            return t.a[:0], t.b[:0], t.a_ends[:0]
        base = min(t.a_ends[0], t.b_ends[0])
        marks = np.zeros((2, t.a_ends[-1] - base + 1), np.int8)
        marks[0, t.a_ends - base] = 1
        marks[1, t.b_ends - base] = 1
        ends = np.flatnonzero(marks[0] | marks[1])
        # How many tokens end before.
        which = [(np.cumsum(m, dtype=np.int64) - m)[ends] for m in marks]
        return t.a[which[0]], t.b[which[1]], ends + base

    def words(self, names: Names) -> np.ndarray:
        """The ids' ``names``, in order, with the separator that follows each."""
        a, b = self.tokens.a, self.tokens.b
        inside, between, after = names
        out = np.empty(len(a) + len(b), object)
        if not len(self):
            return out
        at_a = np.arange(len(a)) + np.repeat(np.concatenate([[0], self.b_cuts[:-1]]), np.diff(self.a_cuts, prepend=0))
        at_b = np.arange(len(b)) + np.repeat(self.a_cuts, np.diff(self.b_cuts, prepend=0))
        out[at_a], out[at_b] = inside[a], inside[b]
        out[at_a[self.a_cuts - 1]] = between[a[self.a_cuts - 1]]
        out[at_b[self.b_cuts - 1]] = after[b[self.b_cuts - 1]]
        return out

    def text(self, names: Names) -> str:
        """``a1,a2|b1;a3|b2,b3``: decimal ids in order."""
        return "".join(self.words(names).tolist())[:-1]


def common_ends(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of both streams that end where one of the other does."""
    if not len(tokens.a) or not len(tokens.b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = min(tokens.a_ends[0], tokens.b_ends[0])
    marks = np.zeros((2, max(tokens.a_ends[-1], tokens.b_ends[-1]) - base + 1), bool)
    marks[0, tokens.a_ends - base] = True
    marks[1, tokens.b_ends - base] = True
    return np.flatnonzero(marks[1, tokens.a_ends - base]), np.flatnonzero(marks[0, tokens.b_ends - base])


def whole(tokens: Tokens) -> Groups:
    """All groups of tokens that begin and end where groups do."""
    i, j = common_ends(tokens)
    return Groups(tokens, i + 1, j + 1)


def split(tokens: Tokens) -> tuple[Fragment, Groups]:
    """The fragment of a range's tokens, and the groups that are whole in it."""
    i, j = common_ends(tokens)
    if not len(i):
        return Fragment(tokens, False, NOTHING), Groups()
    a_first, a_last, b_first, b_last = i[0] + 1, i[-1] + 1, j[0] + 1, j[-1] + 1
    prefix = tokens.cut(0, a_first, 0, b_first)
    suffix = tokens.cut(a_last, len(tokens.a), b_last, len(tokens.b))
    return Fragment(prefix, True, suffix), Groups(tokens.cut(a_first, a_last, b_first, b_last), i[1:] + 1 - a_first, j[1:] + 1 - b_first)


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, Tokens | None]:
    """Both as one, and the tokens of the group that closes between them, if one does."""
    if not left.closed and not right.closed:
        return Fragment(left.prefix + right.prefix, False, NOTHING), None
    if not left.closed:
        return Fragment(left.prefix + right.prefix, True, right.suffix), None
    if not right.closed:
        return Fragment(left.prefix, True, left.suffix + right.prefix), None
    return Fragment(left.prefix, True, right.suffix), left.suffix + right.prefix


#: What comes before the first token of a document: composed with it, its prefix is a group.
START = Fragment(NOTHING, True, NOTHING)
