"""Spelling variants: words at one edit, found by k-d trees over letter counts.

One edit changes a word's letter counts by two at most: a replaced letter adds
one and takes one away, an inserted one adds one.  So the words of a length are
points in the space of letter counts, and those near a word lie in a small box
around it.  Each pair of lengths (equal ones, and a length with the next) is
searched by itself.

A k-d tree fitted on a bounded sample divides the space of each length into
parts of a bounded number of words, and every word is sent to the one it lies
in and to those its box meets; each part is a task's group with a k-d tree of
its own.  What has near enough counts is compared letter by letter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_hash, materialize
from .kdtree import KdTree

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words and characters that a part of a length's space is divided for, and words that all these trees are fitted on.
PART_WORDS, PART_CHARS, FIT_WORDS = 20_000, 4_000_000, 200_000
#: Vectors in a leaf of a part's own tree.
LEAF = 16
#: Pairs of words compared at once, and those of two equal letter counts above which they are looked up by what is left of them.
CHUNK, MANY = 1 << 20, 4096
#: (letters added, letters taken) between words of one length, and from a length to the next.
REPLACED, INSERTED = (1, 1), (1, 0)


def word_counts(docs: DataFrame, slips: int = 0, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of the runs of Latin letters in the texts of ``docs`` (doc_id, text), A-Z lower-cased.

    Words of fewer than ``shortest`` code points or ``least`` occurrences are
    left out.  Where ``slips`` is above 0, a run loses a letter if it divides
    the crc32 of ``<doc_id>:<run>``: the one at that number modulo the length.
    Null texts have no words; a null doc_id counts as an empty one.
    """
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("word"))
    if slips:
        runs = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary")))
        at = (F.col("_h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("word", F.when(F.col("_h") % slips == 0, cut).otherwise(F.col("word")))
    counted = runs.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least)


def part_words(length: int) -> int:
    """How many words of a length a part is divided for."""
    return max(1, min(PART_WORDS, PART_CHARS // max(1, length)))


class Letters:
    """Code points of words of one length, and their counts over an alphabet."""

    def __init__(self, words: list[str], length: int, alphabet: np.ndarray | None = None):
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length)
        self.codes = codes
        self.alphabet = np.unique(codes) if alphabet is None else alphabet
        at = np.searchsorted(self.alphabet, codes)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == codes if len(self.alphabet) else np.zeros(codes.shape, bool)
        size = len(self.alphabet)
        flat = (at + np.arange(len(words))[:, None] * size)[known]
        counts = np.bincount(flat, minlength=len(words) * size).reshape(len(words), size)
        self.counts = counts.astype(np.uint8 if length < 256 else np.int32)


class Space:
    """The parts of a length's space: fitted on a sample of its words, for ``total`` words in all."""

    def __init__(self, sample: list[str], length: int, total: int):
        letters = Letters(sample, length)
        self.alphabet = letters.alphabet
        self.tree = KdTree(letters.counts, len(sample) * part_words(length) / total).forget()

    def parts(self, words: list[str], length: int, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        return self.tree.search(Letters(words, length, self.alphabet).counts, up, down)


ROUTED = pa.schema([("size", pa.int32()), ("part", pa.int32()), ("kind", pa.int8()), ("word", pa.string()), ("n", pa.int64())])


def route(words: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """``words`` (word, n) in the parts of their length (kind 0), and in those that may hold near ones: of it (1) and of the next (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length = defaultdict(list)
            for k, word in enumerate(batch.column(0).to_pylist()):
                by_length[len(word)].append((k, word))
            for length, own in by_length.items():
                rows, texts = np.array([k for k, _ in own]), [w for _, w in own]
                home = np.zeros(len(own), np.int64)
                sent = []
                if space := spaces.get(length):
                    for part, found in space.parts(texts, length, 0, 0):
                        home[found] = part
                    for part, found in space.parts(texts, length, *REPLACED):
                        sent.append((length, part, 1, found[home[found] != part]))
                sent += [(length, part, 0, np.flatnonzero(home == part)) for part in np.unique(home).tolist()]
                if space := spaces.get(length + 1):
                    sent += [(length + 1, part, 2, found) for part, found in space.parts(texts, length, *INSERTED)]
                else:
                    sent.append((length + 1, 0, 2, np.arange(len(own))))
                for size, part, kind, found in sent:
                    if len(found):
                        taken = batch.take(pa.array(rows[found]))
                        heads = [np.full(len(found), x, t) for x, t in ((size, np.int32), (part, np.int32), (kind, np.int8))]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, heads), taken.column(0), taken.column(1)], schema=ROUTED)

    return words.mapInArrow(run, "size int, part int, kind byte, word string, n long")


def near_vectors(tree: KdTree, entries: np.ndarray, asked: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of (asked, entry) vectors where exactly ``up`` is added and ``down`` taken away."""
    for leaf, rows in tree.search(asked, up, down):
        own = tree.leaves[leaf]
        first, last = entries[own].min(axis=0), entries[own].max(axis=0)
        width = entries.shape[1] * len(own)
        for k in range(0, len(rows), max(1, (CHUNK * 8) // width)):
            part = rows[k : k + max(1, (CHUNK * 8) // width)]
            values = asked[part].astype(np.int16 if asked.dtype == np.uint8 else np.int64)
            box = (np.maximum(first - values, 0).sum(axis=1) <= up) & (np.maximum(values - last, 0).sum(axis=1) <= down)
            part, values = part[box], values[box]
            apart = entries[own][None, :, :] - values[:, None, :]
            # Lengths fix the sum, so the sum of what is added tells that of what is taken away.
            a, b = np.nonzero(np.maximum(apart, 0).sum(axis=2) == up)
            yield part[a], own[b]


class Vectors:
    """Distinct letter counts of words, and the words of each."""

    def __init__(self, counts: np.ndarray):
        flat = np.ascontiguousarray(counts).view(np.dtype((np.void, counts.dtype.itemsize * counts.shape[1]))).ravel()
        _, first, number, times = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
        self.distinct = counts[first]
        self.words = np.argsort(number, kind="stable")
        self.times = times
        self.starts = np.cumsum(times) - times


def one_edit(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by one replaced letter, or by one inserted into ``shorter``."""
    n = shorter.shape[1]
    differs = shorter != longer[:, :n]
    if longer.shape[1] == n:
        return differs.sum(axis=1) == 1
    after = np.logical_or.accumulate(differs, axis=1)
    return ~(after & (shorter != longer[:, 1:])).any(axis=1)


def _remainders(codes: np.ndarray, rows: np.ndarray, letter: int) -> Iterator[tuple[tuple[int, bytes], int]]:
    for k in rows.tolist():
        own = codes[k]
        for p in np.flatnonzero(own == letter).tolist():
            yield (p, own[:p].tobytes() + own[p + 1 :].tobytes()), k


def near_words(asked: Letters, entries: Letters, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of (asked, entry) words at exactly one edit; each pair once."""
    if not len(asked.codes) or not len(entries.codes):
        return
    own, others = Vectors(entries.counts), Vectors(asked.counts)
    tree = KdTree(own.distinct, LEAF)
    # A letter stands for itself in as few bytes as will do.
    kind = np.uint8 if entries.alphabet[-1] < 256 else np.uint32
    near, far = asked.codes.astype(kind), entries.codes.astype(kind)
    for a, b in near_vectors(tree, own.distinct, others.distinct, up, down):
        pairs = others.times[a] * own.times[b]
        # Words of the same letters in great number: those with the same rest once the changed letter is gone.
        for q, e in zip(a[pairs > MANY].tolist(), b[pairs > MANY].tolist(), strict=True):
            apart = own.distinct[e].astype(np.int64) - others.distinct[q]
            gained, lost = np.flatnonzero(apart > 0), np.flatnonzero(apart < 0)
            ours = others.words[others.starts[q] :][: others.times[q]]
            theirs = own.words[own.starts[e] :][: own.times[e]]
            rest = defaultdict(list)
            for key, k in _remainders(far, theirs, entries.alphabet[gained[0]]):
                rest[key].append(k)
            if down:
                found = {(k, x) for key, k in _remainders(near, ours, entries.alphabet[lost[0]]) for x in rest.get(key, ())}
            else:
                whole = {near[k].tobytes(): k for k in ours.tolist()}
                found = {(whole[key[1]], x) for key, xs in rest.items() if key[1] in whole for x in xs}
            if found:
                yield tuple(np.array(x) for x in zip(*sorted(found), strict=True))
        few = pairs <= MANY
        a, b, pairs = a[few], b[few], pairs[few]
        ends = np.cumsum(pairs)
        cuts = [0, *np.unique(np.searchsorted(ends, np.arange(CHUNK, ends[-1], CHUNK)) + 1).tolist(), len(a)] if len(a) else []
        for first, last in pairwise(cuts):
            n = pairs[first:last]
            which = np.repeat(np.arange(first, last), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = own.times[b[which]]
            q, e = others.words[others.starts[a[which]] + at // wide], own.words[own.starts[b[which]] + at % wide]
            for k in range(0, len(q), max(1, CHUNK * 8 // far.shape[1])):
                x, y = q[k:][: max(1, CHUNK * 8 // far.shape[1])], e[k:][: max(1, CHUNK * 8 // far.shape[1])]
                same = one_edit(near[x], far[y])
                yield x[same], y[same]


FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def search_part(table: pa.Table) -> pa.Table:
    """Of each word in a part: how many near words it has through this part, and the best of them."""
    length = table.column("size")[0].as_py()
    table = table.sort_by([("kind", "ascending"), ("word", "ascending")])
    kinds = table.column("kind").to_numpy()
    words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
    bounds = np.searchsorted(kinds, [0, 1, 2, 3])
    entries = Letters(words[: bounds[1]], length)
    none = np.zeros(0, np.int64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = [(none, none)]
    if bounds[1] and length:
        for kind, size, costs in ((0, length, REPLACED), (1, length, REPLACED), (2, length - 1, INSERTED)):
            first, last = bounds[kind], bounds[kind + 1]
            # An asked letter that no entry has can only be the one that is replaced: it is of the alphabet too.
            asked = Letters(words[first:last], size)
            alphabet = np.union1d(entries.alphabet, asked.alphabet)
            asked, own = Letters(words[first:last], size, alphabet), Letters(words[: bounds[1]], length, alphabet)
            for a, b in near_words(asked, own, *costs):
                a = a + first
                if kind < 2:
                    # Each pair of one length is met from both of its words.
                    once = np.array([words[x] < words[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
                    a, b = a[once], b[once]
                pairs.append((a, b))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    own, other = np.concatenate([a, b]), np.concatenate([b, a])
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[other], -counts[other], own))
    own, other = own[order], other[order]
    met, first, times = np.unique(own, return_index=True, return_counts=True)
    best = other[first]
    return pa.table([pa.array([words[k] for k in met.tolist()], pa.string()), pa.array(times, pa.int64()), pa.array(counts[best], pa.int64()), pa.array([words[k] for k in best.tolist()], pa.string())], schema=FOUND)


def near_counts(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of those of ``words`` (word, n; distinct words) that have a near word; near is that of largest n, the first in code-point order on ties."""
    size = F.length("word")
    sizes = words.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("total"))
    total = words.count()
    # Lengths that one part can't hold: not more than words over the bound of a part.
    limit = F.greatest(F.lit(1), F.least(F.lit(PART_WORDS), F.floor(PART_CHARS / F.greatest("size", F.lit(1)))))
    large = {r["size"]: r["total"] for r in sizes.filter(F.col("total") > limit).collect()}
    spaces = {}
    if large:
        sample = defaultdict(list)
        for r in by_hash(words, FIT_WORDS / total, "word").select("word").collect():
            sample[len(r["word"])].append(r["word"])
        spaces = {length: Space(sample[length], length, n) for length, n in large.items() if sample[length]}
    found = route(words, spaces).groupBy("size", "part").applyInArrow(search_part, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    return merged.select("word", "n_near", (-F.col("_best.minus")).alias("near_n"), F.col("_best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of ``forms`` (word, form) over form after form to the last.

    Each round doubles the steps, and a form has several times its word's
    occurrences, so there are few rounds.
    """
    live = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = live.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = materialize(live.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        live = after.select("word", "root")
        if after.filter("_moved").isEmpty():
            return live


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of ``words`` (word, n).

    Two words are near at exactly one inserted, deleted or replaced code point.
    A word's form is its near word of largest n (ties: the smallest), if that n
    is ``ratio`` times its own at least, else null; root is reached over form
    after form.  Words that repeat are one, with the sum of their n; null words
    are left out, a null n is 0; other columns are ignored; an empty table
    gives none.
    """
    words = words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    words = materialize(words, "spelling-words")
    near = near_counts(words)
    has_form: Column = F.col("near_n") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("near")).alias("form"), F.when(has_form, F.col("near_n")).alias("form_n")
    )
    joined = materialize(joined, "spelling-forms")
    last = roots(joined.filter("form is not null"))
    return joined.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
