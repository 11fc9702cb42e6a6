"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters, accents, and digits
and signs that stand for letters.  A listed term counts as a whole word, a
learned one where a word starts with it, unless an exception phrase covers it.
The sum of the terms' weights over the text's length and over its logarithm,
and the greatest weight, go through a fitted logistic curve.

Terms come from a short fixed list and from labelled rows: word beginnings
that are significantly more frequent in toxic texts than in others.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, plainly_named, text_batches, train_fold

# Common insults, and harmless phrases that hold one.
INSULTS = ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "stupidity", "imbecile", "dumbass", "scum", "scumbag", "loser", "losers", "pathetic", "worthless", "disgusting", "trash", "clown", "clowns", "bastard", "bitch", "asshole", "retard", "fuck", "fucking", "shit", "cunt", "whore", "slut")
HARMLESS = ("trash can", "trash bag", "trash bin", "class clown", "clown fish", "clownfish", "scumble", "circus clown", "shitake", "loser bracket", "losers bracket")
# Characters that stand for a letter.  i, l and 1 are one class.
STANDS_FOR = {
    "a": "4@αа", "b": "8β", "c": "с¢", "e": "3еε€", "g": "9", "h": "һ", "i": "1l|іιї", "k": "κк", "m": "м", "n": "п", "o": "0оοσ", "p": "рρ", "s": "5$ѕ", "t": "7τт", "u": "υ", "v": "ν", "x": "хχ", "y": "у", "d": "ԁ", "j": "ј", "w": "ω",
}

#: Labelled rows that the lexicon is learned from at most, and bytes of their texts.
FIT_ROWS, FIT_BYTES = 8000, 100_000_000
#: A learned term is at least so long, and its chance under no link with toxicity is at most this.
SHORTEST, LONGEST, CHANCE = 4, 12, 1e-7
#: Log of the least ratio of rates of a learned term, and the weight from which words that begin with it may become exceptions.
RATIO, SURE = math.log(4.0), 5.0
WORD = regex.compile(r"[^\W_]+")


def _folds() -> dict[int, str]:
    out = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if base.isascii():
            out[c] = base
    for letter, others in STANDS_FOR.items():
        out |= {ord(x): letter for x in others}
    # What an accented or wide character folds to is folded too.
    return {c: {"l": "i"}.get(x, x) for c, x in out.items()} | {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}


FOLDS = _folds()


def fold(text: str) -> str:
    return text.lower().translate(FOLDS)


def log_chance(k: int, n: int, p: float) -> float:
    """An upper bound of the log of the chance of ``k`` of ``n`` or more at rate ``p`` (Chernoff)."""
    q = k / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[str]
    #: Terms that count as whole words only.
    whole: frozenset[str] = frozenset()
    #: Intercept, and slopes of the three measures of ``evidence``.
    curve: tuple[float, ...] = (-4.0, 4.0, 1.0, 1.0)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "whole": self.whole, "curve": self.curve}

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight, term in self.whole))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None, True))
        if len(found):
            found.make_automaton()
        return found

    def evidence(self, text: str) -> tuple[float, float, float]:
        """The terms' weights in a text: their sum over a measure of its logarithmic length, over its length, and the greatest."""
        if not len(self.automaton):
            return 0.0, 0.0, 0.0
        folded = fold(text)
        hits, covered = [], []
        for end, (n, weight, whole) in self.automaton.iter(folded):
            start = end - n + 1
            if (start and folded[start - 1].isalnum()) or (whole and folded[end + 1 : end + 2].isalnum()):
                continue
            if weight is None:
                covered.append((start, end))
            else:
                hits.append((start, end, weight))
        # The furthest end of the phrases that start no later than each.
        covered.sort()
        starts, ends = [a for a, _ in covered], list(accumulate((b for _, b in covered), max))
        best: dict[int, float] = {}
        for start, end, weight in hits:
            i = bisect_right(starts, start)
            if not i or ends[i - 1] < end:
                best[start] = max(best.get(start, 0.0), weight)
        if not best:
            return 0.0, 0.0, 0.0
        total, pages = sum(best.values()), len(folded) / 300
        return total / (1 + math.log1p(pages)), total / (1 + pages), max(best.values())

    def score(self, text: str | None) -> float:
        x = self.curve[0] + sum(b * v for b, v in zip(self.curve[1:], self.evidence(text or ""), strict=True))
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0

    @classmethod
    def learn(cls, texts: list[str], toxic: list[int]) -> Lexicon:
        """Terms, exceptions and curve from labelled texts; without both labels the fixed list alone."""
        base = {fold(t): 4.0 for t in INSULTS}
        safe = {fold(t) for t in HARMLESS}
        if not sum(toxic) or sum(toxic) == len(toxic):
            return cls(base, safe, frozenset(base))
        words = lambda i: set(WORD.findall(fold(texts[i])))  # noqa: E731  made anew each time, as sets of all rows are large
        # Of copies and near copies one counts: those that share their words of least checksum.
        one = {(y, *heapq.nsmallest(4, (zlib.crc32(w.encode()) for w in words(i)))): i for i, y in enumerate(toxic)}
        bad, good = [i for i in one.values() if toxic[i]], [i for i in one.values() if not toxic[i]]
        n1, n0 = len(bad), len(good)
        rate, least = n1 / (n1 + n0), math.log(CHANCE)
        # A beginning can only be as frequent as the one before its last letter.
        starts: dict[str, int] = {}
        sets, last = [words(i) for i in bad], None
        for k in range(SHORTEST, LONGEST + 1):
            counts = Counter(p for s in sets for p in {w[:k] for w in s if len(w) >= k and (last is None or w[: k - 1] in last)})
            last = {p: n for p, n in counts.items() if n * math.log(rate) <= least}
            starts |= last
        maybe = set(starts)
        others = Counter(p for i in good for p in {w[:k] for w in words(i) for k in range(SHORTEST, min(LONGEST, len(w)) + 1)} & maybe)
        chosen: dict[str, float] = {}
        after: dict[str, list[str]] = {}
        for q in maybe:
            after.setdefault(q[:-1], []).append(q)
        for p in sorted(maybe, key=lambda p: (len(p), p)):
            k, m = starts[p], others[p]
            weight = math.log((k + 0.5) / n1 / ((m + 0.5) / n0))
            before = max((chosen[p[:j]] for j in range(SHORTEST, len(p)) if p[:j] in chosen), default=0.0)
            # A longer beginning must tell clearly more than a shorter one that is in.
            if weight < max(RATIO, before + RATIO / 2) or log_chance(k, k + m, rate) > least:
                continue
            # The longest beginning that as good as all of them share is the least likely to meet other words.
            while longer := [q for q in after.get(p, ()) if starts[q] >= 0.95 * k]:
                p = longer[0]
            chosen[p] = weight
        seen1, seen0 = Counter(), Counter()
        for seen, rows in ((seen1, bad), (seen0, good)):
            for i in rows:
                seen.update(w for w in words(i) if any(chosen.get(w[:j], 0.0) > SURE for j in range(SHORTEST, len(w) + 1)))
        safe |= {w for w, m in seen0.items() if m >= 2 and seen1[w] < m and w not in base}
        out = cls(base | chosen, safe, frozenset(base) - set(chosen))
        out.curve = fit_curve(np.array([out.evidence(t) for t in texts]), np.array(toxic, float))
        return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, ...]:
    """Intercept and slopes of a logistic curve by damped Newton steps, with a small ridge so that separable data end.

    Slopes below 0 are set to 0 and the others fitted again: more evidence never lowers a score.
    """
    live = list(range(x.shape[1]))
    while True:
        design = np.concatenate([np.ones((len(x), 1)), x[:, live]], axis=1)
        beta = np.zeros(design.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            slope = design.T @ (y - p) - ridge * beta
            bend = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta))
            step = np.clip(np.linalg.solve(bend, slope), -2, 2)
            beta += step
            if np.abs(step).max() < 1e-8:
                break
        if (beta[1:] >= 0).all():
            break
        live = [k for k, b in zip(live, beta[1:], strict=True) if b >= 0]
    out = np.zeros(1 + x.shape[1])
    out[0], out[[1 + k for k in live]] = beta[0], beta[1:]
    return tuple(out.tolist())


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Lexicon:
    """Learn from labelled rows of the training folds: those of the least hashes of doc_id, ``rows`` and ``most_bytes`` at most.

    A document that is labelled both ways counts as both; of the texts that
    share a doc_id the least counts.
    """
    known = labels.filter(train_fold(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).distinct().withColumn("place", F.xxhash64("doc_id"))
    sample = known.orderBy("place", "doc_id", "toxic").limit(rows)
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id")
    found = materialize(found.groupBy("place", "doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")
    held, last = 0, None
    for r in found.select("place", "doc_id", "toxic", F.octet_length("text").alias("n")).orderBy("place", "doc_id", "toxic").collect():
        held += r["n"]
        if held > most_bytes and last is not None:
            break
        last = (r["place"], r["doc_id"], r["toxic"])
    if last is None:
        return Lexicon.learn([], [])
    place, doc_id, toxic = last
    within = (F.col("place") < place) | ((F.col("place") == place) & ((F.col("doc_id") < doc_id) | ((F.col("doc_id") == doc_id) & (F.col("toxic") <= toxic))))
    chosen = found.filter(within).orderBy("place", "doc_id", "toxic").select("text", "toxic").collect()
    return Lexicon.learn([r["text"] for r in chosen], [r["toxic"] for r in chosen])


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5) to all columns of ``docs`` (text, ...).

    Null texts are scored as empty ones.  Only the text is read.  Repeated rows
    get equal scores; columns named like an added one are replaced.
    """
    docs = docs.drop("score", "predicted")
    names = docs.columns
    where = names.index("text")
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole, where):
                score = np.array([lexicon.score(t) for t in batch.column(where).to_pylist()], float)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return plainly_named(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
