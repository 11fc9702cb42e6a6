"""Language identification by mixture inference.

Each language has the frequencies of its letter trigrams within words.  A
document is a mixture of languages: expectation-maximisation estimates its
proportions from the likelihood of each word, and the set of languages is the
one of greatest likelihood less a penalty for each language in it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_hash, plainly_named, text_batches, train_fold

#: Trigrams are counted in so many bins, a power of two.
BINS = 1 << 16
#: Rows that a language is learned from at most (in expectation; the least hashes of doc_id).
FIT_ROWS = 1000
#: Trigrams of a word overlap, so each counts for a part.
TEMPER = 0.5
ROUNDS, PRIOR = 12, 0.05
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """2 for letters, 1 for the marks that stand on them, 0 for all else."""
    return np.array([" ML".find(unicodedata.category(chr(c))[0]) for c in range(0x110000)]).clip(0).astype(np.int8)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the trigrams of letters and their marks, where each word starts in them, where each text starts in the words, and whether it has a letter."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(" ".join(low).encode("utf-32-le", "surrogatepass") + b" \0\0\0", np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low])
    kind = _letters()[codes]
    letter = kind > 0
    shown = np.where(letter, codes, 0).astype(np.uint64)
    before = np.concatenate([[np.uint64(0)], shown[:-1]])
    after = np.concatenate([shown[1:], [np.uint64(0)]])
    x = (before << np.uint64(42)) ^ (shown << np.uint64(21)) ^ after
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(letter)
    bins = (x[at] >> np.uint64(64 - 16)).astype(np.int64)
    first = np.flatnonzero(letter & (before == 0))
    words = np.searchsorted(at, first)
    texts_at = np.searchsorted(first, np.concatenate([[0], ends[:-1]]))
    seen = np.concatenate([[0], np.cumsum(kind == 2)])
    return bins, words, texts_at, np.diff(seen[ends], prepend=0) > 0


def segment_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


class Mixture:
    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, logs

    @classmethod
    def of(cls, counts: dict[str, np.ndarray]) -> Mixture:
        """From each language's counts of trigrams by bin."""
        names = sorted(counts)
        table = np.stack([counts[x] for x in names], axis=1) + 0.02 if names else np.ones((BINS, 0))
        return cls(names, np.log(table / table.sum(axis=0)).astype(np.float32))

    def proportions(self, texts: list[str]) -> np.ndarray:
        """The proportions of the chosen languages in each text; all 0 for a text without letters."""
        out = np.zeros((len(texts), len(self.names)))
        bins, words, starts, lettered = trigrams(texts)
        n = np.diff(np.append(starts, len(words)))
        full = np.flatnonzero(lettered)
        if not len(full) or not self.names:
            return out
        likelihood = segment_sums(self.logs[bins], words) * np.float32(TEMPER)
        if (n[~lettered] > 0).any():
            likelihood = likelihood[np.repeat(lettered, n)]
        n = n[full]
        starts = np.cumsum(np.append(0, n[:-1]))
        pi = np.full((len(full), len(self.names)), 1 / len(self.names))
        pi, _ = self._em(likelihood, starts, n, pi)
        out[full] = pi
        mixed = np.flatnonzero(pi.max(axis=1) < 0.999)
        if len(mixed):
            rows = np.concatenate([np.arange(a, a + k) for a, k in zip(starts[mixed], n[mixed], strict=True)])
            m = n[mixed]
            out[full[mixed]] = self._choose(likelihood[rows], np.cumsum(np.append(0, m[:-1])), m, pi[mixed])
        return out

    def _em(self, likelihood: np.ndarray, starts: np.ndarray, n: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions after ROUNDS rounds from ``pi`` (a language at 0 stays there), and each text's log-likelihood."""
        top = likelihood.max(axis=1, keepdims=True)
        odds = np.exp(likelihood - top)
        doc = np.repeat(np.arange(len(n)), n)
        live = pi > 0
        # Each text stops by itself, so that none depends on those it comes with.
        going = np.ones(len(n), bool)
        for _ in range(ROUNDS):
            share = odds * pi[doc].astype(np.float32)
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
            new = np.where(live, segment_sums(share.astype(np.float64), starts) + PRIOR * live, 0)
            new /= new.sum(axis=1, keepdims=True)
            moved = np.abs(new - pi).max(axis=1) >= 1e-3
            pi = np.where(going[:, None], new, pi)
            going &= moved
            if not going.any():
                break
        mass = np.log(np.maximum((odds * pi[doc]).sum(axis=1), 1e-30)) + top[:, 0]
        return pi, segment_sums(mass, starts)

    def _choose(self, likelihood: np.ndarray, starts: np.ndarray, n: np.ndarray, pi: np.ndarray) -> np.ndarray:
        """The proportions under the nested language set of greatest penalised likelihood."""
        rank = np.argsort(np.argsort(-pi, axis=1), axis=1)
        best, score = pi, np.full(len(n), -np.inf)
        for size in range(1, pi.shape[1] + 1):
            own = np.where(rank < size, pi, 0)
            own /= own.sum(axis=1, keepdims=True)
            own, mass = self._em(likelihood, starts, n, own)
            value = mass - size * (2 + np.log(n))
            better = value > score
            best, score = np.where(better[:, None], own, best), np.where(better, value, score)
        return best


def fit_languages(docs: DataFrame, rows: int = FIT_ROWS) -> Mixture:
    """Learn each non-null language of ``docs`` (doc_id, text, lang) from about ``rows`` of its rows in the training folds."""
    known = docs.filter(train_fold(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.withColumn("lang", F.col("lang").cast("string"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Mixture([], np.zeros((BINS, 0), np.float32))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(rows / n)).otherwise(share)
    sample = by_hash(known.select("doc_id", "lang", "text"), share, "doc_id").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole, 1):
                langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
                for lang in set(langs.tolist()):
                    found = np.bincount(trigrams([texts[i] for i in np.flatnonzero(langs == lang)])[0], minlength=BINS)
                    bins = np.flatnonzero(found)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(found[bins], pa.int64())], names=["lang", "bin", "n"])

    # Texts are counted where they are; the driver gets BINS rows a language at most.
    sums = sample.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = {lang: np.zeros(BINS) for lang in counts}
    langs, bins, n = (sums.column(i).to_numpy() for i in range(3))
    for lang, own in counts.items():
        own[bins[langs == lang]] = n[langs == lang]
    return Mixture.of(counts)


def predict_languages(docs: DataFrame, model: Mixture) -> DataFrame:
    """Add lang_pred, score (its proportion) and proportions (language to share) to all columns of ``docs`` (text, ...).

    A null text, or one without a letter (category L), is ``und`` with score 0; so are all
    texts under a model without languages.  Only the text is read.  Repeated
    rows get equal results; columns named like an added one are replaced.
    """
    docs = docs.drop("lang_pred", "score", "proportions")
    names = docs.columns
    where = names.index("text")
    langs = model.names
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("proportions", T.MapType(T.StringType(), T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole, where):
                pi = model.proportions([t or "" for t in batch.column(where).to_pylist()])
                if langs:
                    top, best = pi.argmax(axis=1), pi.max(axis=1)
                    pred = [langs[k] if s > 0 else UNKNOWN for k, s in zip(top.tolist(), best.tolist(), strict=True)]
                else:
                    best, pred = np.zeros(batch.num_rows), [UNKNOWN] * batch.num_rows
                maps = [[(langs[k], row[k]) for k in np.flatnonzero(row).tolist()] for row in pi]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(pred, pa.string()), pa.array(np.minimum(best, 1.0)), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                    names=[*names, "lang_pred", "score", "proportions"],
                )

    return plainly_named(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
