"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word starts as its single symbols.  The leaves of the tree hold the merge
rank of each symbol with the next living one, and each inner node the least
(rank, position) below it, so the root is the leftmost pair of lowest rank.
A merge joins that pair and updates three leaves, each in logarithmic time; the
word is done when the root holds no rank.  A word of ``n`` symbols thus costs
``n log n``, however long it is.

The vocabulary file says how texts become words: it is read, never copied.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pair ranks and ids fit below; a leaf is ``rank << SHIFT | position``.
SHIFT = 40
NONE = 1 << 62
#: Words whose ids a worker remembers, and the longest word that it remembers.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64
#: Characters on whose class all Unicode versions agree; other texts are cut into words by the tokenizers library.
SETTLED = regex.compile(r"[^\u0000-\u052f\u1e00-\u1eff\u2000-\u2064\u20a0-\u20bd\u2190-\u23ff\u2500-\u27bf\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")
BATCH_TOKENS = 2_000_000


class PairTree:
    """Segment tree over the ranks of adjacent pairs; the root is the leftmost pair of lowest rank."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, (len(ranks) - 1).bit_length())
        leaves = [r << SHIFT | i if r >= 0 else NONE for i, r in enumerate(ranks)]
        self.least = [NONE] * self.size + leaves + [NONE] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            a, b = self.least[2 * i], self.least[2 * i + 1]
            self.least[i] = a if a < b else b

    def root(self) -> int:
        """Position of the pair to merge, -1 if there is none."""
        top = self.least[1]
        return -1 if top == NONE else top & ((1 << SHIFT) - 1)

    def set(self, position: int, rank: int) -> None:
        i = self.size + position
        self.least[i] = rank << SHIFT | position if rank >= 0 else NONE
        i >>= 1
        while i:
            a, b = self.least[2 * i], self.least[2 * i + 1]
            low = a if a < b else b
            if self.least[i] == low:
                break
            self.least[i] = low
            i >>= 1


def merge_word(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Ids of a word of single-symbol ids; ``pairs``: ``left << 32 | right`` to (rank, merged id)."""
    n = len(symbols)
    if n < 2:
        return symbols
    ids = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    absent = (-1, -1)
    tree = PairTree([pairs.get(ids[i] << 32 | ids[i + 1], absent)[0] for i in range(n - 1)])
    while (i := tree.root()) >= 0:
        j = after[i]
        ids[i] = pairs[ids[i] << 32 | ids[j]][1]
        ids[j] = -1
        after[i] = k = after[j]
        if j < n - 1:
            tree.set(j, -1)
        if k < n:
            before[k] = i
            tree.set(i, pairs.get(ids[i] << 32 | ids[k], absent)[0])
        else:
            tree.set(i, -1)
        if (h := before[i]) >= 0:
            tree.set(h, pairs.get(ids[h] << 32 | ids[i], absent)[0])
    return [x for x in ids if x >= 0]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class WordBpe:
    """Encoder and decoder for a vocabulary file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(self.ids[a] << 32 | self.ids[b], (rank, self.ids[a + b]))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.marks = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        kinds = [x["type"] for x in steps]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normalizers {kinds}")
        # The same character classes as the vocabulary's own pattern; it is applied to normalized text.
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = byte_letters()
        self.letters = letters
        self.inner = [self.ids.get(x, -1) for x in letters]
        self.final = [self.ids.get(x + self.suffix, -1) for x in letters]
        self.texts = {i: w for w, i in self.ids.items()} | {i: w for w, i in self.special.items()}
        self.number = {x: b for b, x in enumerate(letters)}
        self.path = path
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def split(self, text: str) -> list[bytes]:
        """Words of a text with characters outside SETTLED, as UTF-8."""
        whole = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.number[x] for x in word) for word, _ in whole]

    def word(self, data: bytes) -> list[int]:
        symbols = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        return merge_word([x for x in symbols if x >= 0], self.pairs)

    def normalized(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Lower-casing is letter by letter: no final sigma by context.
            return "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return text.lower()

    def encode(self, text: str) -> list[int]:
        """Ids of a text, special tokens' strings included as their ids."""
        out: list[int] = []
        at = 0
        if "<" in text:
            for m in self.marks.finditer(text):
                self._add(text[at : m.start()], out)
                out.append(self.special[m[0]])
                at = m.end()
        self._add(text[at:] if at else text, out)
        return out

    def _add(self, text: str, out: list[int]) -> None:
        if SETTLED.search(text):
            for data in self.split(text):
                out += self.word(data)
            return
        known, older = self.known, self.older
        for word in self.words.findall(self.normalized(text)):
            ids = known.get(word)
            if ids is None:
                ids = older.get(word)
                if ids is None:
                    ids = tuple(self.word(word.encode()))
                if len(word) <= REMEMBERED_CHARS:
                    known[word] = ids
                    if len(known) >= REMEMBERED:
                        self.older, self.known = older, known = known, {}
            out += ids

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by spaces, as a file without decoder is decoded; unknown ids are left out."""
        return " ".join([self.texts[i] for i in ids if i in self.texts])


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers as tokens

    return tokens.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded text of ``docs`` (doc_id, text).

    Null texts are empty ones: no ids, empty decoded text.  Repeated rows give
    equal results; other columns are ignored; an empty table gives none.
    ``path`` is the vocabulary file on the workers.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path or default_path())
        for batch in batches:
            first, held, ids, texts = 0, 0, [], []
            for i, text in enumerate(batch.column(1)):
                own = bpe.encode(text.as_py() or "")
                ids.append(np.array(own, dtype="<u4").tobytes())
                texts.append(bpe.decode(own))
                held += len(own)
                if held > BATCH_TOKENS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ids)), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
                    first, held, ids, texts = i + 1, 0, [], []

    return docs.select("doc_id", "text").mapInArrow(run, schema)
