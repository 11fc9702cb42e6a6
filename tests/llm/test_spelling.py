from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm import spelling
from tidewire.llm.kdtree import KdTree


def edits(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(words: dict[str, int], ratio: int = 5) -> dict[str, tuple]:
    """All fields of each word, by what is left of words once one letter is gone."""
    rest = defaultdict(set)
    for w in words:
        rest[w].add(w)
        for k in range(len(w)):
            rest[w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for group in rest.values():
        for a in group:
            near[a] |= {b for b in group if edits(a, b)}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]])
    return out


def found(df) -> dict[str, tuple]:
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("seed", "part", "many"), [(1, 20_000, 4096), (2, 30, 4096), (3, 7, 0), (4, 100, 1)])
def test_same_as_brute_force(spark, monkeypatch, seed, part, many):
    # Small parts: a length has many, and words are sent to several of them.
    monkeypatch.setattr(spelling, "PART_WORDS", part)
    monkeypatch.setattr(spelling, "MANY", many)
    monkeypatch.setattr(spelling, "CHUNK", 50)
    rng = random.Random(seed)
    letters = "aabcdéÿÀz"
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 6, 6, 7, 8, 30]))): rng.choice([1, 1, 5, 30, 200, 5000]) for _ in range(700)}
    for w in list(words)[:300]:
        k = rng.randrange(len(w))
        words.setdefault(w[:k] + rng.choice(letters) + w[k + rng.randint(0, 1) :], rng.randint(1, 50))
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.spelling_variants(df)) == plain(words)


@pytest.mark.parametrize(("many", "chunk"), [(0, 50), (1, 7), (4096, 1)])
def test_one_part(monkeypatch, many, chunk):
    """Both ways to compare words of equal letters, in chunks of any size."""
    monkeypatch.setattr(spelling, "MANY", many)
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    rng = random.Random(many)
    words = {"".join(rng.choice("abcÀ") for _ in range(rng.choice([5, 6]))): rng.randint(1, 99) for _ in range(500)}
    six = {w: n for w, n in words.items() if len(w) == 6}
    rows = [(6, 0, 0 if len(w) == 6 else 2, w, n) for w, n in words.items()]
    out = spelling.search_part(pa.table(dict(zip(spelling.ROUTED.names, map(list, zip(*rows, strict=True)), strict=True)), schema=spelling.ROUTED)).to_pylist()
    got = {r["word"]: (r["n_near"], r["near"]) for r in out}
    for w in words:
        near = [x for x in words if edits(w, x) and (x in six or w in six)]
        assert got.get(w, (0, None)) == (len(near), min(near, key=lambda x: (-words[x], x), default=None))


def test_anagrams_of_one_word(spark, monkeypatch):
    # One great group of equal letter counts next to another.
    monkeypatch.setattr(spelling, "PART_WORDS", 50)
    rng = random.Random(7)
    words = {}
    for base in ("abcdefgh", "abcdefgx", "abcdefghh"):
        for _ in range(300):
            own = list(base)
            rng.shuffle(own)
            words["".join(own)] = rng.randint(1, 99)
            words["".join(own).replace("h", "x")] = rng.randint(1, 999)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.spelling_variants(df)) == plain(words)


def test_tree_loses_no_near_vector():
    rng = np.random.default_rng(5)
    vectors = rng.integers(0, 4, (500, 6)).astype(np.uint8)
    tree = KdTree(vectors, 5)
    assert sorted(np.concatenate(tree.leaves)) == list(range(500))
    home = {}
    for leaf, rows in tree.search(vectors, 0, 0):
        home |= dict.fromkeys(rows.tolist(), leaf)
    assert all(k in tree.leaves[leaf] for k, leaf in home.items())
    for up, down in ((1, 1), (1, 0), (2, 1)):
        met = {(k, leaf) for leaf, rows in tree.search(vectors, up, down) for k in rows.tolist()}
        assert len(met) < 0.9 * 500 * len(tree.leaves)
        apart = vectors[None].astype(int) - vectors[:, None]
        near = (np.maximum(apart, 0).sum(2) <= up) & (np.maximum(-apart, 0).sum(2) <= down)
        assert all((a, home[b]) in met for a, b in zip(*map(list, np.nonzero(near)), strict=True))


def test_counts(spark, awkward, nothing):
    rng = random.Random(3)
    stems = ["Größe", "MAISON", "étéÉté", "overture", "casa"]
    docs = [(i, " ".join(rng.choice(stems) + rng.choice(["", "s", "x1"]) for _ in range(200))) for i in range(60)] + [(None, "overture " * 9), (1000, None)]
    want = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "")):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    counts = spelling.word_counts(df, slips=3)
    assert {r["word"]: r["n"] for r in counts.collect()} == want
    assert found(spelling.spelling_variants(counts)) == plain(want)
    assert spelling.spelling_variants(spelling.word_counts(nothing)).count() == 0
    assert spelling.spelling_variants(spelling.word_counts(awkward)).count() == 0


def test_awkward_words(spark):
    long = "x" * 50_000
    rows = [("", 100), ("a", 5), ("a", 6), (None, 3), ("b", None), (long, 3), (long + "y", 90), ("日本", 1), ("日木", 5)]
    out = found(spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long")))
    assert out == plain({"": 100, "a": 11, "b": 0, long: 3, long + "y": 90, "日本": 1, "日木": 5})
