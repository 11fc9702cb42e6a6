from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tidewire.llm import components, neardup


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    out = []
    for _ in range(30):
        base = make(rng.choice([8, 60, 300]))
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(copy)
    # A large group of near copies, and copies of single words.
    base = make(400)
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(400)] = rng.choice(words)
        out.append(copy)
    out += [["one"], ["one"], ["two", "words"]]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def brute(rows, k=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links, root = Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: (rows[find(i)][0], links[i]) for i in range(len(rows))}


@pytest.mark.parametrize("block", [1500, 20])
def test_classes_and_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_bands_reach_the_recall():
    bands, rows = neardup.choose_bands(0.8, 0.9985)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9985 and bands * rows <= 96
    with pytest.raises(ValueError):
        neardup.choose_bands(0.01, 0.999)


def test_minhash_agrees_with_jaccard():
    rng = np.random.default_rng(1)
    hasher = neardup.MinHash(400, 1)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2**63, 400, dtype=np.uint64)])
    one, two = hasher.bands_of([np.unique(a), np.unique(b)])
    assert abs((one == two).mean() - 600 / 1400) < 0.08


def test_awkward(spark, awkward, nothing):
    out = [(r["doc_id"], r["class_id"], r["n_links"]) for r in neardup.jaccard_classes(awkward).collect()]
    assert sorted(out, key=repr) == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (None, None, 0)], key=repr)
    kept = neardup.keep_one_of_each_class(awkward)
    assert kept.columns == awkward.columns and kept.count() == 6
    assert neardup.jaccard_classes(nothing).count() == 0 and neardup.keep_one_of_each_class(nothing).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(500, 500), (None, 3)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
