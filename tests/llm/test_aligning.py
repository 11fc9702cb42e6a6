from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest

from tidewire.llm import aligning, fragments
from tidewire.llm.bpe import byte_letters

tokens = pytest.importorskip("public_tokenizers")


def plain(docs):
    """The contract's columns from the libraries' own ids, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=tokens.path("piece_bpe_32k.model"))
    with open(tokens.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        words = {i: w for w, i in json.load(file)["model"]["vocab"].items()}
    number = {x: i for i, x in enumerate(byte_letters())}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    held, out = Counter(), []
    for doc_id, text in docs:
        a, b, links, groups = [], [], [], []
        if text:
            a = [(i, bytes(number[c] for c in words[i])) for i in first.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, piece(i)) for i in second.encode(text)]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a = b = []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, data in side:
                own.append((i, at, at + len(data)))
                at += len(data)
            spans.append(own)
        j = 0
        for i, s, e in spans[0]:
            while j and spans[1][j - 1][2] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][1] < e:
                if spans[1][j][2] > s:
                    links.append((i, spans[1][j][0]))
                j += 1
        common = {e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}
        parts = [{}, {}]
        for side, own in enumerate(spans):
            k, order = 0, sorted(common)
            for i, _, e in own:
                while order[k] < e:
                    k += 1
                parts[side].setdefault(k, []).append(str(i))
        groups = [f"{','.join(parts[0][k])}|{','.join(parts[1][k])}" for k in sorted(parts[0])]
        out.append((doc_id, len(a), len(b), groups, links))
        held.update(set(links))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    return [
        (d, n_a, n_b, len(groups), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for d, n_a, n_b, groups, links in out
    ]


def found(df):
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def texts(seed):
    rng = random.Random(seed)
    stems = ["the", "river", "Größe", "naïve", "1234567", "日本語", "😀👍🏽", "\n\n", "\t", "  ", "    x", "don't", "<|endoftext|>", "<s>", "</s>", "<unk>", "á", "…", "--", "\r\n", "ﬁ½²", "\x00", "\x0b", "if(x)=y", "аб", " ", "　"]
    return [" ".join(rng.choice(stems) for _ in range(rng.choice([1, 2, 5, 40]))) for _ in range(150)]


def test_same_as_token_by_token(spark, awkward):
    docs = list(enumerate([*texts(1), *texts(1)[:20], "", " ", "  ", "a", " a", "a ", "▁", "x▁y", "\n", None, "a" * 3000, " " * 300]))
    want = sorted(plain(docs), key=repr)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(aligning.align(df)) == want
    # Few pairs are frequent: all others are joined.
    assert found(aligning.align(df, heavy=50)) == want
    assert found(aligning.align(df, heavy=0)) == want
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert found(aligning.align(awkward)) == sorted(plain(rows), key=repr)


def test_long_texts_in_ranges(spark, monkeypatch, nothing):
    monkeypatch.setattr(aligning, "RANGE_BYTES", 64)
    monkeypatch.setattr(aligning, "FAN", 2)
    rng = random.Random(5)
    own = texts(2)
    docs = [(k, " ".join(rng.choice(own) for _ in range(rng.choice([1, 5, 30])))) for k in range(40)]
    docs += [(100, "abcdefghij" * 300), (101, "日本語" * 200), (102, ("word " * 100) + "▁" + (" word" * 100)), (103, "x" * 17), (103, "x" * 17), (104, " " * 500 + "y"), (105, "é" * 40), (None, "no id here " * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(aligning.align(df)) == sorted(plain(docs), key=repr)
    assert aligning.align(nothing).count() == 0
    assert aligning.align(df.limit(0)).count() == 0


def stream(rng, total):
    cuts = sorted(rng.sample(range(1, total), rng.randint(1, total // 2)))
    ends = np.array([*cuts, total])
    return np.arange(len(ends)), ends


@pytest.mark.parametrize("seed", range(30))
def test_composition_is_associative(seed):
    """Any tree over any ranges gives the groups of the whole."""
    rng = random.Random(seed)
    total = rng.randint(4, 60)
    a, a_ends = stream(rng, total)
    b, b_ends = stream(rng, total)
    every = fragments.Tokens(a, a_ends, b, b_ends)
    names = aligning.names_of(99)
    want = fragments.whole(every).text(names)
    borders = [0, *sorted(rng.sample(range(1, total), rng.randint(1, 3))), total]
    line, done = [], []
    for low, high in zip(borders, borders[1:], strict=False):
        i, j = np.searchsorted(a_ends, [low, high], side="right")
        k, m = np.searchsorted(b_ends, [low, high], side="right")
        own, inner = fragments.split(every.cut(i, j, k, m))
        line.append(own)
        if len(inner):
            done.append((inner.tokens.a_ends[0], inner.text(names)))
    line.insert(0, fragments.START)
    while len(line) > 1:
        at = rng.randrange(len(line) - 1)
        both, met = fragments.compose(line[at], line[at + 1])
        if met is not None and len(met):
            done.append((met.a_ends[0], fragments.whole(met).text(names)))
        line[at : at + 2] = [both]
    assert ";".join(t for _, t in sorted(done)) == want and not len(line[0].prefix) and not len(line[0].suffix)


def test_cuts_of_texts():
    for text in texts(4):
        pieces = list(aligning.cut_text(text, 5))
        assert "".join(p for _, p in pieces) == text
        assert all(p[0] == " " for s, p in pieces if s)
    assert max(len(list(aligning.cut_text(text, 5))) for text in texts(4)) > 5
