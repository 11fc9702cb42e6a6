from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tidewire.llm import bpe, packing

tokens = pytest.importorskip("public_tokenizers")
POOL = "abcdeXYZ0123 \t\n\x0b\r\x85 éÉßöñΣσςİıǅ日本語한국어👍🏽́‍'sS't're.,!?<>|/  　ªº²½ⅷ\x00\x1c\U0001cd34"


def texts():
    rng = random.Random(1)
    out = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(10)) for _ in range(500)]
    return [*out, "", "\n", "ab" * 4000, "don't I'M we'LL", " <|endoftext|> a<|startoftext|>", "ΑΣ ΣΑΣ"]


def test_words_as_the_library_does():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokens.path("word_bpe_49k.json")), bpe.WordBpe(tokens.path("word_bpe_49k.json"))
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(t)


def test_bytes_as_the_library_does():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokens.path("byte_bpe_50k.json")), packing.default_encoder()
    for t in texts():
        assert list(own(t)) == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_bytes_of_long_white_space():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokens.path("byte_bpe_50k.json")), packing.default_encoder()
    n = packing.LONG_BLANK
    runs = ["\n" * n + "a", " " * (n + 1), "\t" * (n + 1), " \t\u2003\x85" * n, "\xa0" * (n + 2), "\x1c" * (n + 5), "word", " a", "<|endoftext|>", "'s", "\r\n" * n, "\u3000" * n]
    rng = random.Random(8)
    for t in [*(("".join(rng.choice(runs) for _ in range(rng.randint(1, 7)))) for _ in range(400)), " " * 500_000, ("\n" * 40_000 + "a") * 10, ("\n" * n + "a") * 1000]:
        assert list(own(t)) == library.encode(t, add_special_tokens=False).ids, repr(t)[:200]
    for blank in " \n":
        assert len(set(own(blank * 10_000_000).tolist())) <= 2


def test_tree_is_the_plain_merge():
    rng = random.Random(4)
    pairs = {a << 32 | b: (r, 10 + r) for r, (a, b) in enumerate((rng.randrange(14), rng.randrange(14)) for _ in range(40))}

    def plain(ids):
        ids = list(ids)
        while True:
            ranked = [(pairs[x][0], i) for i in range(len(ids) - 1) if (x := ids[i] << 32 | ids[i + 1]) in pairs]
            if not ranked:
                return ids
            _, i = min(ranked)
            ids[i : i + 2] = [pairs[ids[i] << 32 | ids[i + 1]][1]]

    for _ in range(300):
        ids = [rng.randrange(10) for _ in range(rng.randint(0, 60))]
        assert bpe.merge_word(ids, pairs) == plain(ids)


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000])
def test_binary_lengths(n):
    parts = packing.binary_lengths(n, 1024)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1024 for p in parts) and parts == sorted(parts, reverse=True)


def test_pieces_give_the_document_back(spark, awkward, nothing):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.choice([0, 1, 50, 900])))) for i in range(40)], "doc_id long, text string")
    by = {r["doc_id"]: r["text"] for r in docs.collect()}
    encode = packing.default_encoder()
    out = packing.decompose(docs).toPandas().sort_values(["doc_id", "start"])
    for i, own in out.groupby("doc_id"):
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in own.ids])
        assert ids.tolist() == [*encode(by[i]), 0] and own.start.tolist() == [0, *own.length.cumsum()[:-1]]
    packed = packing.pack_documents(awkward).toPandas()
    assert packed.sequence_id.is_unique and (packed.offset == 0).all() and (packed[packed.doc_id == 1].length == [1]).all()
    for bucket, own in packed.groupby("bucket"):
        assert (own.length == 1 << bucket).all() and sorted(own.sequence_id // 64) == list(range(len(own)))
    assert packing.pack_documents(nothing).count() == 0


def test_encode_decode_rows(awkward, nothing):
    out = {r["doc_id"]: r for r in bpe.encode_decode(awkward).collect()}
    assert bytes(out[1]["ids"]) == b"" and out[1]["decoded"] == "" and len(out[4]["ids"]) == 4 * 100_000
    assert hashlib.sha256(bytes(out[5]["ids"])).hexdigest() and bpe.encode_decode(nothing).count() == 0
