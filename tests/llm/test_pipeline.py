from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from tidewire.llm import bpe, packing, quality, toxicity
from tidewire.llm.queries import QUERIES

from . import test_lines, test_neardup, test_quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_stages_keep_the_columns_and_only_lose_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= rows, name
        rows = docs.count()
    assert docs.select("doc_id").distinct().count() == rows


def test_whole_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, DATA).toPandas()
    whole = out.groupby("doc_id").length.sum()
    assert (whole == out.groupby("doc_id").doc_tokens.first()).all() and out.sequence_id.is_unique


def planted(rng):
    """(doc_id, text, lang, source) with junk, toxic texts, shared lines, near copies and copies; labels of some."""
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [f"{say(9)} is said at the end of many pages" for _ in range(3)]
    texts = [say(rng.randint(30, 160)) + ("\n" + rng.choice(shared) if rng.random() < 0.3 else "") for _ in range(260)]
    near = []
    for k in range(0, 60, 3):
        copy = texts[k].split(" ")
        copy[rng.randrange(len(copy))] = rng.choice(words)
        near += [" ".join(copy), texts[k + 1]]
    junk = [say(4), "", None, say(60).replace(" ", " ### $$$ "), " ".join([say(6)] * 9)]
    toxic = [say(40) + " you pathetic idiot, worthless scum and stupid moron " + say(20) for _ in range(14)]
    rows = [(t, rng.choice(["en", "de"]), rng.choice(["web", "web", "book"])) for t in texts + near + junk + toxic]
    rng.shuffle(rows)
    rows = [(i, *r) for i, r in enumerate(rows)]
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t, *_ in rows if rng.random() < 0.8]
    return rows, labels


def plain_run(rows, labels):
    """The five stages one after another, without Spark."""
    # Quality: the base rule, then distances from plain estimates.
    stats = {i: test_quality.brute(t) for i, t, *_ in rows}
    rows = [r for r in rows if stats[r[0]][0] >= 10 and 100 * stats[r[0]][4] <= 20 * stats[r[0]][0]]
    x = np.array([[np.log(n), np.log(max(c / n, 0.5)), np.arcsinh(20 * y / n), np.log1p(d), np.arcsinh(20 * r / n)] for n, c, y, d, r in (stats[r[0]] for r in rows)])
    kept = []
    cells = [np.array([True] * len(rows)), *(np.array([r[2] == v for r in rows]) for v in ("en", "de")), *(np.array([r[2:] == (v, s) for r in rows]) for v in ("en", "de") for s in ("web", "book"))]
    fits = [test_quality.mcd(x[c])[1:] if c.sum() >= quality.LEAST else None for c in cells]
    for k in range(len(rows)):
        m, c = fits[0]
        for cell, fit in zip(cells[1:], fits[1:], strict=True):
            if cell[k] and fit is not None:
                a, b = cell.sum() / (cell.sum() + quality.CENTRE_ROWS), cell.sum() / (cell.sum() + quality.SCATTER_ROWS)
                m, c = a * fit[0] + (1 - a) * m, b * fit[1] + (1 - b) * c
        if (x[k] - m) @ np.linalg.inv(c) @ (x[k] - m) <= quality.FAR:
            kept.append(rows[k])
    # Toxicity: a lexicon from the labelled rows of the training folds.
    known = {i: toxic for i, _, toxic in labels if zlib.crc32(str(i).encode()) % 5}
    train = [(t, known[i]) for i, t, *_ in kept if i in known]
    lexicon = toxicity.Lexicon.learn([t for t, _ in train], [y for _, y in train])
    kept = [r for r in kept if lexicon.score(r[1]) < 0.5]
    # Lines, near copies, pieces.
    texts = {i: t for i, _, _, t in test_lines.brute([r[:2] for r in kept], 40, 5)}
    classes = test_neardup.brute(sorted(texts.items()))
    encode, out = packing.default_encoder(), []
    for i, t in texts.items():
        if classes[i][0] == i:
            ids, at = np.append(np.asarray(encode(t), "<u4"), np.uint32(0)).astype("<u4"), 0
            for n in packing.binary_lengths(len(ids), 1024):
                out.append((i, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
                at += n
    return sorted(out)


def test_run_is_the_plain_version(spark, tmp_path):
    rows, labels = planted(random.Random(11))
    docs = spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    got = sorted(zip(out.doc_id, out.start, out.length, out.ids_crc32, out.doc_tokens, strict=True))
    want = plain_run(rows, labels)
    assert got == want
    left, texts = {r[0] for r in want}, {i: t for i, t, *_ in rows}
    assert not any("idiot" in (texts[i] or "") or "###" in (texts[i] or "") for i in left) and 200 < len(left) < 275
    assert out.sequence_id.is_unique and (out.offset == 0).all()


def test_stages_take_awkward_tables(spark, awkward, nothing, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns of clashing names, and an empty table."""
    spark.createDataFrame([(1, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mine = ["score", "n_lines", "row", "_own", "class_id", "kept", "distance", "_row"]
    named = awkward.drop("kept").selectExpr("*", *(f"'mine' AS {c}" for c in mine))
    for docs in (named, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if docs is nothing:
                assert out.count() == 0, name
            if name != "packing":
                assert out.dtypes == docs.dtypes, name
                if docs is named and name != "quality rules":
                    assert out.select(*mine).distinct().collect() == [("mine",) * len(mine)], name
                    assert out.count() == {"toxicity": 7, "line dedup": 7, "n-gram Jaccard join": 6}[name]


def test_all_queries_are_registered():
    assert sorted({int(k[2:].split("_")[0]) for k in QUERIES}) == list(range(1, 11))
    assert bpe and packing
