from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from tidewire.llm import lines
from tidewire.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 30_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        found = lines.PerfectHash.of(keys)
        assert sorted(found.index(keys)) == list(range(len(keys)))


def test_shard_knows_its_keys_and_no_others():
    rng = np.random.default_rng(2)
    h1, h2 = rng.integers(0, 2**63, (2, 5000), dtype=np.uint64)
    h1[7] = h1[3]  # two lines of one hash half
    shard = lines.Shard(lines.pack_shard(h1, h2, np.arange(5000) + 5, np.arange(5000) * 3))
    n, last = shard.probe(h1, h2)
    assert (n == np.arange(5000) + 5).all() and (last == np.arange(5000) * 3).all()
    assert not shard.probe(h1, h2 + np.uint64(1))[0].any() and not shard.probe(h2, h1)[0].any()


def brute(rows, least_chars, least_docs):
    held = defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if i is not None and len(lines.line_key(x)) >= least_chars:
                held[lines.line_key(x)].add(i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if i is None or len(held.get(lines.line_key(x), ())) < least_docs or max(held[lines.line_key(x)]) == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, awkward, nothing):
    rng = random.Random(3)
    common = [f"{'Shared line number'} {k} that is quite long ééé" for k in range(6)] + ["short", "x" * 39, "y" * 40]
    rows = []
    for i in range(200):
        parts = [rng.choice(common) if rng.random() < 0.5 else f"own line {i} {rng.random()} with many characters" for _ in range(rng.randint(0, 8))]
        rows.append((rng.randint(0, 120), "\n".join(p.upper() + " \t" if rng.random() < 0.3 and p.isascii() else p for p in parts)))
    seen = {}
    rows = [(i, seen.setdefault(i, t)) for i, t in rows] + [(None, common[0]), (500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.line_dedup(df, 40, 5).collect()), key=repr)
    assert got == brute(rows, 40, 5) and any(r[2] for r in got)
    assert lines.line_dedup(awkward).count() == 7 and lines.line_dedup(nothing).count() == 0
    assert "kept" in lines.line_dedup(awkward).columns


def test_columns_of_any_name_come_back(spark, awkward):
    named = awkward.selectExpr("*", "'mine' AS _line_doc", "'mine' AS _line_drops", "'mine' AS row", "'mine' AS drops", "'mine' AS shard", "1 AS n_lines", "'mine' AS `a.b`", "array('mine') AS h1")
    out = lines.line_dedup(named)
    assert out.columns == [*awkward.columns, "_line_doc", "_line_drops", "row", "drops", "shard", "a.b", "h1", "n_lines", "n_dropped", "kept_text"]
    assert out.select("_line_doc", "_line_drops", "row", "drops", "shard", "`a.b`", "h1").distinct().collect() == [("mine",) * 6 + (["mine"],)]


def test_hot_shards_have_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(lines, "PROBES", 50)
    monkeypatch.setattr(lines, "SHARD_KEYS", 40)
    line = "a line that every one of the documents holds"
    rows = [(i, "\n".join([line, f"{i} is the only document that holds this line"] + [f"{i % 30} is held by several of the documents here"] * (i % 3))) for i in range(400)]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows, 40, 5)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_query_is_the_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op6_line_dedup"](spark, DATA).collect())
    assert got == sorted(con.execute(SQL["op6_line_dedup"]).fetchall())
