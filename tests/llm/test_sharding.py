from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tidewire.llm import sharding


def best_capacity(sizes, shards):
    """Smallest capacity of a contiguous partition, by dynamic programming over all cuts."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    inf = float("inf")
    best = [0] + [inf] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(1, len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_minimax(spark, seed):
    rng = random.Random(seed)
    groups = {rng.getrandbits(60): rng.choice([1, 5, 20, 21, 100, 900]) for _ in range(rng.choice([1, 2, 3, 60, 300]))}
    # Some keys share their leading bits, so that ranges must be divided several times.
    groups |= {(7 << 56) + rng.getrandbits(rng.choice([4, 30])): rng.randint(1, 50) for _ in range(40)}
    shards = rng.choice([1, 2, 5, 8])
    cuts = sharding.contiguous_cuts(spark.createDataFrame(list(groups.items()), "_key long, size long"), shards)
    keys = sorted(groups)
    loads = [0] * shards
    for k in keys:
        loads[sum(k >= c for c in cuts)] += groups[k]
    assert len(cuts) <= shards - 1 and max(loads) == best_capacity([groups[k] for k in keys], shards)


def test_rows(spark):
    rng = random.Random(1)
    texts = ["same text"] * 200 + [f"text {i} " * rng.randint(1, 9) for i in range(400)] + ["huge " * 4000]
    rows = [(i, t) for i, t in enumerate(texts)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    assert len(out) == len(rows)
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    by = dict(rows)
    assert all(r.size_ == len(by[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(by[r.doc_id].encode()) for r in out.rename(columns={"size": "size_"}).itertuples())
    assert out[out.doc_id < 200].shard.nunique() == 1
    # The two groups above an even share stand alone; the rest is near equal.
    loads = out.groupby("shard")["size"].sum().sort_values()
    rest = loads.iloc[:-2]
    assert rest.max() - rest.min() < 4 * 100


def test_awkward(awkward, nothing):
    assert sharding.shard_documents(awkward, 40).count() == 7
    assert sharding.shard_documents(nothing, 40).count() == 0


def test_key_is_the_sha256_prefix(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("x",)], "t string").select(sharding.text_key(F.col("t"))).first()
    assert row[0] == int(hashlib.sha256(b"x").hexdigest()[:15], 16)
