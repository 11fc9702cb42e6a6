"""Sharding by minimax contiguous partition, with DataFrame functions alone.

The atomic groups are the equal texts.  They stand in one fixed order: first
the giants (groups above an even share of what is left, largest first), then
all others by a 60-bit prefix of the text's SHA-256.  A shard is a contiguous
run of that order.  Giants stand alone; for the rest the smallest feasible
capacity is found by binary search, each capacity being checked greedily, and
the greedy cuts at that capacity are the shards.

The driver never sees the groups.  It sees sums over hash ranges: at first
``2**FIRST_BITS`` of them.  Sums give an upper bound of the capacity (cuts at
known range ends only) and a lower bound (ranges divisible anywhere), and with
these the few ranges in which a cut can fall.  Only those are divided further,
until the ranges that can hold a cut are single groups; the result is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

KEY_BITS = 60
FIRST_BITS = 14
STEP_BITS = 6


def text_key(text: Column) -> Column:
    """60 bits of the SHA-256 of a text (null counts as empty)."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 15), 16, 10).cast("bigint")


def shard_documents(docs: DataFrame, shards: int = 40, row_overhead: int = 16) -> DataFrame:
    """Deal ``docs`` (doc_id, text) into ``shards`` shards of nearly equal bytes; equal texts stay together.

    Returns one row for each input row: doc_id, size (UTF-8 bytes of the text
    plus ``row_overhead``), text_crc32, shard and slot (gapless from 0 in its
    shard).  Null text: no bytes, crc32 of the empty text, one group with the
    empty texts.  Repeated rows each get a slot.  An empty table gives an empty
    result.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = materialize(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + F.lit(row_overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            text_key(F.col("text")).alias("_key"),
        ),
        "shard-rows",
    )
    groups = materialize(slim.groupBy("_key").agg(F.sum("size").alias("size")), "shard-groups")
    giants, cuts = plan_shards(groups, shards)
    placed = slim.withColumn("shard", shard_of(F.col("_key"), giants, cuts))
    return numbered(placed, ["shard"], ["doc_id", "_key"], "slot").drop("_key")


def shard_of(key: Column, giants: list[int], cuts: list[int]) -> Column:
    """The shard of a key: a giant's own, else the giants' number plus that of the cuts at or below the key."""
    rest = F.lit(len(giants))
    for cut in cuts:
        rest = rest + F.when(key >= F.lit(cut), 1).otherwise(0)
    for i, giant in enumerate(giants):
        rest = F.when(key == F.lit(giant), i).otherwise(rest)
    return rest.cast("int")


def plan_shards(groups: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """Keys of the giants, and the first key of each further shard, from (``_key``, ``size``)."""
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    giants: list[int] = []
    left = total
    # At most shards - 1 groups can exceed an even share, so the largest ``shards`` suffice.
    for row in groups.orderBy(F.desc("size"), "_key").limit(shards).collect():
        if row["size"] * (shards - len(giants)) <= left or len(giants) == shards - 1:
            break
        giants.append(row["_key"])
        left -= row["size"]
    rest = groups if not giants else groups.filter(~F.col("_key").isin(giants))
    return giants, contiguous_cuts(rest, shards - len(giants))


def _ranges(groups: DataFrame, bits: int) -> list[tuple]:
    """(first key, bytes, groups, largest group) of each hash range of ``2**(KEY_BITS - bits)`` keys that isn't empty."""
    rows = groups.groupBy(F.shiftright("_key", KEY_BITS - bits).alias("r")).agg(
        F.min("_key").alias("k"), F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.max("size").alias("m")
    )
    return [tuple(x) for x in rows.select("k", "s", "n", "m", "r").collect()]


def contiguous_cuts(groups: DataFrame, shards: int) -> list[int]:
    """First keys of shards 1, 2, ... of the minimax contiguous partition of the groups in key order."""
    bits = FIRST_BITS
    found = [(k, s, n, m, (r, bits)) for k, s, n, m, r in _ranges(groups, bits)]
    while found:
        found.sort()
        sums = np.array([x[1] for x in found], dtype=np.int64)
        single = np.array([x[2] == 1 for x in found])
        ends = np.concatenate([[0], np.cumsum(sums)])
        most = max(x[3] for x in found)
        high = _smallest(max(most, -(-int(ends[-1]) // shards)), int(ends[-1]), lambda c: greedy(ends, c, shards)[-1] == len(found))
        low = _smallest(most, high, lambda c: relaxed(ends, single, c, shards)[-1] >= ends[-1])
        early = ends[greedy(ends, low, shards)]
        late = relaxed(ends, single, high, shards)
        open_ = np.zeros(len(found), dtype=bool)
        for a, b in zip(early[:-1], late[:-1], strict=True):
            i = np.searchsorted(ends, a, side="right") - 1
            open_[max(0, i) : np.searchsorted(ends, b, side="left")] = True
        open_ &= ~single
        if not open_.any() or bits >= KEY_BITS:
            marks = greedy(ends, high, shards)
            return [found[i][0] for i in marks[:-1] if i < len(found)]
        bits = min(KEY_BITS, bits + STEP_BITS)
        wanted = [x[4] for x, o in zip(found, open_, strict=True) if o]
        # The open ranges are few (about shards**2), whatever the input holds.
        spark = groups.sparkSession
        parts = spark.createDataFrame([(r << (KEY_BITS - b), ((r + 1) << (KEY_BITS - b)) - 1, b) for r, b in wanted], "a long, z long, b int")
        finer = []
        for b in {b for _, b in wanted}:
            own = parts.filter(F.col("b") == b).select(F.shiftright("a", KEY_BITS - b).alias("_r"))
            inside = groups.withColumn("_r", F.shiftright("_key", KEY_BITS - b)).join(F.broadcast(own), "_r", "left_semi")
            finer += [(k, s, n, m, (r, bits)) for k, s, n, m, r in _ranges(inside, bits)]
        found = [x for x, o in zip(found, open_, strict=True) if not o] + finer
    return []


def _smallest(low: int, high: int, works) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if works(mid) else (mid + 1, high)
    return low


def greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Index after each shard's last range when shards are filled in turn; a range above the capacity stops it."""
    out, at = [], 0
    for _ in range(shards):
        at = max(at, int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1)
        out.append(at)
    return out


def relaxed(ends: np.ndarray, single: np.ndarray, capacity: int, shards: int) -> list[int]:
    """The furthest each shard could reach if all ranges but single groups were divisible anywhere."""
    out, at = [], 0
    for _ in range(shards):
        at = min(at + capacity, int(ends[-1]))
        i = int(np.searchsorted(ends, at, side="right")) - 1
        if i < len(single) and single[i]:
            at = max(int(ends[i]), out[-1] if out else 0)
        out.append(at)
    return out
