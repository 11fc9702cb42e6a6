"""Line dedup: sharded minimal perfect hashes over the distinct lines' hashes.

Lines become 128-bit hashes.  The distinct ones are dealt into shards; each
shard gets a minimal perfect hash (levels of bit arrays: a key sits where no
other key of its level does) that indexes compact arrays of fingerprints,
document counts and the last document.  The documents' line hashes stream past
the arrays of their shard, whose counts decide what goes; no line is joined
with another.  A shard with many hashes to look up (a line that a third of all
documents hold) is given to several tasks, each with the arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, named

BLANKS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
#: Keys of a shard (about 24 bytes each) and hashes that a task looks up, on average.
SHARD_KEYS, PROBES = 200_000, 500_000
#: Shards with more than one task (12 bytes each) that are broadcast at most.
BROADCAST_SHARDS = 100_000
#: Bits of a level for each key that is left.
GAMMA = 2


def line_key(line: str) -> str:
    return line.strip(BLANKS).translate(UPPER)


def line_hashes(text: str | None, least: int) -> list[bytes]:
    """The hash of each line's key, empty bytes for keys under ``least`` code points."""
    out = []
    for line in (text or "").split("\n"):
        key = line_key(line) if len(line) >= least else ""
        out.append(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest() if len(key) >= least else b"")
    return out


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: bits by level and the number of set bits before each word."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, level = [], [], 0
        while len(keys):
            size = -(-GAMMA * len(keys) // 64) * 64
            at = (mix(keys, level + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[at]]
            level += 1
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, below the count of keys; -1 for some of the keys that aren't in it."""
        out = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (mix(keys[left], level + 1) % np.uint64(size)).astype(np.int64) + start
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.before[word] + below)[hit]
            left, start = left[~hit], start + size
        return out


def pack_shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, last: np.ndarray) -> bytes:
    """One shard's perfect hash and arrays: fingerprints (the hash's other half), counts and last documents."""
    # Different lines of one h1, if ever there are any, follow the others' slots and are compared one by one.
    keys, first = np.unique(h1, return_index=True)
    found = PerfectHash.of(keys)
    order = np.empty(len(keys), np.int64)
    order[found.index(keys)] = first
    order = np.concatenate([order, np.setdiff1d(np.arange(len(h1)), first)])
    head = np.array([len(h1), len(h1) - len(keys), len(found.sizes), len(found.words), *found.sizes], "<i8")
    twins = h1[order[len(keys) :]].astype("<u8")
    return b"".join([head.tobytes(), found.words.tobytes(), h2[order].astype("<u8").tobytes(), last[order].astype("<i8").tobytes(), twins.tobytes(), counts[order].astype("<u4").tobytes()])


class Shard:
    def __init__(self, data: bytes):
        n, extra, levels, words = (int(x) for x in np.frombuffer(data, "<i8", 4))
        at = 32
        sizes = [int(x) for x in np.frombuffer(data, "<i8", levels, at)]
        at += 8 * levels
        self.hash = PerfectHash(sizes, np.frombuffer(data, "<u8", words, at))
        at += 8 * words
        self.prints = np.frombuffer(data, "<u8", n, at)
        self.last = np.frombuffer(data, "<i8", n, at + 8 * n)
        self.twins = np.frombuffer(data, "<u8", extra, at + 16 * n)
        self.counts = np.frombuffer(data, "<u4", n, at + 16 * n + 8 * extra)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0: not a repeated line) and last document of each hash."""
        i = self.hash.index(h1)
        for k, twin in enumerate(self.twins, len(self.prints) - len(self.twins)):
            i[(h1 == twin) & (h2 == self.prints[k])] = k
        known = i >= 0
        known[known] = self.prints[i[known]] == h2[known]
        i = np.where(known, i, 0)
        return np.where(known, self.counts[i], 0), np.where(known, self.last[i], -1)


def _hash_rows(docs: DataFrame, least: int) -> DataFrame:
    """One row (doc_id, h1, h2) for each different long line of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            taken, found = [], []
            for i, text in enumerate(texts):
                own = set(line_hashes(text.as_py(), least)) - {b""}
                taken += [i] * len(own)
                found += own
            h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            for a in range(0, len(h), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(taken[part], pa.int64())), pa.array(h[part, 0]), pa.array(h[part, 1])], names=["doc_id", "h1", "h2"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").filter((F.length("text") >= least) & F.col("doc_id").isNotNull())
    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long")


def _shards(keys: DataFrame) -> DataFrame:
    """One row (shard, data) for each shard of ``keys`` (shard, h1, h2, n, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def packed() -> pa.RecordBatch:
            h1, h2, n, last = (np.concatenate([p[i] for p in parts]) for i in range(4))
            data = pack_shard(h1.view(np.uint64), h2.view(np.uint64), n, last)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([data], pa.binary())], names=["shard", "data"])

        for batch in batches:
            shard, *columns = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if at is not None and at != shard[a]:
                        yield packed()
                        parts = []
                    at = int(shard[a])
                    parts.append([c[a:b] for c in columns])
        if parts:
            yield packed()

    keys = keys.select("shard", "h1", "h2", "n", "last").repartition("shard").sortWithinPartitions("shard")
    return keys.mapInArrow(run, "shard int, data binary")


def _probe(rows: DataFrame, shards: DataFrame, least_docs: int) -> DataFrame:
    """(doc_id, h1, h2) of the rows (shard, doc_id, h1, h2) that ``least_docs`` documents hold, outside the last of them."""
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(sizes.filter(F.col("n") > PROBES).select("shard", F.ceil(F.col("n") / PROBES).cast("int").alias("tasks")), "line-hot-shards")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_SHARDS else hot
    tasks = F.coalesce("tasks", F.lit(1))
    none = F.lit(None).cast("long")
    probes = rows.join(hot, "shard", "left").select("shard", F.pmod(F.xxhash64("doc_id"), tasks).cast("int").alias("task"), F.lit(None).cast("binary").alias("data"), "doc_id", "h1", "h2")
    arrays = shards.join(hot, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"), "data", none.alias("doc_id"), none.alias("h1"), none.alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            data = batch.column(0)
            heads = np.flatnonzero(~data.is_null().to_numpy(zero_copy_only=False))
            cuts = sorted({0, *heads.tolist(), *(heads + 1).tolist(), batch.num_rows})
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if data[a].is_valid:
                    shard = Shard(data[a].as_py())
                elif shard is not None:
                    part = batch.slice(a, b - a)
                    h1, h2 = (part.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (2, 3))
                    n, last = shard.probe(h1, h2)
                    lost = pa.array((n >= least_docs) & (part.column(1).to_numpy(zero_copy_only=False) != last))
                    yield pa.RecordBatch.from_arrays([part.column(i).filter(lost) for i in (1, 2, 3)], names=["doc_id", "h1", "h2"])

    both = arrays.unionByName(probes).repartition("shard", "task").sortWithinPartitions("shard", "task", F.col("data").isNull())
    return both.select("data", "doc_id", "h1", "h2").mapInArrow(run, "doc_id long, h1 long, h2 long")


def line_dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Add n_lines, n_dropped and kept_text to all columns of ``docs`` (doc_id, text, ...).

    A line whose key (stripped of ASCII white space, A-Z lower-cased) has at
    least ``least_chars`` code points and is held by at least ``least_docs``
    different doc_ids goes from every document but the one of largest doc_id.
    Null and empty texts are one empty line.  Rows that repeat a doc_id count
    as one document and are treated alike; a row without doc_id is neither
    counted nor changed.  Columns named like an added one are replaced; no
    other name can clash.  An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    rows = materialize(_hash_rows(docs, least_chars), "line-hashes")
    # A line's documents are counted in part before the shuffle, and the parts of a hot one meet by (line, document) first.
    counts = rows.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
    keys = materialize(counts, "line-keys")
    n_shards = max(1, -(-keys.count() // SHARD_KEYS))
    # Not the bits that the perfect hash mixes into its first level.
    shard = F.pmod(F.xxhash64("h1"), F.lit(n_shards)).cast("int").alias("shard")
    shards = materialize(_shards(keys.select(shard, "*")), "line-shards")
    drops = _probe(rows.select(shard, "doc_id", "h1", "h2"), shards, least_docs)
    lost = drops.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))
    # The caller's columns but the text travel as one struct, so that none of their names can clash with what is added.
    names = docs.columns
    rest = F.struct(F.lit(0).alias("_"), *(named(c) for c in names if c != "text"))
    carried = docs.select(rest.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Rows without doc_id find nothing; their salt spreads them over tasks.
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(10_000))).otherwise(0).alias("salt")
    joined = carried.select("*", salt).join(lost.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").select("row", "text", "drops")
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]
    schema = T.StructType([*joined.schema.fields[:2], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, lost in zip(batch.column(1), batch.column(2), strict=True):
                whole = text.as_py() or ""
                if not lost.is_valid:
                    n_lines.append(whole.count("\n") + 1)
                    n_dropped.append(0)
                    kept.append(whole)
                    continue
                gone = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in lost.as_py()}
                lines = whole.split("\n")
                left = [x for x, h in zip(lines, line_hashes(whole, least_chars), strict=True) if h not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append("\n".join(left))
            added = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *added], names=schema.names)

    done = joined.mapInArrow(run, schema)
    return done.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names), "n_lines", "n_dropped", "kept_text")
