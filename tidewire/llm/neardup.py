"""N-gram Jaccard join by MinHash banding.

1. Every text becomes its set of word five-grams (64-bit hashes).  Texts of one
   set are one class from here on: a representative and a number of copies, so
   a group of copies is one partial aggregate, whatever its size.
2. Each representative has ``bands`` hashes of ``rows`` MinHash values each;
   both are chosen for a target recall at the threshold.  The shuffle is on
   band hashes; buckets of one are left out, and buckets with the same members
   as one of another band count once.
3. Representatives that share a bucket are compared on full sets.  A pair is
   compared in the first bucket that it shares, so it counts once.  A large
   bucket is compared in blocks: each of its tasks holds two blocks, counts
   the links of its members and returns a spanning forest of them, never the
   pairs, so what is written grows with the members.
4. Classes are the connected components of the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, named
from .components import connected_components

#: Members and n-grams of a block of a large bucket at most, and columns of a block's matrix that are multiplied at once.
BLOCK, GRAMS, COLUMNS = 500, 2_000_000, 4096
#: Texts of a batch are hashed together up to this many bytes.
BATCH_BYTES = 1_000_000
MASK = (1 << 64) - 1
GOLD = 0x9E3779B97F4A7C15


def choose_bands(threshold: float, recall: float, most: int = 96) -> tuple[int, int]:
    """Bands and rows: of the choices within ``most`` hashes that reach ``recall`` at ``threshold``, the one with the fewest candidates at half of it, few bands first among near equals."""
    best = None
    for rows in range(1, 9):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                noise = 1 - (1 - (threshold / 2) ** rows) ** bands
                cost = (noise + bands / 50, bands, rows)
                best = min(best or cost, cost)
                break
    if best is None:
        raise ValueError("no bands within the hashes reach this recall")
    return best[1], best[2]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class Shingler:
    """Hashes of word n-grams of many texts at once, from sums over bytes."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self, words: int):
        self.words = words
        self.bytes = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(GOLD))
        blank = np.zeros(256, bool)
        blank[[0x20, *range(0x09, 0x0E)]] = True
        self.blank = blank
        self.up = self.down = np.ones(0, np.uint64)

    def _room(self, n: int) -> None:
        if len(self.up) < n:
            self.up = _powers(self.BASE, n)
            self.down = _powers(pow(self.BASE, -1, 1 << 64), n)

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct n-gram hashes of each text; fewer words than ``words`` are one n-gram, no words none."""
        data = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        joined = np.frombuffer(b" ".join(data) + b" ", np.uint8)
        self._room(len(joined) + 1)
        blank = self.blank[joined]
        edge = np.diff(blank.astype(np.int8), prepend=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        end = end[len(end) - len(start) :]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(blank, np.uint64(0), self.bytes[joined]) * self.up[: len(joined)], dtype=np.uint64)])
        word = _mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))
        tops = np.cumsum([len(d) + 1 for d in data])
        counts = np.diff(np.searchsorted(start, tops), prepend=0)
        k = self.words
        gram = np.zeros(max(0, len(word) - k + 1), np.uint64)
        for j in range(k if len(gram) else 0):
            gram = gram * np.uint64(GOLD | 1) + word[j : len(word) - k + 1 + j]
        gram = _mix(gram)
        out, at = [], 0
        for n in counts.tolist():
            if n >= k:
                out.append(np.unique(gram[at : at + n - k + 1]))
            elif n:
                whole = np.uint64(n)
                for w in word[at : at + n]:
                    whole = np.uint64((int(whole) * GOLD + int(w)) & MASK)
                out.append(_mix(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
        return out


class MinHash:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        seeds = _mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(GOLD))
        self.factors, self.shifts = seeds[: bands * rows] | np.uint64(1), seeds[bands * rows :]

    def bands_of(self, sets: list[np.ndarray]) -> np.ndarray:
        """The band hashes of each set, none of which may be empty: one line of ``bands`` signed 64-bit integers each."""
        whole = np.concatenate(sets)
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        out = np.zeros((len(sets), self.bands), np.uint64)
        for i, (a, b) in enumerate(zip(self.factors, self.shifts, strict=True)):
            least = np.minimum.reduceat(whole * a + b, starts)
            band = i // self.rows
            out[:, band] = _mix(out[:, band] + least + np.uint64(i + 1))
        return out.view(np.int64)


def _cut(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most BATCH_BYTES of text, or one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > BATCH_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, set_key, n_grams, bands) of every text; set_key (equal for equal n-gram sets) and bands are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, hasher = Shingler(words), MinHash(bands, rows)
        for whole in batches:
            for batch in _cut(whole, 1):
                sets = shingler.of(batch.column(1).to_pylist())
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                full = [s for s in sets if len(s)]
                found = iter(hasher.bands_of(full) if full else ())
                lists = [next(found).tolist() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "set_key", "n_grams", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, set_key binary, n_grams long, bands array<long>")


def _buckets(reps: DataFrame) -> DataFrame:
    """(rep, bucket, blocks) for buckets of two or more, one of those with the same members; blocks: into how many it is cut."""
    spread = reps.select("rep", "n_grams", F.posexplode("bands").alias("band", "h")).select("rep", "n_grams", F.xxhash64("band", "h").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n_grams").alias("grams"), F.bit_xor(F.xxhash64("rep")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), "rep")).alias("s2")
    )
    blocks = F.least(F.col("members"), F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("grams") / GRAMS))).cast("int")
    shared = sizes.filter("members > 1").groupBy("members", "grams", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", blocks.alias("blocks"))
    return spread.drop("n_grams").join(shared, "bucket")


def compare_bucket(sets: list[np.ndarray], side: np.ndarray, across: bool, lists: list[list[int]], bucket: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of similar sets whose first common bucket is ``bucket``; ``across``: of different sides only."""
    n = len(sets)
    if n <= 12:
        found = []
        for i in range(n):
            for j in range(i + 1, n):
                if (across and side[i] == side[j]) or min(set(lists[i]) & set(lists[j])) != bucket:
                    continue
                a, b = len(sets[i]), len(sets[j])
                if min(a, b) < threshold * max(a, b):
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= threshold * (a + b - common):
                    found.append((i, j))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]
    # Earlier buckets that members share, as small integers, one column for each.
    open_ = np.triu(np.ones((n, n), bool), 1)
    if across:
        open_ &= side[:, None] != side[None, :]
    members: dict[int, list[int]] = {}
    for i, own in enumerate(lists):
        for b in own:
            if b < bucket:
                members.setdefault(b, []).append(i)
    for own in members.values():
        if len(own) > 1:
            open_[np.ix_(own, own)] = False
    if not open_.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.array([len(s) for s in sets], np.float64)
    value, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), lengths.astype(np.int64))
    name = np.full(len(value), -1, np.int64)
    several = held > 1
    name[several] = np.arange(several.sum())
    column = name[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    for first in range(0, int(several.sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        block = np.zeros((n, COLUMNS), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        common += block @ block.T
    close = common >= threshold * (lengths[:, None] + lengths[None, :] - common)
    return np.nonzero(close & open_)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least index that each is linked with, over any number of links."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _compare(groups: DataFrame, words: int, threshold: float) -> DataFrame:
    """(rep, other, links) of the rows (bucket, a, b, side, rep, copies, buckets, text), which are sorted by bucket, a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        reps, others, links = [], [], []

        def finish(key: tuple, parts: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(parts)
            rep, kept = np.unique(t.column("rep").to_numpy(), return_index=True)
            if len(rep) < 2:
                return
            t = t.take(pa.array(kept))
            sets: list[np.ndarray] = []
            for part in t.select(["text"]).combine_chunks().to_batches():
                for piece in _cut(part, 0):
                    sets += shingler.of(piece.column(0).to_pylist())
            i, j = compare_bucket(sets, t.column("side").to_numpy(), key[1] != key[2], t.column("buckets").to_pylist(), key[0], threshold)
            if not len(i):
                return
            copies = t.column("copies").to_numpy().astype(np.float64)
            n = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
            root = _forest(i, j, len(rep))
            at = np.flatnonzero(n > 0)
            reps.extend(rep[at].tolist())
            others.extend(rep[root[at]].tolist())
            links.extend(n[at].astype(np.int64).tolist())

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (reps, others, links)], names=["rep", "other", "links"])
            for x in (reps, others, links):
                x.clear()
            return out

        at, parts = None, []
        for batch in batches:
            bucket, a, b = (batch.column(k).to_numpy() for k in range(3))
            new = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            cuts = [0, *new.tolist(), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y == x:
                    continue
                key = (int(bucket[x]), int(a[x]), int(b[x]))
                if at is not None and key != at:
                    finish(at, parts)
                    parts = []
                at = key
                parts.append(batch.slice(x, y - x))
            if len(reps) > 5000:
                yield flushed()
        if parts:
            finish(at, parts)
        yield flushed()

    return groups.mapInArrow(run, "rep long, other long, links long")


def jaccard_classes(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.9985) -> DataFrame:
    """One row (doc_id, class_id, n_links, copies) for each row of ``docs`` (doc_id, text).

    class_id is the least doc_id that the document is linked with, over any
    number of links; n_links counts the other documents whose n-gram sets have
    a Jaccard similarity of at least ``threshold`` with its own, and copies
    those (itself included) whose sets are equal.  A pair of that similarity is
    compared with probability ``recall`` at least; every pair that is compared
    is compared on its full sets, and equal sets are always found.

    Words are runs without ASCII white space, lower-cased; a text with fewer
    than ``words`` of them is one n-gram.  Null texts and texts without words
    are linked with nothing.  doc_id names a text: rows that repeat it repeat
    the text, count as one document, and get equal results.  A null doc_id
    takes no part: its class is null.  Other columns are ignored; an empty
    table gives an empty result.
    """
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sigs = materialize(signatures(docs, words, bands, rows), "near-signatures")
    ids = sigs.filter("set_key is not null and doc_id is not null").groupBy("doc_id", "set_key").agg(F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams"))
    reps = materialize(ids.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams")), "near-sets")
    members = materialize(_buckets(reps), "near-buckets")
    own = members.groupBy("rep").agg(F.collect_list("bucket").alias("buckets")).join(reps.select("rep", "copies"), "rep")
    texts = docs.withColumnRenamed("doc_id", "rep").join(own, "rep")
    side = F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int")
    spread = (
        members.withColumn("side", side)
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("rep", "bucket", F.least("side", "x").alias("a"), F.greatest("side", "x").alias("b"), "side")
    )
    groups = spread.join(texts, "rep").select("bucket", "a", "b", "side", "rep", "copies", "buckets", "text")
    groups = groups.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    found = materialize(_compare(groups, words, threshold), "near-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("rep").alias("u"), F.col("other").alias("v")))
    named = (
        reps.select("set_key", "rep", "copies")
        .join(links, "rep", "left")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .select("set_key", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    )
    known = F.col("doc_id").isNotNull()
    return (
        sigs.select("doc_id", "set_key")
        .join(named, "set_key", "left")
        .select(
            "doc_id",
            F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"),
            F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"),
            F.when(known, F.coalesce("copies", F.lit(1))).otherwise(1).alias("copies"),
        )
    )


def keep_one_of_each_class(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the least of its class; one row of those that repeat it.

    Rows without doc_id are kept.
    """
    kept = jaccard_classes(docs, words, threshold).filter("doc_id = class_id").select("doc_id").distinct()
    once = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*(named(c) for c in docs.columns))
    return once.unionByName(docs.filter(F.col("doc_id").isNull()))
