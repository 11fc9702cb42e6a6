"""Signals over whole stories: event clusters, who leads them, novelty, and scorecards of sources."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.time import epoch_us, event_time
from tidewire.plans.mix import ratio
from tidewire.session import materialize
from tidewire.sources.records import timed

# Words left out of titles, and the weights of a similarity's parts.
TITLE_STOPWORDS = frozenset(("the", "a", "an", "of", "in", "on", "to", "for", "is", "are", "was", "were", "and", "or", "but"))
NOVELTY_STOPWORDS = ("the", "a", "an", "of", "in", "on", "to", "for", "is", "are", "was", "were", "and", "or", "but", "with", "from", "this", "that", "by", "as")
CLUSTER_WEIGHTS = (0.35, 0.20, 0.15, 0.10, 0.20)
NOVELTY_WEIGHTS = (0.55, 0.20, 0.15, 0.10)
WORD = re.compile(r"[A-Za-z0-9']+")
TOP_TOKENS = 5
#: The island of all rows, where some have no time.
TIMELESS = -1


def islands(records: DataFrame, window_s: int = 1800) -> DataFrame:
    """Add ``island``: no cluster can span a gap above the window, so runs without one can be clustered apart.

    Gaps are found from the least and greatest time of each window-long slot:
    the only global order is over slots, of which there are span / window.
    Rows without any time go with every island's rule-free members, so one of
    them makes the whole table a single island.
    """
    rows = records.withColumn("us", epoch_us(event_time(F.col("published_ts"), F.col("created_at"))))
    size = window_s * 1_000_000
    rows = rows.withColumn("slot", F.floor(F.col("us") / size))
    slots = rows.filter("us is not null").groupBy("slot").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    order = Window.orderBy("slot")
    gap = F.coalesce(F.col("first") - F.lag("last").over(order) > size, F.lit(True))
    named = slots.withColumn("start", F.when(gap, F.col("slot"))).select("slot", F.last("start", True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    timeless = rows.agg(F.count_if(F.col("us").isNull()).alias("timeless"))
    placed = rows.join(named, "slot", "left").crossJoin(F.broadcast(timeless))
    return placed.withColumn("island", F.when(F.col("timeless") > 0, F.lit(TIMELESS)).otherwise(F.col("island"))).drop("slot", "timeless")


def _features(row: dict) -> tuple[frozenset, ...]:
    lists = ("candidate_symbols", "impact_reason_codes", "asset_classes", "candidate_entities")
    symbols, reasons, assets, entities = (frozenset(str(x).strip() for x in row.get(c) or () if x is not None and str(x).strip()) for c in lists)
    title = frozenset(w for w in map(str.lower, WORD.findall(row.get("title") or "")) if w not in TITLE_STOPWORDS)
    return frozenset(map(str.upper, symbols)), reasons, assets, entities, title


def story_similarity(a: tuple[frozenset, ...], b: tuple[frozenset, ...]) -> float:
    total = 0.0
    for weight, x, y in zip(CLUSTER_WEIGHTS, a, b, strict=True):
        common = len(x & y)
        if common:
            total += weight * common / (len(x) + len(y) - common)
    return total


class FieldSets:
    """The distinct sets of one feature field, and how similar a set is to each of them."""

    def __init__(self):
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.sizes = np.zeros(64)
        # For each value the sets that hold it: an array with room to grow, and how much of it is in use.
        self.holders: dict[str, tuple[np.ndarray, int]] = {}

    def number(self, values: frozenset) -> int:
        n = self.numbers.get(values)
        if n is None:
            n = self.numbers[values] = len(self.numbers)
            self.sets.append(values)
            if n == len(self.sizes):
                self.sizes = np.concatenate([self.sizes, np.zeros(n)])
            self.sizes[n] = len(values)
            for v in values:
                room, used = self.holders.get(v) or (np.zeros(4, np.int64), 0)
                if used == len(room):
                    room = np.concatenate([room, np.zeros_like(room)])
                room[used] = n
                self.holders[v] = room, used + 1
        return n

    def common(self, values: frozenset) -> np.ndarray:
        """How many of ``values`` each set holds."""
        common = np.zeros(len(self.numbers))
        for v in values:
            if v in self.holders:
                room, used = self.holders[v]
                common[room[:used]] += 1
        return common

    def jaccard(self, values: frozenset) -> np.ndarray:
        common = self.common(values)
        return common / np.maximum(len(values) + self.sizes[: len(common)] - common, 1)


class Members:
    """Distinct members of the stories as lines (story, profile, title), in order of profile but for the newest ones.

    A profile is a combination of sets in all fields but the title.
    """

    def __init__(self):
        self.table, self.used = np.zeros((1024, 3), np.int64), 0
        self.known: set[tuple[int, int, int]] = set()
        self.ends = np.zeros(1, np.int64)

    def add(self, line: tuple[int, int, int]) -> None:
        if line in self.known:
            return
        self.known.add(line)
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = line
        self.used += 1

    def crowded(self) -> bool:
        """Whether the lines out of order are more than a tenth."""
        return self.used - self.ends[-1] > 256 + self.used // 10

    def sort(self, profiles: int, live: np.ndarray | None) -> None:
        """Bring all lines in order; with ``live`` (by story) those of other stories go."""
        own = self.table[: self.used]
        if live is not None:
            own = own[live[own[:, 0]]]
            self.known = {tuple(x) for x in own.tolist()}
        own = own[np.argsort(own[:, 1], kind="stable")]
        self.used = len(own)
        self.table[: self.used] = own
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(own[:, 1], minlength=profiles))])

    def of(self, chosen: np.ndarray) -> np.ndarray:
        """The lines whose profile is ``chosen`` (a flag for each)."""
        ordered = np.flatnonzero(chosen[: len(self.ends) - 1])
        first, n = self.ends[ordered], self.ends[ordered + 1] - self.ends[ordered]
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        rest = self.table[self.ends[-1] : self.used]
        return np.concatenate([self.table[at], rest[chosen[rest[:, 1]]]])


class StoryIndex:
    """Members of stories by their features, and which of them are the most similar to given ones.

    A member's similarity is that of its profile and, for a fifth at most, that
    of its title.  So the most similar profiles are tried first, and what they
    reach tells which others can reach as much; only the members of these are
    compared.
    """

    def __init__(self):
        *self.fields, self.titles = [FieldSets() for _ in CLUSTER_WEIGHTS]
        self.profiles: dict[tuple, int] = {}
        self.parts = np.zeros((len(self.fields), 1024), np.int64)
        self.members = Members()
        # How similar each set of a field is to all others, for sets met before; made anew where there are more by now.
        self.similar: list[dict[int, np.ndarray]] = [{} for _ in self.fields]
        #: Stories of the members with these sets in all fields.
        self.equal: dict[tuple, set[int]] = {}
        #: The same by some fields alone (their places), for the members that have these.
        self.alike: dict[tuple[int, ...], dict[tuple, set[int]]] = {}

    def numbers(self, features: tuple[frozenset, ...]) -> tuple[int, ...]:
        return tuple(field.number(values) for field, values in zip((*self.fields, self.titles), features, strict=True))

    def features(self, numbers: tuple[int, ...]) -> tuple[frozenset, ...]:
        return tuple(field.sets[n] for field, n in zip((*self.fields, self.titles), numbers, strict=True))

    def twins(self, features: tuple[frozenset, ...]) -> set[int]:
        """Stories of the members with the same sets in all fields that ``features`` has: none can be nearer. What is added later comes in."""
        filled = tuple(k for k, values in enumerate(features) if values)
        if filled not in self.alike:
            table = self.alike[filled] = {}
            for full, own in self.equal.items():
                sets = self.features(full)
                if all(sets[k] for k in filled):
                    table.setdefault(tuple(full[k] for k in filled), set()).update(own)
        numbers = self.numbers(features)
        return self.alike[filled].setdefault(tuple(numbers[k] for k in filled), set())

    def add(self, features: tuple[frozenset, ...], story: int) -> None:
        numbers = tuple(field.number(values) for field, values in zip(self.fields, features, strict=False))
        profile = self.profiles.setdefault(numbers, len(self.profiles))
        if profile == self.parts.shape[1]:
            self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)], axis=1)
        self.parts[:, profile] = numbers
        title = self.titles.number(features[-1])
        self.members.add((story, profile, title))
        self.equal.setdefault((*numbers, title), set()).add(story)
        for filled, table in self.alike.items():
            if all(features[k] for k in filled):
                table.setdefault(tuple((*numbers, title)[k] for k in filled), set()).add(story)

    def sort(self, live: np.ndarray | None = None) -> None:
        self.members.sort(len(self.profiles), live)

    def nearest(self, features: tuple[frozenset, ...], threshold: float, live=None, more: float = 0.0) -> list[tuple[float, list[int]]]:
        """The greatest similarities of members, greatest first, and the stories of those that have them; none below ``threshold``.

        All that come before the last one are there, and all down to ``more``
        below the best of the most similar profile.  ``live`` says of an array
        of stories which ones count.
        """
        every = (*self.fields, self.titles)
        known = [field.numbers.get(values) for field, values in zip(every, features, strict=True)]
        if None not in known and all(values or len(field.numbers) == 1 for field, values in zip(every, features, strict=True)):
            # No member can be nearer than an equal one, and none but equal ones are as near.
            found = np.array(sorted(self.equal.get(tuple(known), ())), np.int64)
            found = found[live(found)] if live is not None and len(found) else found
            if len(found):
                score = 0.0
                for weight, values in zip(CLUSTER_WEIGHTS, features, strict=True):
                    score += weight * bool(values)
                if score >= threshold and not more:
                    return [(score, found.tolist())]
        if not self.members.used:
            return []
        *weights, title_weight = CLUSTER_WEIGHTS
        own = np.zeros(len(self.profiles))
        for k, (weight, field, values) in enumerate(zip(weights, self.fields, features, strict=False)):
            if values:
                n = known[k]
                part = self.similar[k].get(n)
                if part is None or len(part) < len(field.numbers):
                    part = weight * field.jaccard(values)
                    if n is not None:
                        self.similar[k][n] = part
                own += part[self.parts[k, : len(self.profiles)]]
        common, size = self.titles.common(features[-1]), len(features[-1])

        def compared(least: float) -> tuple[np.ndarray, np.ndarray]:
            """Lines of live stories whose profile reaches ``least``, and their similarity."""
            lines = self.members.of(own >= least - 1e-9)
            if live is not None:
                lines = lines[live(lines[:, 0])]
            shared = common[lines[:, 2]]
            return lines, own[lines[:, 1]] + title_weight * (shared / np.maximum(size + self.titles.sizes[lines[:, 2]] - shared, 1))

        top = own.max()
        if top < threshold - title_weight - 1e-9:
            return []
        _, first = compared(top)
        least = max(first.max(initial=-1.0) - more, threshold)
        lines, score = compared(least - title_weight)
        found = score >= least
        lines, score = lines[found, 0], score[found]
        order = np.lexsort((lines, -score))
        lines, score = lines[order], score[order]
        cuts = np.flatnonzero(np.diff(score)) + 1
        return [(float(b[0]), np.unique(a).tolist()) for a, b in zip(np.split(lines, cuts), np.split(score, cuts), strict=True) if len(a)]


#: What is known of a row's earlier members: (similarity, keys of the features that reach it), greatest first.
Hints = list[tuple[float, list[bytes]]]


def merged_hints(parts: list[Hints]) -> Hints:
    """Hints of several parts of the earlier members as one: down to the greatest last level, below which a part may hide one."""
    floor = max((part[-1][0] for part in parts if part), default=0.0)
    levels: dict[float, list[bytes]] = {}
    for part in parts:
        for level, keys in part:
            if level >= floor:
                levels.setdefault(level, []).extend(keys)
    return sorted(levels.items(), key=lambda x: -x[0])


class Assigner:
    """Gives each row, in order, its story: that of the most similar member of a live one, the later story on ties.

    With ``hints`` the similarities are known, and only where all stories that
    they name have died is a row compared with the members that live.
    ``ageing`` says that no row without a time will come: it could join any story.
    """

    def __init__(self, window_us: int, threshold: float, ageing: bool):
        self.window, self.threshold, self.ageing = window_us, threshold, ageing
        self.index = StoryIndex()
        self.newest = np.zeros(1024)
        self.count = 0
        self.stories: dict[bytes, set[int]] = {}
        #: Of each key met: the numbers of its sets, and the stories of its twins (None where not even a twin is near enough).
        self.met: dict[bytes, tuple[tuple[int, ...], set[int] | None]] = {}
        self.compared = 0

    def again(self, us: int | None, key: bytes, end: int | None = None) -> int:
        """The story of a row whose key was met before: that of a twin without any comparison, where one lives.

        ``end`` is the time of the last row of its run (see ``in_runs``), if there are more.
        """
        oldest = -np.inf if us is None else us - self.window
        newest = self.newest
        numbers, twins = self.met[key]
        story = -1
        for x in twins or ():
            if x > story and newest[x] >= oldest:
                story = x
        if twins and self.ageing and len(twins) > 16:
            twins.intersection_update([x for x in twins if newest[x] >= oldest])
        if story < 0:
            return self.story(us, self.index.features(numbers), key, [] if twins is None else None, end)
        end = us if end is None else end
        if end is not None and newest[story] < end:
            newest[story] = end
        own = self.stories.setdefault(key, set())
        if story not in own:
            own.add(story)
            self.index.add(self.index.features(numbers), story)
        return story

    def story(self, us: int | None, features: tuple[frozenset, ...], key: bytes, hints: Hints | None = None, end: int | None = None) -> int:
        end = us if end is None else end
        oldest = -np.inf if us is None else us - self.window
        newest = self.newest
        if self.index.members.crowded():
            # Time only grows, so a story that is too old now stays so.
            self.index.sort(newest[: self.count] >= oldest if self.ageing else None)
            if self.ageing:
                live = {k: {x for x in own if newest[x] >= oldest} for k, own in self.stories.items()}
                self.stories = {k: own for k, own in live.items() if own}
        story = -1
        for _, keys in hints or ():
            story = max((x for k in keys for x in self.stories.get(k, ()) if newest[x] >= oldest), default=-1)
            if story >= 0:
                break
        if story < 0 and hints != []:
            self.compared += 1
            nearest = self.index.nearest(features, self.threshold, lambda found: newest[found] >= oldest)
            story = max(nearest[0][1]) if nearest else -1
        if story < 0:
            story, self.count = self.count, self.count + 1
            if story == len(newest):
                self.newest = newest = np.concatenate([newest, np.zeros(story)])
            newest[story] = np.inf if us is None else end
        if us is not None and newest[story] != np.inf:
            newest[story] = max(newest[story], end)
        own = self.stories.setdefault(key, set())
        if story not in own:
            own.add(story)
            self.index.add(features, story)
        if key not in self.met:
            score = 0.0
            for weight, values in zip(CLUSTER_WEIGHTS, features, strict=True):
                score += weight * bool(values)
            self.met[key] = self.index.numbers(features), self.index.twins(features) if score >= self.threshold else None
        return story


def feature_key(features: tuple[frozenset, ...]) -> bytes:
    """A digest of all features: equal ones have equal keys."""
    return hashlib.blake2b("\1".join("\2".join(sorted(x)) for x in features).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def assign_stories(rows: list[dict], window_us: int, threshold: float) -> list[list[int]]:
    """Indices of each cluster: rows in time order join the story with the most similar member, the later story on ties."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["us"] is None, rows[i]["us"] or 0, len(rows[i]["capture_id"] or ""), rows[i]["capture_id"] or ""))
    assigner = Assigner(window_us, threshold, bool(order) and rows[order[-1]]["us"] is not None)
    stories: list[list[int]] = []
    for i in order:
        features = _features(rows[i])
        key = feature_key(features)
        story = assigner.again(rows[i]["us"], key) if key in assigner.met else assigner.story(rows[i]["us"], features, key)
        if story == len(stories):
            stories.append([])
        stories[story].append(i)
    return stories


def coherence(features: list[tuple[frozenset, ...]], times: list[int] | None = None) -> float:
    """Mean similarity of all pairs of members (each ``times``, if given); of many it is summed field by field over distinct sets and their multiples."""
    n = sum(times) if times else len(features)
    if n < 2:
        return 1.0
    if n <= 8:
        features = [f for f, m in zip(features, times, strict=True) for _ in range(m)] if times else features
        return sum(story_similarity(a, b) for k, a in enumerate(features) for b in features[k + 1 :]) / (n * (n - 1) / 2)
    total = 0.0
    for k, weight in enumerate(CLUSTER_WEIGHTS):
        counts = Counter()
        for f, m in zip(features, times or [1] * len(features), strict=True):
            counts[f[k]] += m
        field = FieldSets()
        for values in counts:
            field.number(values)
        multiples = np.array(list(counts.values()), float)
        both = sum(m * float(field.jaccard(values) @ multiples) for values, m in counts.items())
        total += weight * (both - sum(m for values, m in counts.items() if values)) / 2
    return total / (n * (n - 1) / 2)


def _dominant(sets: list[frozenset], times: list[int] | None = None) -> list[str]:
    counts = Counter()
    for s, m in zip(sets, times or [1] * len(sets), strict=True):
        for x in s:
            counts[x] += m
    return [x for x, n in sorted(counts.items(), key=lambda p: (-p[1], p[0])) if n >= 2][:TOP_TOKENS]


CLUSTER = (
    "cluster_id string, capture_ids array<string>, first_us long, last_us long, symbols array<string>, reasons array<string>, assets array<string>, "
    "domains array<string>, size int, mean_relevance double, coherence double"
)


#: Rows of the largest island that one task follows by itself; in a larger one features that a task compares (a chunk), chunks of a span that it is compared with, and chunks at most.
ALONE_ROWS, CHUNK_ROWS, SPAN_CHUNKS, MOST_CHUNKS = 200_000, 6000, 32, 64
#: Raw features whose keys a task remembers.
REMEMBERED = 200_000
LISTS = ("candidate_symbols", "impact_reason_codes", "asset_classes", "candidate_entities")
FEATURES = T.ArrayType(T.ArrayType(T.StringType()))
HINTS = "array<struct<level: double, keys: array<binary>>>"
HINT_TYPE = pa.list_(pa.struct([("level", pa.float64()), ("keys", pa.list_(pa.binary()))]))
FEATURE_TYPE = pa.list_(pa.list_(pa.string()))
#: Rows of an island in their order.
ORDER = ("late", "size", "id")


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` without title and lists, with the key of their features; ``features`` stand beside a key where a task meets it first.

    Raw features come as one text, so that only texts that a batch has not met before are looked at.
    """
    kept = [c for c in rows.columns if c not in ("title", *LISTS)]
    added = [T.StructField("key", T.BinaryType()), T.StructField("features", FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, told = {}, set()
        for batch in batches:
            coded = batch.column("raw").dictionary_encode()
            keys, new = [], {}
            for n, raw in enumerate(coded.dictionary.to_pylist()):
                key = known.get(raw)
                if key is None:
                    own = _features(json.loads(raw))
                    if len(known) >= REMEMBERED:
                        known.clear()
                    key = known[raw] = feature_key(own)
                    if key not in told:
                        told.add(key)
                        new[n] = [sorted(x) for x in own]
                keys.append(key)
            lists = [None] * batch.num_rows
            if new:
                codes, first = np.unique(coded.indices.to_numpy(), return_index=True)
                for n, at in zip(codes.tolist(), first.tolist(), strict=True):
                    lists[at] = new.get(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(keys, pa.binary()).take(coded.indices), pa.array(lists, FEATURE_TYPE)], names=[*kept, "key", "features"])

    raw = rows.select(*kept, F.to_json(F.struct("title", *LISTS)).alias("raw"))
    return raw.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), *added]))


def ordered(rows: DataFrame) -> DataFrame:
    """Add the columns of ``ORDER``."""
    text = F.coalesce("capture_id", F.lit(""))
    return rows.withColumns({"late": F.coalesce("us", F.lit((1 << 63) - 1)), "size": F.length(text), "id": text})


def in_runs(rows: DataFrame, window_us: int) -> DataFrame:
    """Add ``place``, a row's place among those of its key, and ``start``, the place at which its run begins.

    A run's rows follow each other without a gap above the window, so the story
    that the first one joins lives until the last one, and all are of it: a
    later story of the same features would have to be made by a row of this key.
    """
    own = Window.partitionBy("island", "key").orderBy(*ORDER)
    before = F.lag("us").over(own)
    placed = ordered(rows).withColumns({"place": F.row_number().over(own), "before": before})
    head = (F.col("place") == 1) | (F.col("before").isNotNull() & (F.col("us").isNull() | (F.col("us") - F.col("before") > window_us)))
    start = F.max(F.when(head, F.col("place"))).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("start", start).drop("before", *ORDER)


def alone_keys(firsts: DataFrame, threshold: float) -> DataFrame:
    """(island, key) of the features whose rows have to be followed one by one.

    That is where not even a twin is near enough, and where other features of
    the island are the same in all fields that these have: their stories count too.
    """
    fields = range(len(CLUSTER_WEIGHTS))
    filled = sum((F.when(F.size(F.get("features", k)) > 0, 1 << k).otherwise(0) for k in fields), F.lit(0))
    rows = firsts.select("island", "key", "features", filled.alias("filled"))
    # At most 32.
    kinds = [r["filled"] for r in rows.select("filled").distinct().collect()]
    low = [p for p in kinds if reduce(lambda a, k: a + CLUSTER_WEIGHTS[k] * bool(p >> k & 1), fields, 0.0) < threshold]
    out = rows.filter(F.col("filled").isin(low) if low else F.lit(False)).select("island", "key")
    inner = [(p, q) for p in kinds for q in kinds if p != q and p & q == p]
    if inner:
        parts = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in inner))
        wider = rows.select("island", "features", F.explode(F.filter(parts, lambda x: x["q"] == F.col("filled"))).alias("x"))
        cut = F.array(*(F.when(F.col("x.p").bitwiseAND(1 << k) != 0, F.get("features", k)).otherwise(F.array().cast("array<string>")) for k in fields))
        wider = wider.select("island", F.col("x.p").alias("filled"), F.to_json(cut).alias("sets")).distinct()
        out = out.unionByName(rows.withColumn("sets", F.to_json("features")).join(wider, ["island", "filled", "sets"], "left_semi").select("island", "key"))
    return out.distinct()


def first_met(rows: DataFrame) -> DataFrame:
    """(island, key, features, n, chunk): each of an island's features once, where it is first met, in chunks of that order; ``rows`` are in runs."""
    # A task tells a key's features once, for all islands.
    told = rows.filter("features is not null").groupBy("key").agg(F.first("features").alias("features"))
    firsts = ordered(rows.filter("place = 1").select("island", "key", "us", "capture_id")).join(told, "key")
    firsts = materialize(firsts.select("island", "key", "features", *ORDER), "story-features")
    chunks = firsts.count() // chunk_rows(firsts) + 1
    # Partitions of the range are in order, and so are the numbers: partition and place in it.
    order = ["island", *ORDER, "key"]
    numbered = firsts.repartitionByRange(chunks, *order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id())
    return materialize(numbered.withColumn("chunk", F.shiftright("n", 33).cast("int")), "story-firsts")


def chunk_rows(firsts: DataFrame) -> int:
    """Rows of a chunk: a member is shipped to each later chunk, so there are no more than ``MOST_CHUNKS``."""
    return max(CHUNK_ROWS, firsts.count() // MOST_CHUNKS + 1)


def _sets(features: list[list[str]]) -> tuple[frozenset, ...]:
    return tuple(map(frozenset, features))


def nearest_earlier(rows: DataFrame, threshold: float) -> DataFrame:
    """(n, hints) of the features of islands in several chunks (``first_met``), one line for each span of chunks up to their own."""
    span_chunks = max(1, SPAN_CHUNKS * CHUNK_ROWS // chunk_rows(rows))
    rows = rows.select("island", "n", "chunk", "key", "features")
    chunks = rows.select("island", "chunk").distinct()
    own = Window.partitionBy("island")
    # As many lines as there are chunks.
    chunks = chunks.withColumn("place", F.row_number().over(own.orderBy("chunk")) - 1).withColumn("many", F.count(F.lit(1)).over(own) > 1).filter("many")
    chunks = materialize(chunks.select("island", "chunk", F.floor(F.col("place") / span_chunks).cast("int").alias("span")), "story-chunks")
    # Groups are few and cost much, so they are dealt over several times as many partitions.
    partitions = max(1, 4 * (chunks.agg(F.sum(F.col("span") + 1)).first()[0] or 0))
    tasks = chunks.select("island", F.col("chunk").alias("of"), F.explode(F.sequence(F.lit(0), "span")).alias("span"), F.col("span").alias("last"))
    asked = rows.join(tasks.select("island", F.col("of").alias("chunk"), "span", (F.col("span") == F.col("last")).alias("own")), ["island", "chunk"]).withColumnRenamed("chunk", "of")
    members = rows.select("island", "chunk", "key", "features").join(chunks, ["island", "chunk"])
    members = members.join(tasks.drop("last"), ["island", "span"]).filter(F.col("chunk") < F.col("of"))
    # Columns of their own, as both sides are of one table.
    members = members.select(*(F.col(c).alias(c) for c in ("island", "of", "span", "key", "features")))
    asked = asked.select(*(F.col(c).alias(c) for c in ("island", "of", "span", "n", "key", "features", "own"))).repartition(partitions, "island", "of", "span")

    def run(asked: pa.Table, members: pa.Table) -> pa.Table:
        index, keys, numbers = StoryIndex(), [], {}

        def add(key: bytes, features: tuple[frozenset, ...]) -> None:
            # Each of the distinct features is a story of its own here.
            if key not in numbers:
                numbers[key] = len(keys)
                keys.append(key)
                index.add(features, numbers[key])

        for key, features in zip(members.column("key").to_pylist(), members.column("features").to_pylist(), strict=True):
            add(key, _sets(features))
        index.sort()
        ids, hints, known = [], [], {}
        asked = asked.sort_by("n")
        inside = asked.num_rows > 0 and asked.column("own")[0].as_py()
        for n, key, lists in zip(asked.column("n").to_pylist(), asked.column("key").to_pylist(), asked.column("features").to_pylist(), strict=True):
            features = _sets(lists)
            found = None if inside else known.get(key)
            if found is None:
                found = known[key] = [{"level": level, "keys": [keys[x] for x in which]} for level, which in index.nearest(features, threshold)]
            ids.append(n)
            hints.append(found)
            if inside:
                add(key, features)
                if index.members.crowded():
                    index.sort()
        return pa.table([pa.array(ids, pa.int64()), pa.array(hints, HINT_TYPE)], names=["n", "hints"])

    by = ("island", "of", "span")
    return asked.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(run, f"n long, hints {HINTS}")


def placed_runs(rows: DataFrame, firsts: DataFrame, hints: DataFrame, window_us: int, threshold: float) -> DataFrame:
    """(island, key, run, rows, story): the runs of ``rows`` (``run`` is the place of the first row) and whose they are.

    An island is followed in order, a run at a time, by one task that holds what
    lives.  Features and hints come once for each key, in lines of their own
    before its first run.
    """
    told = hints.groupBy("n").agg(F.collect_list("hints").alias("parts"))
    heads = firsts.join(told, "n", "left").select("island", *ORDER, "key", "features", "parts", F.lit(False).alias("row"))
    of = ["island", "key", "run"]
    ends = rows.groupBy(*of).agg(F.max("us").alias("end"), F.count(F.lit(1)).alias("rows"))
    runs = ordered(rows.filter("place = run").select(*of, "us", "capture_id")).join(ends, of)
    every = runs.select("island", *ORDER, "key", "run", "rows", "us", "end", F.lit(True).alias("row")).unionByName(heads, allowMissingColumns=True)
    order = ["island", *ORDER, "row"]
    out = ["island", "key", "run", "rows"]
    lines = every.repartition("island").sortWithinPartitions(*order).select(*out, "us", "end", "row", "features", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, assigner, heads = None, None, {}
        for batch in batches:
            stories, is_row = [], batch.column("row")
            new = batch.filter(pc.invert(is_row))
            fresh = zip(new.column("features").to_pylist(), new.column("parts").to_pylist(), strict=True)
            for own, key, us, end, row in zip(*(batch.column(c).to_pylist() for c in ("island", "key", "us", "end", "row")), strict=True):
                if assigner is None or own != island:
                    # In an island with rows of no time these come last, and may join any story.
                    island, assigner, heads = own, Assigner(window_us, threshold, own != TIMELESS), {}
                if not row:
                    heads[key] = next(fresh)
                elif key in assigner.met:
                    stories.append(assigner.again(us, key, end))
                else:
                    features, parts = heads.pop(key)
                    hints = None if parts is None else merged_hints([[(x["level"], x["keys"]) for x in part] for part in parts])
                    stories.append(assigner.story(us, _sets(features), key, hints, end))
            kept = batch.filter(is_row)
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in out), pa.array(stories, pa.int64())], names=[*out, "story"])

    return lines.mapInArrow(run, T.StructType([*(lines.schema[c] for c in out), T.StructField("story", T.LongType())]))


SCHEMA = pa.schema([
    (p.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[p.split()[1]]) for p in CLUSTER.split(", ")
])


def _slices(values: pa.Array | pa.ChunkedArray, size: int = 100_000) -> Iterator[list]:
    for at in range(0, len(values), size):
        yield values.slice(at, size).to_pylist()


def summed_up(rows: DataFrame, runs: DataFrame, firsts: DataFrame, least: int, domains: int) -> DataFrame:
    """Clusters of ``rows`` by the story of their run: members pass a task in order and only ids and scores are held, features are counted by key."""
    of = ["island", "story"]
    head = [c for c in SCHEMA.names if c not in ("symbols", "reasons", "assets", "coherence")]
    types = pa.schema([("island", pa.int64()), ("story", pa.int64()), *(SCHEMA.field(c) for c in head)])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(story: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = pa.Table.from_batches(parts).combine_chunks()
            places = sorted({(x or "").strip().lower() for x in pc.unique(own.column("domain")).to_pylist()} - {""})
            if own.num_rows < least or (domains > 1 and len(places) < domains):
                return
            ids = pc.fill_null(own.column("capture_id"), "").combine_chunks()
            digest = hashlib.sha1()
            for k, part in enumerate(_slices(ids.take(pc.sort_indices(ids)))):
                digest.update(("|" if k else "").encode() + "|".join(part).encode())
            ends = pc.min_max(own.column("us")).as_py()
            score = sum(x or 0.0 for part in _slices(own.column("finance_relevance_score")) for x in part)
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            values = {"island": [story[0]], "story": [story[1]], "cluster_id": [digest.hexdigest()], "capture_ids": listed, "first_us": [ends["min"]], "last_us": [ends["max"]], "domains": [places], "size": [len(ids)], "mean_relevance": [score / len(ids)]}
            yield pa.RecordBatch.from_arrays([values[f.name] if f.name == "capture_ids" else pa.array(values[f.name], f.type) for f in types], schema=types)

        story, parts = None, []
        for batch in batches:
            island, number = batch.column("island").to_numpy(), batch.column("story").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(island) != 0) | (np.diff(number) != 0)) + 1).tolist(), len(island)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                owner = int(island[a]), int(number[a])
                if owner != story:
                    if parts:
                        yield from closed(story, parts)
                    story, parts = owner, []
                parts.append(batch.slice(a, b - a).select(["capture_id", "us", "domain", "finance_relevance_score"]))
        if parts:
            yield from closed(story, parts)

    def contents(own: pa.Table) -> pa.Table:
        features, times = [_sets(x) for x in own.column("features").to_pylist()], own.column("times").to_pylist()
        tops = [_dominant([f[k] for f in features], times) for k in range(3)]
        found = {"island": own.column("island")[0].as_py(), "story": own.column("story")[0].as_py(), **dict(zip(("symbols", "reasons", "assets"), tops, strict=True)), "coherence": coherence(features, times)}
        return pa.Table.from_pylist([found], schema=pa.schema([("island", pa.int64()), ("story", pa.int64()), *(SCHEMA.field(c) for c in ("symbols", "reasons", "assets", "coherence"))]))

    kinds = dict(p.split() for p in CLUSTER.split(", "))
    placed = rows.join(runs.select("island", "key", "run", "story"), ["island", "key", "run"])
    lines = ordered(placed.select(*of, "capture_id", "us", "domain", "finance_relevance_score")).repartition(*of).sortWithinPartitions(*of, *ORDER)
    heads = lines.drop(*ORDER).mapInArrow(members, ", ".join(["island long", "story long", *(f"{c} {kinds[c]}" for c in head)]))
    counts = runs.groupBy(*of, "key").agg(F.sum("rows").alias("times"))
    counts = counts.join(firsts.select("island", "key", "features"), ["island", "key"])
    told = counts.groupBy(*of).applyInArrow(contents, "island long, story long, symbols array<string>, reasons array<string>, assets array<string>, coherence double")
    return heads.join(told, of).select(*SCHEMA.names)


def cluster_records(records: DataFrame, window_s: int = 1800, threshold: float = 0.35, least: int = 2, domains: int = 1) -> DataFrame:
    """Event clusters by greedy single linkage over a weighted Jaccard similarity, each row joining the live story of the nearest earlier row.

    Rows without the columns of a feature have none.  Islands (see ``islands``)
    run in parallel.  Where one has more than ``ALONE_ROWS`` rows, its distinct
    features are compared in parallel too: chunks of them in the order in which
    they are first met, each with the spans before it, tell how near which
    earlier features are.  What is sequential is then only to look up whose
    stories those are, and which of them live, for the first row of each run of
    equal features (``in_runs``).  Both ways give the same clusters.
    """
    kinds = {"title": "string", "domain": "string", "finance_relevance_score": "double"}
    columns = ["capture_id", "title", "domain", "candidate_symbols", "impact_reason_codes", "asset_classes", "candidate_entities", "finance_relevance_score", "us", "island"]
    rows = islands(records, window_s)
    rows = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(kinds.get(c, "array<string>")).alias(c) for c in columns))
    largest = rows.groupBy("island").count().agg(F.max("count")).first()[0] or 0
    if largest > ALONE_ROWS:
        window_us = window_s * 1_000_000
        rows = materialize(in_runs(keyed(rows.withColumn("capture_id", F.col("capture_id").cast("string"))), window_us), "story-rows")
        firsts = first_met(rows)
        alone = materialize(alone_keys(firsts, threshold), "story-alone").withColumn("alone", F.lit(True))
        rows = rows.drop("features").join(alone, ["island", "key"], "left").withColumn("run", F.when(F.col("alone"), F.col("place")).otherwise(F.col("start")))
        runs = materialize(placed_runs(rows, firsts, nearest_earlier(firsts, threshold), window_us, threshold), "story-runs")
        return summed_up(rows, runs, firsts, least, domains)

    def summary(own: list[dict]) -> tuple:
        features = [_features(r) for r in own]
        ids = [str(r["capture_id"] or "") for r in own]
        times = [r["us"] for r in own if r["us"] is not None]
        places = sorted({(r["domain"] or "").strip().lower() for r in own} - {""})
        score = sum(r["finance_relevance_score"] or 0.0 for r in own) / len(own)
        return (
            hashlib.sha1("|".join(sorted(ids)).encode()).hexdigest(), ids, min(times, default=None), max(times, default=None),
            *(_dominant([f[k] for f in features]) for k in range(3)), places, len(own), score, coherence(features),
        )

    def run(table: pa.Table) -> pa.Table:
        own = table.to_pylist()
        found = [summary([own[i] for i in m]) for m in assign_stories(own, window_s * 1_000_000, threshold) if len(m) >= least]
        found = [x for x in found if domains <= 1 or len(x[7]) >= domains]
        return pa.Table.from_pylist([dict(zip(SCHEMA.names, x, strict=True)) for x in found], schema=SCHEMA)

    return rows.groupBy("island").applyInArrow(run, CLUSTER)


def lead_lag_events(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """(cluster_id, domain, leader, lag_s): each outlet of a cluster with its lag behind the first one (null for the leader)."""
    members = clusters.select("cluster_id", F.explode("capture_ids").alias("capture_id"))
    outlet = F.coalesce(F.when(F.trim("domain") != "", F.lower(F.trim("domain"))), F.lit("unknown"))
    found = members.join(timed(records).select("capture_id", outlet.alias("domain"), "us"), "capture_id")
    first = found.groupBy("cluster_id").agg(F.min(F.struct("us", "capture_id", "domain")).alias("head"))
    per = found.groupBy("cluster_id", "domain").agg(F.min("us").alias("us"))
    joined = per.join(first, "cluster_id")
    leader = F.col("domain") == F.col("head.domain")
    return joined.select("cluster_id", "domain", leader.alias("leader"), F.when(~leader, F.floor((F.col("us") - F.col("head.us")) / 1_000_000)).alias("lag_s"))


def lead_lag_scores(events: DataFrame) -> DataFrame:
    """Each outlet's share of clusters led, mean lags, and the composite of lead rate and number led."""
    gaps = events.groupBy("cluster_id").agg(F.min("lag_s").alias("gap"))
    joined = events.join(gaps, "cluster_id")
    led = F.count_if("leader")
    out = joined.groupBy("domain").agg(F.count(F.lit(1)).alias("participated"), led.alias("led"), F.avg("lag_s").alias("mean_lag"), F.avg(F.when(F.col("leader"), F.col("gap"))).alias("mean_lead"))
    rate = F.col("led") / F.col("participated")
    depth = F.least(F.lit(1.0), F.log10(F.col("led") + 1) / 2)
    return out.withColumn("lead_rate", rate).withColumn("composite", 0.6 * F.col("lead_rate") + 0.4 * depth)


def novelty_raw(records: DataFrame) -> Column:
    """What of a record its features follow from, as one struct."""
    excerpt = F.substring("text_excerpt", 1, 500) if "text_excerpt" in records.columns else F.lit("")
    return F.struct("title", excerpt.alias("text"), "candidate_symbols", "impact_reason_codes", "asset_classes")


RAW_TYPE = "title string, text string, candidate_symbols array<string>, impact_reason_codes array<string>, asset_classes array<string>"


def novelty_features(rows: DataFrame) -> DataFrame:
    """(capture_id, features) of (capture_id, raw), where ``raw`` is ``novelty_raw`` as JSON."""
    rows = rows.select("capture_id", F.from_json("raw", RAW_TYPE).alias("raw")).select("capture_id", "raw.*")
    tokens = F.array_except(F.filter(F.split(F.lower(F.concat_ws(" ", "title", "text")), "[^a-z0-9]+"), lambda w: F.length(w) >= 3), F.array(*map(F.lit, NOVELTY_STOPWORDS)))
    low = lambda c: F.array_distinct(F.transform(c, lambda x: F.lower(F.trim(x))))
    return rows.select("capture_id", tokens.alias("tokens"), low("candidate_symbols").alias("symbols"), low("impact_reason_codes").alias("reasons"), low("asset_classes").alias("classes"))


#: Distinct raw features of which a task holds the least id at a time.
HELD = 100_000


def least_of_equal(rows: DataFrame, asked: list[str]) -> DataFrame:
    """(capture_id, raw): of rows with equal ``raw`` that of the least id (a shorter one is less); rows of ``asked`` ids, or of none, stay each by itself."""
    asked = [x for x in asked if x is not None]
    apart = {None, *asked}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(ids: list, raws: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(raws, pa.string())], names=["capture_id", "raw"])

        least: dict[str, tuple] = {}
        for batch in batches:
            coded = batch.column("raw").dictionary_encode()
            raws, alone, best = coded.dictionary.to_pylist(), [], {}
            for n, own in zip(coded.indices.to_pylist(), batch.column("capture_id").to_pylist(), strict=True):
                if own in apart:
                    alone.append((own, raws[n]))
                    continue
                place = len(own), own
                if n not in best or place < best[n]:
                    best[n] = place
            for n, place in best.items():
                held = least.get(raws[n])
                if held is None or place < held:
                    least[raws[n]] = place
            if alone:
                yield told(*zip(*alone, strict=True))
            if len(least) > HELD:
                yield told([x[1] for x in least.values()], list(least))
                least.clear()
        yield told([x[1] for x in least.values()], list(least))

    few = rows.select("capture_id", "raw").mapInArrow(run, "capture_id string, raw string")
    own = F.when(F.col("capture_id").isNull(), "-").when(F.col("capture_id").isin(asked) if asked else F.lit(False), F.concat(F.lit("+"), "capture_id"))
    first = F.min(F.struct(F.length("capture_id").alias("size"), "capture_id")).alias("first")
    return few.groupBy("raw", own.alias("own")).agg(first).select("first.capture_id", "raw")


def novelty(records: DataFrame, newest: int = 200) -> DataFrame:
    """How far each of the ``newest`` records is from all others: 1 less the greatest similarity, and the nearest record.

    The stated newest records are compared with the whole corpus, which
    streams past them, equal features once; ties go to the smaller id.
    """
    text = F.to_json(novelty_raw(records)).alias("raw")
    # The asked features are as many as stated, so they go to every task.
    first = records.orderBy(F.desc("created_at"), F.desc(F.length("capture_id")), F.desc("capture_id")).limit(newest)
    asked = novelty_features(first.select("capture_id", text)).collect()
    ids = [r["capture_id"] for r in asked]
    fields = ("tokens", "symbols", "reasons", "classes")
    sizes = {f: np.array([len(set(r[f] or ())) for r in asked], float) for f in fields}
    holders: dict[str, dict[str, list[int]]] = {f: {} for f in fields}
    for n, r in enumerate(asked):
        for f in fields:
            for v in set(r[f] or ()):
                holders[f].setdefault(v, []).append(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {c: n for n, c in enumerate(ids)}
        for batch in batches:
            own = batch.column(0).to_pylist()
            if not own or not ids:
                continue
            total = np.zeros((len(own), len(ids)))
            for weight, f, column in zip(NOVELTY_WEIGHTS, fields, batch.columns[1:5], strict=True):
                common, length = np.zeros_like(total), np.zeros(len(own))
                for k, values in enumerate(column.to_pylist()):
                    distinct = set(values or ())
                    length[k] = len(distinct)
                    for v in distinct:
                        if (at := holders[f].get(v)) is not None:
                            common[k, at] += 1
                total += weight * common / np.maximum(length[:, None] + sizes[f][None, :] - common, 1)
            for k, c in enumerate(own):
                if c in number:
                    total[k, number[c]] = -1.0
            total = np.round(total, 12)
            # The best of the batch, ties to the shorter, then smaller, id.
            place = sorted(range(len(own)), key=lambda k: (len(own[k] or ""), own[k] or ""))
            best = np.array(place)[total[place].argmax(axis=0)]
            found = [(ids[n], float(total[k, n]), own[k]) for n, k in enumerate(best.tolist()) if total[k, n] >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string()))], names=["q_capture_id", "sim", "nearest"])

    corpus = novelty_features(least_of_equal(records.select("capture_id", text), ids))
    pairs = corpus.select("capture_id", *fields).mapInArrow(run, "q_capture_id string, sim double, nearest string")
    head = F.min(F.struct((-F.col("sim")).alias("minus"), F.length("nearest").alias("size"), "nearest"))
    best = pairs.groupBy("q_capture_id").agg(head.alias("h")).select("q_capture_id", (-F.col("h.minus")).alias("sim"), F.col("h.nearest").alias("nearest"))
    label = F.when(F.col("sim") < 0.10, "first of kind in corpus").when(F.col("sim") >= 0.85, "near-duplicate").when(F.col("sim") >= 0.50, "shares symbols + theme").otherwise("low overlap with prior coverage")
    return best.select(F.col("q_capture_id").alias("capture_id"), (1 - F.col("sim")).alias("novelty"), "nearest", label.alias("explanation"))


def _entropy(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Normalised entropy of a list column's values per domain."""
    counts = rows.select("domain", F.explode(column).alias("v")).filter("v <> ''").groupBy("domain", "v").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("domain")))
    out = shares.groupBy("domain").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"), F.count(F.lit(1)).alias("k"))
    return out.select("domain", F.when(F.col("k") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("h") / F.log(F.greatest("k", F.lit(2)).cast("double"))))).alias(name))


def source_scorecards(records: DataFrame, as_of_us: int, days: int = 30, least: int = 3) -> DataFrame:
    """Each domain's relevance, density, skew, diversity and uniqueness over the days before ``as_of_us``, and their mean."""
    name = F.coalesce(F.when(F.trim("domain") != "", F.lower(F.trim("domain"))), F.lit("(unknown)"))
    rows = timed(records).filter(F.col("us").between(as_of_us - days * 86_400_000_000, as_of_us + 86_400_000_000)).withColumn("domain", name)
    score, label = F.coalesce("finance_relevance_score", F.lit(0.0)), F.col("sentiment_label")
    base = rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("is_finance_relevant").alias("relevant"), F.coalesce(F.avg(F.when(F.col("is_finance_relevant"), score)), F.lit(0.0)).alias("mean_relevance"),
        F.count_if(score >= 0.7).alias("high"), F.count_if(label == "positive").alias("pos"), F.count_if(label == "negative").alias("neg"), F.count_if(label.isin("positive", "negative", "neutral")).alias("labelled"),
    )
    symbols = materialize(rows.select("domain", F.explode("candidate_symbols").alias("s")).filter("s <> ''").distinct(), "domain-symbols")
    homes = symbols.groupBy("s").agg(F.count(F.lit(1)).alias("homes"))
    unique = symbols.join(homes, "s").groupBy("domain").agg((F.count_if(F.col("homes") == 1) / F.count(F.lit(1))).alias("uniqueness"))
    out = base.filter(F.col("records") >= least)
    for part in (_entropy(rows, "asset_classes", "asset_diversity"), _entropy(rows, "impact_reason_codes", "reason_diversity"), unique):
        out = out.join(part, "domain", "left")
    out = out.na.fill(0.0, ["asset_diversity", "reason_diversity", "uniqueness"]).select(
        "domain", "records", "relevant", (F.col("relevant") / F.col("records")).alias("relevant_rate"), "mean_relevance", (F.col("high") / F.col("records")).alias("density"),
        ratio((F.col("pos") - F.col("neg")).cast("double"), F.col("labelled")).alias("skew"), "asset_diversity", "reason_diversity", "uniqueness",
    )
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    parts = ["relevant_rate", "mean_relevance", "density", "skew", "asset_diversity", "reason_diversity", "uniqueness"]
    return out.withColumn("composite", sum((unit(F.abs(c)) for c in parts), F.lit(0.0)) / len(parts))
