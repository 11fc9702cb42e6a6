"""Cross-tokenizer alignment: two tokenizations of the same bytes, grouped where both have an end.

Long texts are cut into pieces where neither tokenizer can have a token across
(before a space between two other characters), which tasks tokenize apart.  The
tokens of a piece are dealt to ranges of bytes by where they end, and every
range becomes a fragment with open ends (see ``fragments``).  Fragments of one
document are composed up a tree, a bounded number at a time, in as many rounds
as the longest document needs; only the open tokens travel.  A text of one
range is whole by itself.

Two token ids are linked where their tokens share bytes.  How many documents
hold a pair linked is counted over all of them; the most frequent pairs, up to
a bound, go to all tasks as sorted arrays, all others are looked up by a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import materialize, text_batches
from .fragments import NOTHING, START, Fragment, Groups, Names, Tokens, compose, split, whole
from .packing import byte_encoder

#: Bytes of a range, and ranges that are composed at once.
RANGE_BYTES, FAN = 1 << 16, 16
#: Pairs of ids that go to all tasks at most (16 bytes each).
HEAVY_PAIRS = 1_000_000
#: Tokens that are aligned together.
BATCH_TOKENS = 500_000
CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"


class Pair:
    """Two tokenizers: how each encodes a text that has a space before it, and the bytes of its ids.

    ``encode_a`` takes a text with that space, ``encode_b`` texts without.
    """

    def __init__(self, encode_a, encode_b, lengths_a: np.ndarray, bytes_b: list[bytes]):
        self.encode_a, self.encode_b, self.lengths_a, self.bytes_b = encode_a, encode_b, lengths_a, bytes_b
        self.lengths_b = np.array([len(x) for x in bytes_b], np.int64)
        #: Little-endian ids, in as few bytes as will do.
        self.kind = "<u2" if max(len(lengths_a), len(bytes_b)) <= 1 << 16 else "<u4"

    def tokens(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both for each text with a space before it; None where one doesn't give its bytes back, or it is empty."""
        out = []
        for text, b in zip(texts, self.encode_b(texts), strict=True):
            data = b" " + text.encode("utf-8", "surrogatepass")
            a = np.asarray(self.encode_a(" " + text))
            same = bool(text) and int(self.lengths_a[a].sum()) == len(data) and b"".join(map(self.bytes_b.__getitem__, b)) == data
            out.append((a.astype(self.kind).tobytes(), np.array(b, self.kind).tobytes()) if same else None)
        return out


@cache
def default_pair(byte_ranks: str | None = None, byte_json: str | None = None, pieces: str | None = None) -> Pair:
    """The public byte-level BPE of 50,257 ids and the public pieces of 32,000.

    The ids of the first are encoded from its ranks (see ``packing``), without
    special tokens; their bytes are those of the .json file's entries.
    """
    import public_tokenizers as public
    import sentencepiece

    with open(byte_json or public.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = json.load(file)
    number = {x: i for i, x in enumerate(byte_letters())}
    lengths = np.zeros(max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]) + 1, np.int64)
    for word, i in spec["model"]["vocab"].items():
        lengths[i] = len([number[c] for c in word]) if all(c in number for c in word) else len(word.encode())
    model = sentencepiece.SentencePieceProcessor(model_file=pieces or public.path("piece_bpe_32k.model"))
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            table.append(bytes([int(piece[3:5], 16)]))
        else:
            # A piece that holds a space inside could lie across a cut.
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"a piece across words: {piece}")
            table.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(SPACE, " ").encode())
    encode = byte_encoder(byte_ranks or public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    return Pair(encode, lambda texts: model.encode(texts, num_threads=1), lengths, table)


def cut_text(text: str, most: int = RANGE_BYTES) -> Iterator[tuple[int, str]]:
    """(start in characters, piece) of a text: each piece but the first begins with the space of a cut, and has ``most`` characters or more."""
    start = 0
    while start < len(text):
        found = CUT.search(text, start + most)
        end = found.start() if found else len(text)
        yield start, text[start:end]
        start = end


TOKENS = "row long, doc_id {}, start long, at long, ok boolean, a binary, b binary, a_start long, b_start long"


def tokenized(pieces: DataFrame, make=default_pair) -> DataFrame:
    """Both streams of ``pieces`` (row, doc_id, start, text): a line for each range of a piece, with where its tokens begin.

    A piece with start above 0 begins with the space that the first has before it.
    """
    schema = TOKENS.format(pieces.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = make()
        for whole_batch in batches:
            for batch in text_batches(whole_batch, 3, 1_000_000):
                starts = batch.column(2).to_pylist()
                texts = [t[1:] if s else t or "" for s, t in zip(starts, batch.column(3).to_pylist(), strict=True)]
                rows, out = [], []
                for i, (start, found) in enumerate(zip(starts, pair.tokens(texts), strict=True)):
                    if found is None:
                        rows.append(i)
                        out.append((start, False, b"", b"", start, start))
                        continue
                    last = start + len(texts[i].encode("utf-8", "surrogatepass")) + 1
                    if last - start <= RANGE_BYTES:
                        rows.append(i)
                        out.append((start, True, *found, start, start))
                        continue
                    a, b = (np.frombuffer(x, pair.kind) for x in found)
                    ends = [start + np.cumsum(lengths[ids]) for ids, lengths in ((a, pair.lengths_a), (b, pair.lengths_b))]
                    at, before = start, [(0, start), (0, start)]
                    while at < last:
                        stop = at + RANGE_BYTES if last - at > RANGE_BYTES else last
                        upto = [int(np.searchsorted(e, stop, side="right")) for e in ends]
                        rows.append(i)
                        out.append((at, True, a[before[0][0] : upto[0]].tobytes(), b[before[1][0] : upto[1]].tobytes(), before[0][1], before[1][1]))
                        before = [(n, int(e[n - 1]) if n else start) for n, e in zip(upto, ends, strict=True)]
                        at = stop
                at, ok, a, b, a_start, b_start = zip(*out, strict=True) if out else [()] * 6
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns[:3], pa.array(at, pa.int64()), pa.array(ok, pa.bool_()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(a_start, pa.int64()), pa.array(b_start, pa.int64())],
                    names=["row", "doc_id", "start", "at", "ok", "a", "b", "a_start", "b_start"],
                )

    return pieces.select("row", "doc_id", "start", "text").mapInArrow(run, schema)


def read_tokens(pair: Pair, a: bytes, b: bytes, a_start: int, b_start: int) -> Tokens:
    ids = [np.frombuffer(x, pair.kind).astype(np.int64) for x in (a, b)]
    return Tokens(ids[0], a_start + np.cumsum(pair.lengths_a[ids[0]]), ids[1], b_start + np.cumsum(pair.lengths_b[ids[1]]))


OPEN = ("a", "b", "a_start", "b_start")
STREAMS = [("a", pa.binary()), ("b", pa.binary()), ("a_start", pa.int64()), ("b_start", pa.int64())]
#: A line is a fragment, or (joined) the tokens of a group that closed between two; ``p_`` is the prefix or the group, ``s_`` the suffix.
FRAGMENT_TYPE = pa.schema([("row", pa.int64()), ("at", pa.int64()), ("joined", pa.bool_()), ("closed", pa.bool_()), *((f"{side}_{x}", t) for side in "ps" for x, t in STREAMS)])
FRAGMENT = "row long, at long, joined boolean, closed boolean, p_a binary, p_b binary, p_a_start long, p_b_start long, s_a binary, s_b binary, s_a_start long, s_b_start long"


def write_tokens(pair: Pair, own: Tokens, side: str) -> dict:
    """Ids of both streams and where they begin: their lengths tell all ends."""
    starts = [int(ends[0] - lengths[ids[0]]) if len(ids) else 0 for ids, ends, lengths in ((own.a, own.a_ends, pair.lengths_a), (own.b, own.b_ends, pair.lengths_b))]
    return dict(zip((f"{side}_{x}" for x in OPEN), (own.a.astype(pair.kind).tobytes(), own.b.astype(pair.kind).tobytes(), *starts), strict=True))


def _line(pair: Pair, row: int, at: int, joined: bool, closed: bool, first: Tokens, second: Tokens = NOTHING) -> dict:
    return {"row": row, "at": at, "joined": joined, "closed": closed} | write_tokens(pair, first, "p") | write_tokens(pair, second, "s")


def fragments(ranges: DataFrame, make=default_pair) -> DataFrame:
    """The fragment of every line of ``ranges`` (as ``tokenized`` makes them): its open tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = make()
        for batch in batches:
            for r in batch.to_pylist():
                own, _ = split(read_tokens(pair, r["a"], r["b"], r["a_start"], r["b_start"]))
                yield pa.RecordBatch.from_pylist([_line(pair, r["row"], r["at"], False, own.closed, own.prefix, own.suffix)], schema=FRAGMENT_TYPE)

    return ranges.select("row", "at", *OPEN).mapInArrow(run, FRAGMENT)


def composed(lines: DataFrame, last: int, make=default_pair) -> DataFrame:
    """The groups that close between ranges (row, a, b, a_start, b_start) from fragments; ``last`` is the greatest start of a range."""

    def run(table: pa.Table) -> pa.Table:
        pair = make()
        rows = table.sort_by("at").to_pylist()
        row, at = rows[0]["row"], rows[0]["at"]
        own, out = (START if at == 0 else None), []
        for r in rows:
            right = Fragment(*(read_tokens(pair, *(r[f"p_{x}"] for x in OPEN)), r["closed"], read_tokens(pair, *(r[f"s_{x}"] for x in OPEN))))
            if own is None:
                own = right
                continue
            own, met = compose(own, right)
            if met is not None and len(met):
                out.append(_line(pair, row, at, True, True, met))
        return pa.Table.from_pylist([_line(pair, row, at, False, own.closed, own.prefix, own.suffix), *out], schema=FRAGMENT_TYPE)

    done = []
    live, width, first = lines, FAN, True
    while first or last // RANGE_BYTES * FAN // width > 0:
        first = False
        made = materialize(live.groupBy("row", F.floor(F.col("at") / (RANGE_BYTES * width)).alias("slot")).applyInArrow(lambda table: run(table), FRAGMENT), "aligned-fragments")
        done.append(made.filter("joined"))
        live, width = made.filter("not joined"), width * FAN
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("row", *(F.col(f"p_{x}").alias(x) for x in OPEN))


def read_groups(pair: Pair, r: dict) -> Groups:
    """The groups of a document's part: all of its tokens, or those that lie whole in a range."""
    own = read_tokens(pair, *(r[x] for x in OPEN))
    return split(own)[1] if r["inner"] else whole(own)


def token_batches(pair: Pair, batch: pa.RecordBatch) -> Iterator[tuple[int, int, Tokens, np.ndarray, np.ndarray]]:
    """(first row, rows, tokens one after another, where each row's begin in either stream) of rows of whole documents."""
    width = np.dtype(pair.kind).itemsize
    a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
    sizes = [(len(x) // width, len(y) // width) for x, y in zip(a, b, strict=True)]
    first, held = 0, 0
    for i, (n, m) in enumerate([*sizes, (0, 0)]):
        if i == len(sizes) or (held and held + n + m > BATCH_TOKENS):
            if i > first:
                starts = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.array(sizes[first:i], np.int64).reshape(-1, 2), axis=0)])
                yield first, i - first, read_tokens(pair, b"".join(a[first:i]), b"".join(b[first:i]), 0, 0), starts[:, 0], starts[:, 1]
            first, held = i, 0
        held += n + m


def linked_codes(own: Groups, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """``a * wide + b`` of every link, and the bytes' ends."""
    a, b, ends = own.links()
    return a * wide + b, ends


def pair_counts(short: DataFrame, long: DataFrame, make=default_pair) -> DataFrame:
    """(code, n): how many documents hold each pair of ids linked; ``short`` are whole documents of one range, ``long`` parts of others."""

    def of_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = make()
        wide = len(pair.lengths_b)
        space = wide * len(pair.lengths_a)
        for batch in batches:
            for _, _, tokens, a_starts, _ in token_batches(pair, batch):
                codes, ends = linked_codes(whole(tokens), wide)
                lasts = tokens.a_ends[a_starts[1:][a_starts[1:] > 0] - 1]
                once = np.unique(np.searchsorted(lasts, ends) * space + codes) % space
                codes, n = np.unique(once, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    def of_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = make()
        for batch in batches:
            for r in batch.to_pylist():
                codes = np.unique(linked_codes(read_groups(pair, r), len(pair.lengths_b))[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), r["row"]), pa.int64()), pa.array(codes, pa.int64())], names=["row", "code"])

    ones = short.select("a", "b").mapInArrow(of_short, "code long, n long")
    others = long.select("row", "inner", *OPEN).mapInArrow(of_long, "row long, code long").distinct().select("code", F.lit(1).cast("long").alias("n"))
    return ones.unionByName(others).groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """Sorted codes of the frequent pairs with their counts, and the highest count of each first id."""

    codes: np.ndarray
    n: np.ndarray
    highest: np.ndarray
    wide: int

    def sums(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each link its count (0 if the pair isn't a frequent one), whether it is its first id's highest, and whether it is known."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        known = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        n = np.where(known, self.n[at] if len(self.codes) else 0, 0)
        return n, known & (n == self.highest[codes // self.wide]), known


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
TAIL = pa.list_(pa.struct([("code", pa.int64()), ("times", pa.int64())]))
MEASURED = ", ".join(f"{m} long" for m in MEASURES) + ", groups {}, tail array<struct<code: long, times: long>>"


def _tail(codes: np.ndarray, known: np.ndarray) -> list[dict]:
    rest, times = np.unique(codes[~known], return_counts=True)
    return [{"code": c, "times": t} for c, t in zip(rest.tolist(), times.tolist(), strict=True)]


@cache
def names_of(size: int) -> Names:
    """Each id in decimal, with each separator after it."""
    return tuple(np.array([f"{i}{mark}" for i in range(size)], object) for mark in ",|;")


def measured_short(short: DataFrame, counts, make=default_pair) -> DataFrame:
    """Measures of whole documents, with the digest of their groups, and the links that ``counts`` (a broadcast) doesn't know."""
    schema = f"row long, {MEASURED.format('string')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, table = make(), counts.value
        names = names_of(max(len(pair.lengths_a), len(pair.lengths_b)))
        for batch in batches:
            for first, n, tokens, a_starts, b_starts in token_batches(pair, batch):
                own = whole(tokens)
                codes, ends = linked_codes(own, table.wide)
                count, best, known = table.sums(codes)
                words = own.words(names).tolist()
                # Where each document ends among the bytes, the groups and the links.
                lasts = np.concatenate([[0], tokens.a_ends])[a_starts]
                group_ends = tokens.a_ends[own.a_cuts - 1] if len(own) else tokens.a_ends[:0]
                g, k = np.searchsorted(group_ends, lasts, side="right"), np.searchsorted(ends, lasts, side="right")
                sums = [np.concatenate([[0], np.cumsum(x)])[k] for x in (best, count)]
                digests, tails = [], []
                for i in range(n):
                    w = words[a_starts[i] + b_starts[i] : a_starts[i + 1] + b_starts[i + 1]]
                    digests.append(hashlib.sha256("".join(w)[:-1].encode()).hexdigest() if w else "")
                    rest = slice(k[i], k[i + 1])
                    tails.append([] if known[rest].all() else _tail(codes[rest], known[rest]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, n), *(pa.array(np.diff(x), pa.int64()) for x in (a_starts, b_starts, g, k, *sums)), pa.array(digests, pa.string()), pa.array(tails, TAIL)],
                    names=["row", *MEASURES, "groups", "tail"],
                )

    return short.select("row", "a", "b").mapInArrow(run, schema)


def measured_long(long: DataFrame, counts, make=default_pair) -> DataFrame:
    """As ``measured_short`` from documents' parts: measured apart, then followed in order, so that no document is held whole."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, table = make(), counts.value
        names = names_of(max(len(pair.lengths_a), len(pair.lengths_b)))
        for batch in batches:
            for r in batch.to_pylist():
                own = read_groups(pair, r)
                if not len(own):
                    continue
                codes, _ = linked_codes(own, table.wide)
                n, best, known = table.sums(codes)
                values = (len(own.tokens.a), len(own.tokens.b), len(own), len(codes), int(best.sum()), int(n.sum()))
                line = dict(zip(MEASURES, values, strict=True)) | {"row": r["row"], "at": int(own.tokens.a_ends[0]), "groups": own.text(names), "tail": _tail(codes, known)}
                yield pa.RecordBatch.from_pylist([line], schema=pa.schema([("row", pa.int64()), ("at", pa.int64()), *((m, pa.int64()) for m in MEASURES), ("groups", pa.string()), ("tail", TAIL)]))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, digest = None, None
        names = ["row", "groups"]
        for batch in batches:
            done = []
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != row:
                    if digest is not None:
                        done.append((row, digest.hexdigest()))
                    row, digest = r, hashlib.sha256()
                else:
                    digest.update(b";")
                digest.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.string())], names=names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=names)

    parts = materialize(long.select("row", "inner", *OPEN).mapInArrow(apart, f"row long, at long, {MEASURED.format('string')}"), "aligned-parts")
    digests = parts.repartition("row").sortWithinPartitions("row", "at").select("row", "groups").mapInArrow(follow, "row long, groups string")
    tails = parts.select("row", F.explode("tail").alias("x")).groupBy("row", "x.code").agg(F.sum("x.times").alias("times")).groupBy("row").agg(F.collect_list(F.struct("code", "times")).alias("tail"))
    sums = parts.groupBy("row").agg(*(F.sum(m).alias(m) for m in MEASURES))
    return sums.join(digests, "row").join(tails, "row", "left").select("row", *MEASURES, "groups", F.coalesce("tail", F.array().cast("array<struct<code: long, times: long>>")).alias("tail"))


def align(docs: DataFrame, make=default_pair, heavy: int = HEAVY_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs`` (doc_id, text).

    A text whose bytes, with a space before it, one of the tokenizers doesn't
    give back has zeros and an empty digest, as have null and empty ones.
    Repeated rows count as often as they are there and get equal results, null
    doc_ids are kept, other columns are ignored, and an empty table gives none.
    ``make`` makes the pair of tokenizers on a worker.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lengthy = F.length("text") > RANGE_BYTES // 4
    short = tokenized(docs.filter(~lengthy).select(F.lit(0).cast("long").alias("row"), "doc_id", F.lit(0).cast("long").alias("start"), "text"), make)
    # Texts of at most a quarter of the bytes in characters are of one range.
    short = materialize(short.withColumn("row", F.monotonically_increasing_id()), "aligned-short")
    long = materialize(docs.filter(lengthy).withColumn("row", -1 - F.monotonically_increasing_id()).select("row", "doc_id", "text"), "aligned-long")
    ranges = materialize(tokenized(_pieces(long), make), "aligned-ranges")
    bad = ranges.filter("not ok").select("row").distinct()
    good = ranges.join(bad, "row", "left_anti")
    last = ranges.agg(F.max("at")).first()[0]
    joined = composed(materialize(fragments(good, make), "aligned-fragments"), last or 0, make)
    parts = good.select("row", F.lit(True).alias("inner"), *OPEN).unionByName(joined.withColumn("inner", F.lit(False)))
    whole_docs = short.filter("ok")
    counted = materialize(pair_counts(whole_docs, parts, make), "aligned-counts")
    wide = len(make().lengths_b)
    table, least = _frequent(counted, heavy, wide, len(make().lengths_a))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    found = materialize(measured_short(whole_docs, shared, make).unionByName(measured_long(parts, shared, make)), "aligned-measures")
    if least:
        found = _with_rare(found, counted.filter(F.col("n") < least), counted, wide)
    rows = short.select("row", "doc_id").unionByName(long.select("row", "doc_id"))
    zero = [F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES]
    return rows.join(found.drop("tail"), "row", "left").select("doc_id", *zero, F.coalesce("groups", F.lit("")).alias("groups_sha256"))


def _pieces(long: DataFrame) -> DataFrame:
    """(row, doc_id, start, text): each text's pieces with their starts in bytes, the space before a text counted, dealt over all tasks."""
    schema = f"row long, doc_id {long.schema['doc_id'].dataType.simpleString()}, start long, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in text_batches(whole_batch, 2):
                for i, text in enumerate(batch.column(2).to_pylist()):
                    at = 0
                    for start, piece in cut_text(text, RANGE_BYTES):
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([at], pa.int64()), pa.array([piece], pa.string())], names=["row", "doc_id", "start", "text"])
                        at += len(piece.encode("utf-8", "surrogatepass")) + (start == 0)

    return long.mapInArrow(run, schema).repartition(F.col("row"), F.col("start"))


def _frequent(counted: DataFrame, heavy: int, wide: int, first_ids: int) -> tuple[Counts, int]:
    """The pairs of the highest counts, ``heavy`` at most, and the least count among them if there are others (else 0)."""
    least = 0
    if counted.count() > heavy:
        # One line for each different count.
        steps = counted.groupBy("n").agg(F.count(F.lit(1)).alias("pairs"))
        upto = F.sum("pairs").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
        least = steps.withColumn("upto", upto).filter(F.col("upto") <= heavy).agg(F.min("n")).first()[0] or (1 << 62)
    own = counted.filter(F.col("n") >= least).toArrow()
    codes, n = own.column("code").to_numpy(), own.column("n").to_numpy()
    order = np.argsort(codes)
    tops = counted.groupBy(F.floor(F.col("code") / wide).cast("long").alias("a")).agg(F.max("n").alias("n")).toArrow()
    highest = np.zeros(first_ids, np.int64)
    highest[tops.column("a").to_numpy()] = tops.column("n").to_numpy()
    return Counts(codes[order], n[order], highest, wide), least


def _with_rare(found: DataFrame, rare: DataFrame, counted: DataFrame, wide: int) -> DataFrame:
    """``found`` with the links of rare pairs, each of which few documents hold."""
    tops = counted.groupBy(F.floor(F.col("code") / wide).cast("long").alias("a")).agg(F.max("n").alias("top"))
    # A line for each first id.
    rare = rare.withColumn("a", F.floor(F.col("code") / wide).cast("long")).join(tops, "a")
    links = found.select("row", F.explode("tail").alias("x")).select("row", "x.code", "x.times").join(rare, "code")
    more = links.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum"))
    joined = found.join(more, "row", "left")
    return joined.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).drop("_best", "_sum")
