"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many
of the greatest length as fit, then the binary digits of the rest, longest
first.  Each piece is a sequence of its own, so no sequence crosses documents,
none needs padding, and a training job draws each batch from one bucket of
equal lengths.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, numbered

#: Texts of an Arrow batch are encoded together; a batch is cut at this many characters.
BATCH_CHARS = 4_000_000
#: Characters of a run of white space (as the pattern has it) that the pattern meets at most.
LONG_BLANK = 200
BLANKS = regex.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_BLANK + 1},}}+")
TWO_BLANKS = regex.compile(r"\s\s")


@cache
def byte_encoder(ranks_path: str, pattern: str, end: str | None = None, end_id: int = 0) -> Callable[[str], np.ndarray]:
    """Byte-level BPE with the given merge ranks; the end marker's own string in a text is its id (without one, all is plain text).

    The pattern looks ahead after white space, which takes time with the square
    of a run and memory with its length, so runs above ``LONG_BLANK`` are taken
    out by hand: all of a run but the last character before other text is one
    word of the pattern's, and that character begins the text after it.
    """
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    code = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={end: end_id} if end else {})
    word = tiktoken.Encoding("packing-word", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if len(text) <= LONG_BLANK or not TWO_BLANKS.search(text[:: LONG_BLANK // 2]):
            return code.encode_to_numpy(text, allowed_special="all")
        parts, at = [], 0
        for run in BLANKS.finditer(text):
            # The end marker splits a text before the pattern does, so a run before it is whole.
            stop = run.end() if run.end() == len(text) or (end and text.startswith(end, run.end())) else run.end() - 1
            parts += [code.encode_to_numpy(text[at : run.start()], allowed_special="all"), word.encode_to_numpy(text[run.start() : stop], disallowed_special=())]
            at = stop
        return np.concatenate([*parts, code.encode_to_numpy(text[at:], allowed_special="all")])

    return encode


def default_encoder() -> Callable[[str], np.ndarray]:
    """The public byte-level BPE of 50,257 ids.

    The merge ranks are those of ``byte_bpe_50k.json``; reading them from the
    equal ``.tiktoken`` file gives the same ids in a quarter of the time.
    """
    import public_tokenizers as tokens

    return byte_encoder(tokens.path("byte_bpe_50k.tiktoken"), tokens.PATTERN, "<|endoftext|>", 50256)


def binary_lengths(n: int, longest: int) -> list[int]:
    """``n`` as a sum of powers of two, none above ``longest``, longest first."""
    out = [longest] * (n // longest)
    rest = n % longest
    while rest:
        bit = 1 << (rest.bit_length() - 1)
        out.append(bit)
        rest -= bit
    return out


def decompose(
    docs: DataFrame,
    longest: int = 1024,
    end_id: int = 0,
    encoder: Callable[[], Callable[[str], np.ndarray]] = default_encoder,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, doc_tokens and ids.

    ids is binary: little-endian unsigned 32-bit integers, ready to be written
    to a token file.  ``longest`` must be a power of two.  A null or empty text
    is the end id alone.  Repeated rows give their pieces each time; other
    columns are ignored; an empty table gives no pieces.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ])
    end = np.array([end_id], dtype="<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            taken: list[int] = []
            rows: list[tuple[int, int, int, bytes]] = []
            held = 0
            for i, text in enumerate(batch.column(1)):
                ids = np.concatenate([np.asarray(encode(text.as_py() or ""), dtype="<u4"), end])
                at = 0
                for n in binary_lengths(len(ids), longest):
                    taken.append(i)
                    rows.append((at, n, len(ids), ids[at : at + n].tobytes()))
                    at += n
                held += len(ids)
                if held > BATCH_CHARS:
                    yield pieces(batch, taken, rows)
                    taken, rows, held = [], [], 0
            if rows:
                yield pieces(batch, taken, rows)

    def pieces(batch: pa.RecordBatch, taken: list[int], rows: list[tuple]) -> pa.RecordBatch:
        start, length, tokens, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(taken, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary())],
            names=["doc_id", "start", "length", "doc_tokens", "ids"],
        )

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def assign_sequences(pieces: DataFrame, order: list[str], length: str = "length") -> DataFrame:
    """Add sequence_id and offset (0: a piece is a sequence) to pieces, bucket by bucket of equal lengths.

    In each bucket the sequences are numbered gapless from 0 over all tasks;
    ``sequence_id`` interleaves the buckets as ``number * 64 + log2(length)``,
    so it is unique and its bucket can be read from it.
    """
    bucket = F.log2(F.col(length).cast("double")).cast("int")
    rows = numbered(materialize(pieces.withColumn("bucket", bucket), "packing-pieces"), ["bucket"], order, "_number")
    return rows.withColumn("sequence_id", F.col("_number") * 64 + F.col("bucket")).withColumn("offset", F.lit(0).cast("long")).drop("_number")


def pack_documents(docs: DataFrame, longest: int = 1024, end_id: int = 0) -> DataFrame:
    """Every piece of every document of ``docs`` (doc_id, text) with its sequence, and a checksum in place of its ids.

    A null or empty text is one piece, the end id alone.  Repeated rows give
    their pieces each time, a null doc_id is kept as it is, columns other than
    doc_id and text are ignored whatever their names, and an empty table gives
    an empty result.
    """
    pieces = decompose(docs, longest, end_id).withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")
    return assign_sequences(pieces, ["doc_id", "start", "ids_crc32"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"
    )
