"""Uploaded files as (title, text): plain text, Markdown, HTML, JSON and JSON lines."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# What HTML hides, where its lines end, and the greatest size.
UNSEEN = frozenset(("script", "style", "noscript", "iframe", "object", "embed"))
HEADINGS = frozenset(("h1", "h2", "h3"))
LINES = frozenset(("p", "div", "br", "li", "tr"))
MOST_BYTES = 5 * 1024 * 1024
TITLE = 200


class UploadError(ValueError):
    pass


class _Events(HTMLParser):
    """A page as a list of (kind, value): an opened tag, a closed tag, or text."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.list: list[tuple[str, str]] = []
        self.handle_starttag = lambda tag, attrs: self.list.append(("open", tag))
        self.handle_endtag = lambda tag: self.list.append(("close", tag))
        self.handle_data = lambda data: self.list.append(("text", data))
        self.feed(page)
        self.close()


def shown(events: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The events outside elements that aren't seen; an end tag without its start closes nothing."""
    steps = ({"open": 1, "close": -1}.get(kind, 0) * (value in UNSEEN) for kind, value in events)
    depths = list(accumulate(steps, lambda depth, step: max(0, depth + step), initial=0))
    return [event for event, depth in zip(events, depths, strict=False) if not depth]


def page_heading(events: list[tuple[str, str]]) -> str | None:
    """The text from the last opening before the first closing of a heading."""
    marks = [(i, kind) for i, (kind, value) in enumerate(events) if value in HEADINGS and kind != "text"]
    opened = next((i for i, kind in marks if kind == "open"), len(events))
    end = next((i for i, kind in marks if kind == "close" and i > opened), None)
    if end is None:
        return None
    begin = max(i for i, kind in marks if kind == "open" and i < end)
    words = "".join(value for kind, value in events[begin:end] if kind == "text").split()
    return " ".join(words)[:TITLE].strip() or None


def page_text(events: list[tuple[str, str]]) -> str:
    """Text by lines, each without white space at its ends, and at most one empty line between two."""
    ends = {("close", tag) for tag in LINES}
    whole = "".join("\n" if event in ends else event[1] if event[0] == "text" else "" for event in events)
    blocks = groupby((line.strip() for line in whole.splitlines()), key=bool)
    return "\n".join(x for filled, lines in blocks for x in (lines if filled else list(lines)[:1])).strip()


def first_sentence(text: str) -> str | None:
    """Up to the first stop past the twentieth character, or the beginning."""
    text = text.strip()
    end = re.compile(r"[.!?]").search(text, 21)
    return (text[: end.end()] if end else text)[:TITLE].strip() or None


def _said(value) -> str:
    return str(value.get("text") or value.get("body") or "") if isinstance(value, dict) else ""


def _parsed(line: str):
    try:
        return json.loads(line)
    except json.JSONDecodeError as error:
        raise UploadError("invalid json") from error


def of_page(text: str) -> tuple[str | None, str]:
    events = shown(_Events(text).list)
    plain = page_text(events)
    return page_heading(events) or first_sentence(plain), plain


def of_object(text: str) -> tuple[str | None, str]:
    value = _parsed(text)
    own = value.get("title") if isinstance(value, dict) else None
    return None if own is None else str(own), _said(value)


def of_lines(text: str) -> tuple[str | None, str]:
    said = (_said(_parsed(line)) for line in text.splitlines() if line.strip())
    whole = "\n\n".join(filter(None, said))
    return first_sentence(whole), whole


def of_text(text: str) -> tuple[str | None, str]:
    heads = re.search(r"^[^\S\n]*#[ ](.*)$", text, re.MULTILINE)
    return heads[1].lstrip("# ").strip() if heads else first_sentence(text), text


#: How each kind of file is read: (title, text) of its decoded text.
READERS = {".html": of_page, ".htm": of_page, ".json": of_object, ".jsonl": of_lines} | dict.fromkeys((".txt", ".md", ".markdown"), of_text)


def extract(name: str, body: bytes | None, most: int = MOST_BYTES) -> tuple[str | None, str]:
    """Title and text of one file; ``UploadError`` says why there are none."""
    read = READERS.get(re.search(r"\.[^./\\]*$|$", name.lower()).group())
    refused = {"empty": not body, "too large": len(body or b"") > most, "unsupported type": read is None}
    for why, holds in refused.items():
        if holds:
            raise UploadError(why)
    title, text = read(body.decode("utf-8", errors="replace"))
    if not text and read is not of_text:
        raise UploadError("no text")
    return title, text


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (path, content); Spark leaves files of no bytes out."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def extracted(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(path, title, text, error) of (path, content); a file that can't be read has an error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, body in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    out.append((path.as_py(), *extract(path.as_py() or "", body.as_py(), most), None))
                except UploadError as error:
                    out.append((path.as_py(), None, None, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], names=["path", "title", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, title string, text string, error string")
