"""Server-sent events: frames from a text, whole or in pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of an event at most, and bytes that are read at once.
MOST = 4 * 1024 * 1024
PIECE = 8 * 1024 * 1024
LINE_END = re.compile(rb"\r\n|\r|\n")


def frames(text: Column) -> Column:
    """The data of each complete event of a stream's text: its ``data:`` lines joined by line feeds; comments are left out."""
    events = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n+")
    whole = F.slice(events, 1, F.greatest(F.size(events) - 1, F.lit(0)))
    lines = lambda e: F.transform(F.filter(F.split(e, "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", ""))
    return F.filter(F.transform(whole, lambda e: F.array_join(lines(e), "\n")), lambda d: d != "")


def remainder(text: Column) -> Column:
    """What follows the last complete event, to go before the next piece; nothing if it is beyond the cap."""
    rest = F.element_at(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n+"), -1)
    return F.when(F.length(rest) <= MOST, rest).otherwise("")


#: The schema of the stream source.
EVENTS = "source string, position long, data string"


class EventParser:
    """Events of a stream fed in pieces, which carries what follows the last one.

    An event ends with the first character of the line end that makes a line
    empty, so where pieces are cut changes nothing: not even a cut between the
    two characters of one line end.  ``start`` is the byte that comes first;
    ``known`` says whether an event begins there, else all up to the first empty
    line is left out, as are events of more than ``MOST`` bytes.
    """

    def __init__(self, start: int = 0, known: bool = True):
        self.start, self.known, self.held = start, known, b""

    def feed(self, piece: bytes) -> list[tuple[int, str]]:
        """(end, data) of the events that this piece completes."""
        held = self.held + piece
        out, lines, at, begin, known = [], [], 0, 0, self.known
        # Where nothing is known of the beginning, the first line may have begun before.
        partial = not known
        while (end := LINE_END.search(held, at)) is not None:
            line, stop, at = held[at : end.start()], end.start() + 1, end.end()
            if line or partial:
                lines.append(line)
                partial = False
                continue
            own = [x.removeprefix(b"data:").lstrip(b" ") for x in lines if x.startswith(b"data:")]
            if known and own and stop - begin <= MOST:
                out.append((self.start + stop, b"\n".join(own).decode("utf-8", "replace")))
            lines, begin, known = [], at, True
        if len(held) - begin > MOST + 2:
            # Too long already: only its last line is kept, to find its end.
            begin, known = max(begin, held.rfind(b"\n", 0, -1) + 1, held.rfind(b"\r", 0, -1) + 1, len(held) - MOST), False
        self.held, self.start, self.known = held[begin:], self.start + begin, known
        return out


class EventReader(DataSourceStreamReader):
    """Reads files of raw server-sent events that grow: one partition for each file with new bytes.

    An offset is the size of every file.  What follows the last event of a batch
    isn't kept anywhere: the next batch reads it again, as it looks back by at
    most ``MOST`` bytes for where the unfinished event began.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def initialOffset(self) -> dict:
        return {"sizes": {}}

    def latestOffset(self) -> dict:
        store, folder = self._files()
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {"sizes": {f.base_name: f.size for f in found if f.is_file and f.size and not f.base_name.startswith((".", "_"))}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before = start["sizes"]
        return [InputPartition((name, before.get(name, 0), size)) for name, size in sorted(end["sizes"].items()) if size > before.get(name, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, first, last = partition.value
        store, folder = self._files()
        with store.open_input_file(f"{folder}/{name}") as file:
            # Far enough back for the start of any event that isn't too long.
            at = max(0, first - MOST - 2)
            parser = EventParser(at, at == 0)
            while at < last:
                size = min(PIECE, last - at)
                for stop, data in parser.feed(file.read_at(size, at)):
                    if stop > first:
                        yield name, stop, data
                at += size

    def commit(self, end: dict) -> None:
        pass


class EventSource(DataSource):
    """``spark.readStream.format("sse").load(folder)``: (source, position, data) of every event once, position being the byte at which it ends."""

    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> EventReader:
        return EventReader(self.options)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(EventSource)
    return spark.readStream.format("sse").load(path)
