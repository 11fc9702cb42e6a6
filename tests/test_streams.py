"""The source of server-sent events: any cut of a stream gives the same events."""

from __future__ import annotations

import random

import pytest

from tidewire.sources import sse

PARTS = [b"data: one\n\n", b"data:two\r\ndata:  three\r\n\r\n", b": beat\n\n", b"event: x\rdata: four\r\r", b"\n\n\n", b"id: 3\ndata: \xc3\xa9\xff\n\n", b"data:\n\n", b"data: no end"]


def plain(data: bytes, most: int) -> list[str]:
    """All events of the whole stream by splitting its text."""
    text = data.decode("latin-1").replace("\r\n", "\n").replace("\r", "\n")
    out = []
    for block in text.split("\n\n")[:-1]:
        lines = [x[5:].lstrip(" ") for x in block.split("\n") if x.startswith("data:")]
        if lines and len(block) + 2 <= most:
            out.append("\n".join(lines).encode("latin-1").decode("utf-8", "replace"))
    return out


def stream(seed: int) -> bytes:
    rng = random.Random(seed)
    return b"".join(rng.choice(PARTS[:-1]) for _ in range(12)) + PARTS[-1]


@pytest.mark.parametrize("seed", range(5))
def test_every_cut_gives_the_same_events(seed):
    data = stream(seed)
    want = [x for _, x in sse.EventParser().feed(data)]
    assert want == plain(data, sse.MOST)
    for cut in range(len(data) + 1):
        parser = sse.EventParser()
        assert [x for piece in (data[:cut], data[cut:]) for _, x in parser.feed(piece)] == want
    parser = sse.EventParser()
    assert [x for k in range(len(data)) for _, x in parser.feed(data[k : k + 1])] == want


def test_reader_looks_back_for_what_is_unfinished(tmp_path, monkeypatch):
    monkeypatch.setattr(sse, "MOST", 40)
    monkeypatch.setattr(sse, "PIECE", 7)
    for seed in range(6):
        folder = tmp_path / str(seed)
        folder.mkdir()
        data = stream(seed) + b"\n\ndata: " + b"x" * 60 + b"\n\ndata: after\n\n" + b"data: y\n" * 9 + b"\ndata: last\n\n"
        reader = sse.EventReader({"path": str(folder)})
        rng = random.Random(seed)
        start, out, at = reader.initialOffset(), [], 0
        while at < len(data):
            at = min(len(data), at + rng.choice([1, 2, 3, 30]))
            (folder / "a.sse").write_bytes(data[:at])
            end = reader.latestOffset()
            out += [row for part in reader.partitions(start, end) for row in reader.read(part)]
            start = end
        whole = [x for part in reader.partitions(reader.initialOffset(), start) for x in reader.read(part)]
        assert out == whole and len({r[1] for r in out}) == len(out)
        texts = [r[2] for r in out]
        assert texts[-2:] == ["after", "last"] and not any("xx" in t or "y\ny" in t for t in texts)


def test_a_stream_with_restarts(spark, tmp_path):
    folder, data = tmp_path / "in", stream(9)
    folder.mkdir()
    for k, upto in enumerate([5, 30, 31, len(data)]):
        (folder / "a.sse").write_bytes(data[:upto])
        (folder / "b.sse").write_bytes(b"data: b\n\n" * (k + 1))
        query = sse.event_stream(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["data"] for r in rows if r["source"] == "a.sse") == sorted(plain(data, sse.MOST))
    assert sum(r["source"] == "b.sse" for r in rows) == 4 and len({(r["source"], r["position"]) for r in rows}) == len(rows)
