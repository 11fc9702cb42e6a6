"""Enrichment on golden captures, feeds, sinks and streams."""

from __future__ import annotations

import hashlib
import random
import re
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as tx
from tidewire.functions.time import parse_timestamp
from tidewire.operators import lookup
from tidewire.plans import enrich as en
from tidewire.sources import captures, feeds, sinks
from tidewire.streaming import pipeline as st

# Our own captures: title, text, domain, and what must be found.
GOLDEN = [
    ("g1", "Fed lifts interest rates as inflation persists", "The Federal Reserve raised rates again. Treasuries fell and bonds slumped while inflation stayed high.", "reuters.com", True, {"rates"}, {"central_bank", "inflation"}, set(), None),
    ("g2", "Apple earnings beat forecasts", "Apple ($AAPL) reported strong earnings and revenue growth. Shares gain as guidance was raised.", "cnbc.com", True, {"equities"}, {"earnings", "guidance"}, {"AAPL"}, "positive"),
    ("g3", "Oil slides as OPEC lifts output", "Brent crude oil fell sharply. Traders warn of weak demand for gas and oil.", "bloomberg.com", True, {"commodities"}, {"energy"}, {"BZ=F"}, "negative"),
    ("g4", "Bitcoin rally lifts ethereum", "Bitcoin and ethereum gain as stablecoin flows surge on a regulation ruling.", "coindesk.com", True, {"crypto"}, {"regulation"}, {"BTC-USD", "ETH-USD"}, "positive"),
    ("g5", "Striker scores twice in cup final", "The match ended with a late goal and a touchdown celebration on the scoreboard.", "espn.com", False, set(), set(), set(), None),
    ("g6", "A recipe for autumn", "This horoscope and recipe column returns with soup.", "tmz.com", False, set(), set(), set(), None),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(g[0], g[0], g[1], g[2], g[3], "rss") for g in GOLDEN]
    return {r["capture_id"]: r for r in en.enrich(spark.createDataFrame(rows, "capture_id string, doc_id string, title string, text string, domain string, source_type string")).collect()}


@pytest.mark.parametrize("g", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden(golden, g):
    row = golden[g[0]]
    assert row["is_finance_relevant"] is g[4]
    assert g[5] <= set(row["asset_classes"]) and g[6] <= set(row["impact_reason_codes"]) and g[7] <= set(row["candidate_symbols"])
    if g[8]:
        assert row["sentiment_label"] == g[8]


def test_records_have_evidence_and_horizons(golden):
    row = golden["g2"]
    # The sentence with three of the terms comes before the title with two.
    assert row["evidence_sentences"][:2] == ["Apple ($AAPL) reported strong earnings and revenue growth.", "Apple earnings beat forecasts"] and row["impact_horizons"][:2] == ["intraday", "one_day"]
    assert row["reason_text"].endswith("sentiment=positive") and row["component_scores"]["domain_prior"] == 0.85


def test_label_scores_plain_model(spark):
    rows = spark.createDataFrame([("1", "Oil oil price", "oil gas natural gas and the natural gas"), ("2", None, None)], "capture_id string, title string, text string")
    got = {(r["capture_id"], r["label"]): r["score"] for r in en.label_scores(rows).collect()}
    sigmoid = lambda x: 1 / (1 + np.exp(1 - x))
    # oil twice in the title; gas three times in the body; "natural gas" twice as a pair of the body.
    assert got["1", "commodities"] == pytest.approx(sigmoid(2 * 3 + 3)) and got["1", "energy"] == pytest.approx(sigmoid(2 * 3 + 2 * 1.5))
    assert not any(k[0] == "2" for k in got)


def test_misspelt_name_and_denied_ticker(spark):
    rows = spark.createDataFrame([("1", "Microsft slips (SEC)", "A short note.", "x", "rss")], "capture_id string, title string, text string, domain string, source_type string")
    assert en.with_symbols(en.with_entities(rows)).first()["candidate_symbols"] == ["MSFT"]


def test_hash_embedding_plain_model(spark):
    out = en.hash_embedding(spark.createDataFrame([("fed, raises",), (None,)], "text string")).collect()
    want = np.zeros(64)
    for feature, w in (("fed", 1), ("raises", 1), ("fed raises", 0.5)):
        h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
        want[h % 64] += w if h >> 32 & 1 else -w
    assert np.allclose(out[0]["vector"], want / np.linalg.norm(want), atol=1e-6) and not any(out[1]["vector"])


@pytest.mark.parametrize(("text", "epoch"), [
    ("2024-01-02T03:04:05Z", 1704164645), ("2024-01-02T03:04:05+05:00", 1704146645), ("2024-01-02T03:04:05", 1704164645), ("Tue, 02 Jan 2024 03:04:05 +0000", 1704164645),
    ("20240102T030405Z", 1704164645), ("20240102030405", 1704164645), ("1704164645", 1704164645), ("nonsense", None), (None, None),
])
def test_timestamps(spark, text, epoch):
    row = spark.createDataFrame([(text,)], "t string").select(F.unix_seconds(parse_timestamp(F.col("t")))).first()
    assert row[0] == epoch


def test_text_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v"))).first()[0]
    assert one(tx.canonical_url, "HTTPS://WWW.Ex.com/A/?utm_source=x&b=1#f") == "https://ex.com/A?b=1"
    assert one(tx.canonical_url, "no url") == "no url" and one(tx.canonical_url, None) == ""
    assert one(tx.normal_title, "Apple beats! - The Verge") == "apple beats" and one(tx.normal_title, "Hi!") == ""
    assert one(tx.csv_safe, "=1") == "'=1" and one(tx.safe_tag, " a.b ") == "a.b" and one(tx.safe_tag, "a b") is None
    assert one(tx.sentences, "One here. Two here! Subscribe now. One here.") == ["One here.", "Two here!"]
    assert one(tx.plain_html, "<p>a &amp; b</p><script>x</script> c") == "a & b c"


def test_atom_and_broken_feeds(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="s"/><link href="https://www.a.example/x"/><summary>&lt;b&gt;hi&lt;/b&gt;</summary><updated>2024-01-02T00:00:00Z</updated></entry></feed>'
    rss = '<rss><channel><item><title>G - Src</title><link>https://news.google.com/1</link><source url="https://www.src.example">Src</source></item></channel></rss>'
    out = feeds.parse_xml_feed(spark.createDataFrame([(atom,), (rss,), ("<rss",), (None,)], "body string")).collect()
    assert {(r["title"], r["text"], r["domain"]) for r in out} == {("T", "hi", "a.example"), ("G", "G", "src.example")} or {(r["title"], r["domain"]) for r in out} == {("T", "a.example"), ("G", "src.example")}
    assert feeds.parse_articles(spark.createDataFrame([("[]",), ("{bad",)], "body string")).count() == 0


def test_upsert_is_idempotent_and_newest_wins(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = lambda *x: spark.createDataFrame(list(x), "capture_id string, v int, created_at timestamp")
    path = f"file://{tmp_path}/table"
    sinks.overwrite_buckets(rows(("a", 1, t), ("b", 1, t)), path, ["capture_id"], buckets=4)
    for _ in range(2):
        sinks.overwrite_buckets(rows(("a", 2, t + timedelta(1)), ("b", 0, t - timedelta(1))), path, ["capture_id"], buckets=4)
    assert {(r["capture_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1)}


def _files(folder):
    return {str(f.relative_to(folder)) for f in folder.rglob("*.parquet")}


def test_upsert_rewrites_only_what_a_batch_replaces(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = lambda *x: spark.createDataFrame(list(x), "capture_id string, v int, m map<string,double>, created_at timestamp")
    table, path, scratch = tmp_path / "table", f"file://{tmp_path}/table", Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    first = [(str(k), k, {"x": k / 7}, t) for k in range(40)]
    left = set(scratch.glob("upsert-*"))
    sinks.overwrite_buckets(rows(*first), path, ["capture_id"], buckets=8)
    before = _files(table)
    sinks.overwrite_buckets(rows(*first), path, ["capture_id"], buckets=8)
    assert _files(table) == before  # a batch that runs again writes nothing
    sinks.overwrite_buckets(rows(*first, ("new", 1, None, t)), path, ["capture_id"], buckets=8)
    assert _files(table) > before and len(_files(table)) == len(before) + 1  # a new key adds a file
    before = _files(table)
    # One row of another microsecond, and an older one that loses.
    sinks.overwrite_buckets(rows(("3", 3, {"x": 3 / 7}, t + timedelta(microseconds=1)), ("4", 0, None, t - timedelta(1))), path, ["capture_id"], buckets=8)
    gone = before - _files(table)
    assert len({f.split("/")[0] for f in gone}) == 1
    got = {r["capture_id"]: (r["v"], r["created_at"]) for r in spark.read.parquet(path).collect()}
    assert got == {**{str(k): (k, t) for k in range(40)}, "3": (3, t + timedelta(microseconds=1)), "new": (1, t)}
    assert set(scratch.glob("upsert-*")) == left


@pytest.mark.parametrize("seed", [1, 2])
def test_upserts_against_a_plain_model(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(sinks, "MANY_FILES", 2)  # buckets are also written as one again
    rng, path, held = random.Random(seed), f"file://{tmp_path}/table", {}
    for _ in range(5):
        batch = []
        for k in [None, *map(str, range(30))]:
            # Rows of one key in a batch differ in time; a time may be missing, which loses.
            days = rng.sample([None, 1, 2, 3, 4], rng.choice([0, 0, 1, 1, 2]))
            batch += [(k, rng.randrange(3), None if d is None else datetime(2024, 1, d)) for d in days]
        sinks.overwrite_buckets(spark.createDataFrame(batch, "capture_id string, v int, created_at timestamp"), path, ["capture_id"], buckets=4)
        age = lambda r: (r[2] is not None, r[2])
        for r in sorted(batch, key=lambda r: (r[2] is not None, r[2] or datetime(1970, 1, 1))):
            if r[0] not in held or held[r[0]][2] is None or (r[2] is not None and age(r) >= age(held[r[0]])):
                held[r[0]] = r
    got = [tuple(r) for r in spark.read.parquet(path).select("capture_id", "v", "created_at").collect()]
    assert len(got) == len(held) and {r[0]: r for r in got} == held


def test_captures_are_written_compressed(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(str(k), str(k), "Rates rise", "The Federal Reserve raised rates.", t) for k in range(50)], "capture_id string, doc_id string, title string, text string, published_ts timestamp")
    captures.write_captures(rows, f"file://{tmp_path}/in")
    assert {f.suffix for f in (tmp_path / "in").rglob("part-*")} == {".gz"}
    assert {r["capture_id"] for r in captures.read_captures(spark, f"file://{tmp_path}/in").collect()} == set(map(str, range(50)))
    for _ in range(2):
        st.upsert_records(captures.stream_captures(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
    assert {r["capture_id"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == set(map(str, range(50)))


def test_tags(spark):
    t = datetime(2024, 1, 1)
    tags = spark.createDataFrame([("1", "x", t)], "capture_id string, tag string, created_at timestamp")
    more = spark.createDataFrame([("1", " x ", t), ("2", "ok", t), ("3", "bad tag", t)], tags.schema)
    assert {(r["capture_id"], r["tag"]) for r in lookup.add_tags(tags, more).collect()} == {("1", "x"), ("2", "ok")}


def plain_titles(rows, window):
    first, kept = {}, set()
    for at, i, key in sorted(rows):
        if key not in first or at - first[key] > window:
            first[key] = at
            kept.add(i)
    return kept


def title_rows(spark, n=60):
    rng = random.Random(5)
    t = datetime(2024, 1, 1)
    data = [(str(i), f"common headline number {rng.randint(0, 3)}", t + timedelta(minutes=rng.randint(0, 2000))) for i in range(n)] + [("s1", "Hi", t), ("s2", "Hi", t)]
    return data, spark.createDataFrame(data, "capture_id string, title string, observed_ts timestamp")


def test_first_titles_batch(spark):
    data, df = title_rows(spark)
    got = {r["capture_id"] for r in st.first_titles_batch(df).collect()}
    want = plain_titles([(x[2], x[0], x[1]) for x in data if x[1] != "Hi"], timedelta(hours=6)) | {"s1", "s2"}
    assert got == want


def test_first_titles_stream(spark, tmp_path):
    data, df = title_rows(spark)
    df.orderBy("observed_ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = st.first_titles(stream).writeStream.format("memory").queryName("titles").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["capture_id"] for r in spark.sql("select capture_id from titles").collect()}
    want = plain_titles([(x[2], x[0], x[1]) for x in data if x[1] != "Hi"], timedelta(hours=6)) | {"s1", "s2"}
    assert got == want


def test_ladders():
    assert [st.next_cooldown(n) for n in (4, 5, 6, 9, 50)] == [0, 60, 300, 3600, 3600]
    assert [st.cadence(n) for n in (2, 3, 6, 11)] == [1, 3, 6, 12]


def test_titles_are_made_of_whole_texts(spark, tmp_path):
    """The registered query agrees with a plain model on texts far longer than a headline."""
    from tidewire.queries import QUERIES

    def model(text):
        low = re.sub(r"\s+[-|\u2013\u2014]\s+[^-|\u2013\u2014]{1,40}\Z", "", (text or "").strip().lower()).strip()
        plain = " ".join(re.sub(r"[^\w\s]+", " ", low).split())
        return "" if len(plain.replace(" ", "")) < 5 else plain

    texts = ["Markets rally, again! " * 30 + "- The Verge", "." * 100 + " letters come late", "x" * 70 + " - middle of it - " + "y" * 60, "Line one\nline two | Source", "Hi!", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["title"] for r in QUERIES["i7_titles"](spark, str(tmp_path)).collect()}
    assert got == {i: model(t) for i, t in enumerate(texts)}


def test_csv_guard_passes_whole_texts(spark, tmp_path):
    from tidewire.queries import QUERIES

    texts = ["=" + "sum(a1) " * 5000, "plain text " * 100, "@", "-\n" + "x" * 50, "\tä" + "y" * 30, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["cell_sha256"] for r in QUERIES["i26_csv_guard_whole"](spark, str(tmp_path)).collect()}
    cells = ["'" + t if t and t[0] in "=+-@\t\r" else t for t in texts]
    assert got == {i: None if c is None else hashlib.sha256(c.encode()).hexdigest() for i, c in enumerate(cells)}


@pytest.mark.parametrize("seed", range(3))
def test_catalog_admission_is_the_sequential_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice([None, *"abcdefgh"]), rng.choice([None, *"uvwxyz"])) for k in range(60)]
    names, urls, want = set(), set(), []
    for k, name, url in rows:
        if name not in names and url not in urls:
            names |= {name} - {None}
            urls |= {url} - {None}
            want.append(k)
    rng.shuffle(rows)
    got = lookup.admitted(spark.createDataFrame(rows, "pos long, name string, url string"), "pos", ["name", "url"])
    assert sorted(r["pos"] for r in got.collect()) == want
    assert lookup.admitted(got.limit(0), "pos", ["name", "url"]).count() == 0


def test_items_of_many_feeds_pass_in_small_batches(spark, monkeypatch):
    """What a task holds doesn't grow with the bodies of a batch or the items of a body."""
    import pyarrow as pa

    bodies = spark.createDataFrame([("b",)], "body string")
    made, real = [], type(bodies).mapInArrow
    monkeypatch.setattr(type(bodies), "mapInArrow", lambda self, run, *more: made.append(run) or real(self, run, *more))
    feeds.parse_xml_feed(bodies)
    item = "<item><title>T {}</title><link>https://a.example/{}</link></item>"
    feed = lambda a, n: "<rss>" + "".join(item.format(i, i) for i in range(a, a + n)) + "</rss>"
    batch = pa.RecordBatch.from_arrays([pa.array([*(feed(50 * k, 50) for k in range(50)), None, "<rss", feed(2500, 2600)], pa.string())], names=["body"])
    out = list(made[0](iter([batch])))
    assert max(b.num_rows for b in out) <= 1000
    assert [t for b in out for t in b.column("title").to_pylist()] == [f"T {i}" for i in range(5100)]


def test_equal_contents_are_enriched_once(spark, monkeypatch):
    """The costly part grows with distinct contents; ids, times and links of each capture stay its own."""
    rows = [(str(i), None if i % 4 == 0 else f"Apple beats {i % 4}", "Oil fell." if i % 3 else "", None if i % 5 == 0 else "reuters.com", "rss", f"u{i}") for i in range(240)]
    df = spark.createDataFrame(rows, "capture_id string, title string, text string, domain string, source_type string, url string")
    asked, real = [], en._enriched
    monkeypatch.setattr(en, "_enriched", lambda captures: asked.append(captures.count()) or real(captures))
    out = en.enrich(df)
    assert asked == [len({r[1:5] for r in rows})]
    plain = lambda d: sorted(map(repr, d.select(*(F.array_sort(F.map_entries(c)).alias(c) if c == "component_scores" else c for c in d.columns)).collect()))
    assert plain(out) == plain(real(df)) and out.schema.names == real(df).schema.names
