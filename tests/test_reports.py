"""Reports, sentences, models, uploads and fuzzy scores against plain versions."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.test_signals import frame, record
from tidewire import session
from tidewire.functions import fuzzy
from tidewire.operators import lookup
from tidewire.plans import bursts, dashboard, mix, models, narratives, stories
from tidewire.sources import captures, golden, uploads
from tidewire.streaming import pipeline as st


def crowd(seed=1, n=400, symbols=12, hours=60):
    """Records whose symbols come in bouts, so that some pairs share hours and others never do."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(symbols)
        minute = rng.choice([rng.uniform(0, hours * 60), s * 90 + rng.uniform(0, 120)])
        named = [f"S{s}"] + ([f"S{rng.randrange(symbols)}"] if rng.random() < 0.2 else [])
        rows.append(record(i, minute, title=f"title {s}", candidate_symbols=named, asset_classes=[rng.choice(["fx", "rates", "oil"])], impact_reason_codes=rng.sample(["a", "b", "c"], rng.randint(0, 2)),
                           sentiment_label=rng.choice(["positive", "negative", "neutral", None]), domain=f"d{s % 4}.example"))
    return rows


@pytest.mark.parametrize("symbols, top", [(12, 30), (40, 5), (3, 30)])
def test_top_correlations_are_the_top_of_all_pairs(spark, symbols, top):
    rows = frame(spark, crowd(symbols, 300, symbols, 400)).cache()
    every = [(r["a"], r["b"], round(r["r"], 9), r["mentions"]) for r in bursts.symbol_correlation(rows).collect()]
    want = sorted(every, key=lambda p: (-abs(p[2]), -p[3], p[0], p[1]))[:top]
    got = [(r["a"], r["b"], round(r["r"], 9), r["mentions"]) for r in bursts.top_correlations(rows, top=top).collect()]
    assert got == want


def test_samples_are_the_first_ones(spark):
    rows = crowd(3, 500, 4, 20)
    out = bursts.symbol_bursts(frame(spark, rows), threshold=0.1, top=25).collect()
    z = [round(r["z"], 9) for r in out]
    assert out and z == sorted(z, reverse=True)
    for r in out:
        own = sorted((x[3], x[0]) for x in rows if r["symbol"] in x[9] and r["bucket"] <= x[3].timestamp() - datetime(1970, 1, 1).timestamp() < r["bucket"] + 1800)
        assert r["samples"] == [i for _, i in own[:3]] and r["observed"] == len(own)
    edges = mix.co_occurrence_edges(frame(spark, rows + rows[:1]), least=1, top=3).collect()
    for e in edges:
        ids = sorted({x[0] for x in rows if {e["a"], e["b"]} <= set(x[9])}, key=lambda i: (len(i), i))
        assert e["samples"] == ids[:3]


def test_loops_and_concentration(spark):
    flood = [record(f"{b}-{i}", 30 * b, asset_classes=["fx"]) for b, n in enumerate([1, 2, 1, 2, 1, 9, 9, 1, 2, 1, 30, 30, 1]) for i in range(n)] + [record("o", 0, asset_classes=["oil"], impact_reason_codes=[])]
    out = {r["asset"]: r for r in bursts.spillover_loops(frame(spark, flood)).collect()}
    assert out["fx"]["co"] >= 1 and len(out["fx"]["pivots"]) == min(3, out["fx"]["co"]) and out["oil"]["co"] == 0 and set(out) == {"fx", "oil"}
    own = {r["asset"]: r for r in mix.asset_concentration(frame(spark, [record(1, asset_classes=["fx"], impact_reason_codes=["a", "b"]), record(2, asset_classes=["fx", "oil"], impact_reason_codes=[]), record(3, asset_classes=["fx"], impact_reason_codes=["a"])])).collect()}
    assert own["fx"]["hhi"] == pytest.approx(5 / 9) and own["fx"]["top_reasons"] == ["a", "b"] and own["oil"]["reasons"] == 0 and own["oil"]["hhi"] == 0.0 and own["oil"]["top_reasons"] == []


def test_empty_reports(spark):
    none = frame(spark, [])
    for report in (bursts.top_correlations, bursts.spillover_loops, mix.top_cells, mix.asset_concentration, mix.sentiment_shares):
        assert report(none).count() == 0
    assert mix.session_headline(none).first()[0] == 0 and mix.heatmap_summary(none).first()["peaks"] == []


def test_sentences(spark):
    one = spark.range(1)
    say = lambda c: one.select(c.alias("t")).first()["t"]
    words = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert say(narratives.cluster_text(F.lit(4), words("a", "b"), words("X", "Y", "Z", "W"), words("r1", "r2", "r3"))) == "Cluster of 4 captures across 2 sources — focused on X, Y, Z via r1, r2."
    assert say(narratives.cluster_text(F.lit(2), words("a"), words(), words())) == "Cluster of 2 captures across 1 sources."
    assets = F.array(F.struct(F.lit("fx").alias("key"), F.lit(0.625).alias("share")), F.struct(F.lit("oil").alias("key"), F.lit(0.375).alias("share")))
    assert say(narratives.shift_text(F.lit("10:00"), F.lit(0.517), assets)).startswith("Topic mix shifted at 10:00 (KL=0.52); now dominated by fx 6")
    assert say(narratives.spillover_text(F.lit("fx"), F.lit("oil"), F.lit(0.251))) == "Spillover detected: fx => oil (score 0.25)."


def test_live_read_of_a_busy_and_an_empty_corpus(spark):
    busy = dashboard.live_context(frame(spark, crowd())).select(F.struct("*").alias("c"))
    got = busy.select(narratives.live_text(F.col("c")).alias("t"), dashboard.has_signal(F.col("c")).alias("s"), "c").first()
    clusters = got["c"]["clusters"]
    assert got["s"] and got["t"].startswith(f"400 records in window across {clusters} active cluster") and len(got["c"]["tickers"]) == 5 and len(got["c"]["top_clusters"]) <= 3
    none = dashboard.live_context(frame(spark, [])).select(F.struct("*").alias("c")).select(narratives.live_text(F.col("c")).alias("t"), dashboard.has_signal(F.col("c")).alias("s")).first()
    assert tuple(none) == ("0 records in window across 0 active clusters. Anomaly flow is quiet — news mix is statistically normal.", False)


def test_dashboard_payload(spark):
    wanted = {k: dashboard.SIGNALS[k] for k in ("momentum", "regime_shifts", "leaderboard", "lead_lag")}
    shown = dashboard.snapshot(frame(spark, crowd()), wanted)
    rows = shown.collect()
    own = [json.loads(r["item"]) for r in rows if r["signal"] == "momentum"]
    strength = [abs(round(x["momentum"], 9)) for x in own]
    assert 0 < len(own) <= 25 and strength == sorted(strength, reverse=True) and {r["error"] for r in rows} == {None}
    assert {r["signal"] for r in rows} == set(wanted)
    assert {r["rows"] for r in dashboard.counts(shown).filter("signal = 'momentum'").collect()} == {len(own)}


def test_clusters_are_found_by_id_and_symbol(spark):
    found = stories.cluster_records(frame(spark, crowd()), domains=1)
    first = found.filter(F.size("symbols") > 0).first()
    assert lookup.search_clusters(found, first["cluster_id"][:12].upper()).count() >= 1
    assert first["cluster_id"] in {r["cluster_id"] for r in lookup.search_clusters(found, first["symbols"][0].lower()).collect()}


def plain_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_fuzzy_scores(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(rng.randint(0, n)))
    for _ in range(200):
        a, b = word(7), word(14)
        assert fuzzy.common_length(a, b) == plain_common(a, b)
        short, long = sorted((a, b), key=len)
        if short:
            parts = {long[i:j] for i in range(len(long) + 1) for j in range(i, len(long) + 1) if j - i == len(short) or (j - i < len(short) and (i == 0 or j == len(long)))}
            assert fuzzy.partial_ratio(a, b) == pytest.approx(max(200 * plain_common(short, p) / (len(short) + len(p)) for p in parts))
    assert fuzzy.token_set_ratio("apple beats forecasts", "forecasts apple") == 100.0 and fuzzy.token_set_ratio("", "x") == 0.0
    assert fuzzy.partial_ratio("microsft", "shares of microsoft fell") == 87.5 > fuzzy.partial_ratio("oracle", "shares of microsoft fell")
    out = spark.createDataFrame([("abc", "xabcx"), (None, "a")], "a string, b string").select(fuzzy.partial_ratio_of("a", "b").alias("s")).collect()
    assert [r["s"] for r in out] == [100.0, None]


def test_models_fall_back_and_reviewers_go_on(spark):
    class Count:
        version = "count/1"

        def predict(self, texts):
            return [len(t) for t in texts]

    def absent():
        raise OSError("no model")

    rows = frame(spark, [record(1, title="abc"), record(2, title=None), record(3, title="x", candidate_symbols=["ZZZ", "x y", "X"])])
    out = models.with_model(rows, absent, "title", "size", T.IntegerType(), Count).orderBy("capture_id").collect()
    assert [(r["size"], r["size_version"]) for r in out] == [(3, "count/1"), (0, "count/1"), (1, "count/1")]
    with pytest.raises(Exception, match="no model"):
        models.with_model(rows, absent, "title", "size", T.IntegerType()).collect()

    class Picky(models.EchoReviewer):
        def review(self, record):
            if record["capture_id"] == "2":
                raise ValueError("no title")
            return super().review(record)

    got = {r["capture_id"]: r for r in models.reviews(rows, Picky).collect()}
    assert got["2"]["error_code"] == "ValueError" and got["2"]["payload"] is None and got["1"]["payload"]["is_finance_relevant"] == "True"
    assert models.reranked(rows).filter("capture_id = 3").first()["candidate_symbols"] == ["x y", "X", "ZZZ"]


def test_uploads(spark, tmp_path):
    files = {
        "a.txt": b"First line that is long enough. Second.", "b.md": b"intro\n# Head line\nbody", "c.html": b"<title>t</title><script>var x</script><span>Ad</span><h1>The <b>Head</b><br>line</h1><p>One &amp; two</p><p>&#128512;</p>",
        "d.json": b'{"title": 5, "body": "words"}', "e.jsonl": b'{"text": "one."}\n\n{"body": "two"}\n[1]\n{"x": 1}', "f.json": b"[1]", "g.jsonl": b"{broken", "h.pdf": b"x", "j.html": b"<script>x</script>", "k.TXT": b"\xff bad bytes",
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    out = {r["path"].rsplit("/", 1)[1]: r for r in uploads.extracted(uploads.read_uploads(spark, str(tmp_path))).collect()}
    assert (out["a.txt"]["title"], out["b.md"]["title"], out["c.html"]["title"], out["d.json"]["title"]) == ("First line that is long enough.", "Head line", "The Headline", "5")
    assert out["c.html"]["text"].endswith("One & two\n\U0001f600") and "var" not in out["c.html"]["text"] and out["e.jsonl"]["text"] == "one.\n\ntwo" and out["d.json"]["text"] == "words"
    assert {n: out[n]["error"] for n in out if out[n]["error"]} == {"f.json": "no text", "g.jsonl": "invalid json", "h.pdf": "unsupported type", "j.html": "no text"}
    with pytest.raises(uploads.UploadError, match="empty"):
        uploads.extract("i.txt", b"")
    assert out["k.TXT"]["text"].endswith(" bad bytes")


def test_golden_reader_is_strict_or_lax(spark, tmp_path):
    good = {"capture_id": "1", "title": "t", "text": "x", "expected_finance_relevant": True, "expected_symbols": ["A"]}
    (tmp_path / "g.jsonl").write_text(json.dumps(good) + "\n\n{broken\n" + json.dumps({**good, "text": None}) + "\n")
    assert [r["expected_symbols"] for r in golden.read_golden(spark, str(tmp_path), strict=False).collect()] == [["A"]]
    with pytest.raises(Exception, match="golden item"):
        golden.read_golden(spark, str(tmp_path)).collect()


def test_first_titles_in_a_batch(spark):
    rng = random.Random(6)
    t0 = datetime(2024, 1, 1)
    rows = [(f"c{i:03d}", rng.choice(["A title that is long", "Another title of words", "ab"]), t0 + timedelta(minutes=rng.randrange(5000))) for i in range(300)]
    got = {r["capture_id"] for r in st.first_titles_batch(spark.createDataFrame(rows, "capture_id string, title string, observed_ts timestamp")).collect()}
    want, last = set(), {}
    for i, title, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if title == "ab" or title not in last or at - last[title] > timedelta(hours=6):
            want.add(i)
            last[title] = at
    assert got == want and len(want) < 300


def test_bad_captures_of_a_stream_are_kept_apart(spark, tmp_path):
    good = {"capture_id": "1", "doc_id": "d", "title": "Rates rise", "text": "The Federal Reserve raised rates.", "published_ts": "2024-01-01T00:00:00Z"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([json.dumps(good), "{broken", json.dumps({**good, "capture_id": "2", "text": None}), json.dumps({**good, "capture_id": "3"})]))
    for _ in range(2):  # the second run finds nothing new
        rows = captures.stream_captures(spark, str(tmp_path / "in"), keep_invalid=True)
        st.upsert_records(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint"), errors=str(tmp_path / "errors")).awaitTermination(120)
    assert {r["capture_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"1", "3"}
    bad = spark.read.parquet(str(tmp_path / "errors")).collect()
    got = {r["error"]: (r["capture_id"], r["payload_excerpt"]) for r in bad}
    assert len(bad) == 2 and got["not a capture in JSON"] == (None, "{broken")
    assert got["without text"][0] == "2" and json.loads(got["without text"][1])["title"] == "Rates rise"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_upper_median_of_counts(spark, seed):
    from tidewire.operators import aggregate

    rng = random.Random(seed)
    rows = [(rng.choice("abc"), rng.choice([None, *range(9)])) for _ in range(rng.choice([5, 50, 501]))]
    got = {r["k"]: r["upper_median"] for r in aggregate.upper_median(spark.createDataFrame(rows, "k string, v int"), "v", "k").collect()}
    want = {k: sorted(v for g, v in rows if g == k and v is not None) for k in {g for g, v in rows if v is not None}}
    assert got == {k: v[len(v) // 2] for k, v in want.items()}


def test_scratch_tables_go_with_their_maker(spark):
    kept = []

    def make():
        inner = session.materialize(spark.range(5), "inner-of-test")
        kept.append(inner.inputFiles()[0].rsplit("/", 1)[0])
        return inner.filter("id > 1")

    out = session.materialize_alone(spark, make, "outer-of-test")
    place = spark._jvm.org.apache.hadoop.fs.Path(kept[0])
    assert out.count() == 3 and not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())


def test_names_are_found_as_by_scoring_all():
    """The index loses no name that scoring every name with every text finds, and compares few."""
    from tidewire import lexicon

    names = list(lexicon.SYMBOLS)
    rng = random.Random(11)
    texts = []
    for _ in range(300):
        name = list(rng.choice(names))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            k = rng.randrange(len(name))
            name[k : k + rng.randint(0, 1)] = rng.choice(["", "", "x", "ee", name[k] * 2])
            name = name or ["q"]
        words = ["shares", "of", "rise", "as", "markets", "fall"]
        texts.append(" ".join([*rng.sample(words, rng.randint(0, 4)), "".join(name), *rng.sample(words, rng.randint(0, 4))]))
    for least in (92.0, 80.0):
        index = fuzzy.NameIndex(names, least)
        for text in [*texts, "", "a", "App", "Meta Platform"]:
            every = sorted(((i, fuzzy.partial_ratio(n, text)) for i, n in enumerate(names)), key=lambda x: (-x[1], x[0]))
            assert index.best(text, 3) == [x for x in every if x[1] >= least][:3], text
        assert least < 92 or index.compared < 0.1 * len(texts) * len(names)
