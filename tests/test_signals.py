"""Signals on small hand-made frames, and order-dependent ones against plain models."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.plans import bursts, dashboard, evaluate, mix, stories

T0 = datetime(2024, 1, 2, 10, 7, 30)
SCHEMA = (
    "capture_id string, title string, domain string, published_ts timestamp, created_at timestamp, is_finance_relevant boolean, finance_relevance_score double, "
    "asset_classes array<string>, impact_reason_codes array<string>, candidate_symbols array<string>, candidate_entities array<string>, sentiment_label string, sentiment_score double"
)


def record(i, minutes=0.0, **over):
    ts = T0 + timedelta(minutes=minutes)
    base = dict(capture_id=str(i), title="", domain="a.example", published_ts=ts, created_at=ts, is_finance_relevant=True, finance_relevance_score=0.5, asset_classes=[], impact_reason_codes=[],
                candidate_symbols=[], candidate_entities=[], sentiment_label=None, sentiment_score=0.5)
    return tuple((base | over).values())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_volume_spike_after_flat_and_varied_history(spark):
    counts = [2, 3, 2, 3, 2, 30]
    rows = [record(f"{b}-{i}", 30 * b + i * 0.1) for b, n in enumerate(counts) for i in range(n)]
    out = bursts.volume_anomalies(frame(spark, rows)).collect()
    assert [(r["observed"], r["severity"]) for r in out] == [(30, "high")]
    # The anchor is 10:00, not the first record's minute.
    assert out[0]["bucket"] % 1800 == 0
    flat = [record(f"{b}-{i}", 30 * b) for b in range(6) for i in range(3)]
    assert bursts.volume_anomalies(frame(spark, flat)).count() == 0


def test_missing_published_time_falls_back(spark):
    rows = [record(i, i) for i in range(3)] + [record(9, 3, published_ts=None)] + [record(10, 3, published_ts=None, created_at=None)]
    assert mix.timed(frame(spark, rows)).count() == 4


def test_unlabelled_buckets_are_not_history(spark):
    rows = [record(b, 30 * b, sentiment_label="neutral" if b != 2 else None) for b in range(4)] + [record(9, 120, sentiment_label="positive")]
    # Three labelled buckets before the last are flat: z is 0.
    assert bursts.sentiment_shocks(frame(spark, rows)).count() == 0


def test_kl_by_hand(spark):
    rows = [record(i, 0, asset_classes=["fx"], impact_reason_codes=["energy"]) for i in range(3)]
    rows += [record(10 + i, 60, asset_classes=["rates"], impact_reason_codes=["energy"]) for i in range(3)]
    out = {r["bucket"]: r for r in mix.regime_shifts(frame(spark, rows)).collect()}
    last = out[max(out)]
    total = 2 + 1e-3
    expected = sum(p / total * math.log(p / q) for p, q in ((1e-3, 1.0), (1.0, 1e-3), (1.0, 1.0)))
    assert last["kl"] == pytest.approx(expected) and last["shift"]


def test_momentum_flip(spark):
    marks = ["positive", "positive", "negative", "negative"]
    rows = [record(i, 240 * i, candidate_symbols=[" abc "], sentiment_label=x) for i, x in enumerate(marks)]
    row = mix.sentiment_momentum(frame(spark, rows)).first()
    assert (row["symbol"], row["momentum"], row["direction"], row["flip"]) == ("ABC", -2.0, "flipping_negative", True)
    single = [record(i, 0, candidate_symbols=["X"], sentiment_label="positive") for i in range(4)]
    row = mix.sentiment_momentum(frame(spark, single)).first()
    assert (row["momentum"], row["direction"], row["flip"]) == (0.0, "stable", False)


def test_uniform_lift_is_one(spark):
    rows = [record(f"{a}{r}", 0, asset_classes=[a], impact_reason_codes=[r]) for a in ("fx", "rates") for r in ("energy", "metals")]
    assert {r["lift"] for r in mix.co_occurrence_cells(frame(spark, rows)).collect()} == {1.0}


def test_spillover_follows_by_one_bucket(spark):
    base = [1, 2, 1, 3, 1, 2, 1, 2, 1, 3]
    series = {"fx": base + [20, 1, 2, 20, 1, 2], "rates": base + [1, 20, 2, 1, 20, 2]}
    rows = [record(f"{a}{b}{i}", 30 * b, asset_classes=[a]) for a, ns in series.items() for b, n in enumerate(ns) for i in range(n)]
    edges = {(r["source"], r["target"]) for r in bursts.spillover(frame(spark, rows)).collect()}
    assert ("fx", "rates") in edges and ("rates", "fx") not in edges


def test_correlation_signs_and_flat(spark):
    counts = {"A": [1, 5, 1, 5], "B": [2, 6, 2, 6], "C": [5, 1, 5, 1], "D": [1, 1, 1, 1]}
    rows = [record(f"{s}{b}{i}", 60 * b, candidate_symbols=[s]) for s, ns in counts.items() for b, n in enumerate(ns) for i in range(n)]
    r = {(x["a"], x["b"]): x["r"] for x in bursts.symbol_correlation(frame(spark, rows)).collect()}
    assert r["A", "B"] == pytest.approx(1) and r["A", "C"] == pytest.approx(-1) and r["A", "D"] == 0


def test_sessions_and_heatmap_are_dense_and_know_summer_time(spark):
    winter, summer = datetime(2024, 1, 8, 14, 45), datetime(2024, 7, 8, 13, 45)
    rows = [record(1, published_ts=winter), record(2, published_ts=summer), record(3, published_ts=datetime(2024, 1, 7, 22, 59)), record(4, published_ts=datetime(2024, 1, 7, 23, 0))]
    out = {r["session"]: r["volume"] for r in mix.by_session(frame(spark, rows)).collect()}
    assert len(out) == 7 and out["open"] == 2 and out["weekend"] == 1 and out["after_hours"] == 1
    cells = mix.arrival_heatmap(frame(spark, rows)).collect()
    assert len(cells) == 168 and sum(c["n"] for c in cells) == 4


def test_velocity_of_one_bucket(spark):
    row = bursts.news_velocity(frame(spark, [record(1, 0)])).first()
    assert row["buckets"] == 13 and row["rate"] == pytest.approx(0.2) and row["regime"] == "burst"


def test_nan_and_null_intensity(spark):
    rows = [record(1, asset_classes=["fx"], finance_relevance_score=float("nan")), record(2, asset_classes=["fx"], sentiment_score=None), record(3, asset_classes=["fx"], finance_relevance_score=1.0, sentiment_score=-0.8)]
    row = mix.intensity(frame(spark, rows)).first()
    assert (row["n"], row["max"], row["high"]) == (3, 0.8, 1)


def brute_clusters(rows, window_us, threshold):
    """Greedy clustering with nothing left out."""
    feats = [stories._features(r) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["us"] is None, rows[i]["us"] or 0, len(rows[i]["capture_id"]), rows[i]["capture_id"]))
    clusters = []
    for i in order:
        best, score = None, threshold
        for c in clusters:
            times = [rows[j]["us"] for j in c if rows[j]["us"] is not None]
            if rows[i]["us"] is not None and times and rows[i]["us"] - max(times) > window_us:
                continue
            own = max(stories.story_similarity(feats[j], feats[i]) for j in c)
            if own >= score:
                best, score = c, own
        if best is None:
            clusters.append([i])
        else:
            best.append(i)
    return {frozenset(rows[i]["capture_id"] for i in c) for c in clusters if len(c) > 1}


def test_coherence_of_many_is_the_mean_of_all_pairs():
    rng = random.Random(8)
    pick = lambda n: frozenset(f"v{rng.randint(0, n)}" for _ in range(rng.randint(0, 3)))
    feats = [tuple(pick(4) for _ in range(5)) for _ in range(40)]
    pairs = [stories.story_similarity(a, b) for k, a in enumerate(feats) for b in feats[k + 1 :]]
    assert stories.coherence(feats) == pytest.approx(sum(pairs) / len(pairs))


@pytest.mark.parametrize("nulls", [False, True])
def test_clusters_match_a_plain_model(spark, nulls):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        at = rng.choice([0, 10, 25, 200, 215, 600]) + rng.random() * 20
        rows.append(record(i, at, title=f"word{rng.randint(0, 4)} other{rng.randint(0, 3)}", candidate_symbols=[f"S{rng.randint(0, 5)}"], impact_reason_codes=[f"r{rng.randint(0, 3)}"], asset_classes=[f"a{rng.randint(0, 2)}"]))
    if nulls:
        rows += [record(500 + i, 0, published_ts=None, created_at=None, title="word1 other1", candidate_symbols=["S1"]) for i in range(3)]
    df = frame(spark, rows)
    got = {frozenset(r["capture_ids"]) for r in stories.cluster_records(df).collect()}
    placed = [r.asDict() for r in stories.islands(df).collect()]
    assert got == brute_clusters(placed, 1_800_000_000, 0.35)
    if not nulls:
        assert len({r["island"] for r in placed}) > 1


def test_novelty_against_a_plain_model(spark):
    rng = random.Random(4)
    rows = [record(i, i, title=" ".join(f"tok{rng.randint(0, 9)}" for _ in range(4)), candidate_symbols=[f"S{rng.randint(0, 3)}"], impact_reason_codes=["r"], asset_classes=[]) for i in range(40)]
    got = {r["capture_id"]: r for r in stories.novelty(frame(spark, rows), 10).collect()}

    def j(a, b):
        return len(a & b) / len(a | b) if a | b else 0.0

    feats = {r[0]: (set(r[1].split()), {s.lower() for s in r[9]}, set(r[8]), set(r[7])) for r in rows}
    assert set(got) == {str(i) for i in range(30, 40)}
    for k, r in got.items():
        best = max(sum(w * j(a, b) for w, a, b in zip(stories.NOVELTY_WEIGHTS, feats[k], f, strict=True)) for c, f in feats.items() if c != k)
        assert 1 - r["novelty"] == pytest.approx(best)


def test_lead_lag_leader_and_unresolved(spark):
    rows = [record("1", 0, domain="A.example"), record("2", 5, domain="b.example"), record("3", 9, domain="b.example"), record("4", 7, domain=None)]
    clusters = spark.createDataFrame([("c", ["1", "2", "3", "4", "missing"])], "cluster_id string, capture_ids array<string>")
    events = stories.lead_lag_events(clusters, frame(spark, rows))
    assert {(r["domain"], r["leader"], r["lag_s"]) for r in events.collect()} == {("a.example", True, None), ("b.example", False, 300), ("unknown", False, 420)}


def test_tone_of_dated_undated_and_single_points(spark):
    points = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.0), ("a", 3, 2.0), ("a", None, 9.0), ("b", None, 1.0)], "theme string, date long, value double")
    out = {r["theme"]: r for r in evaluate.tone_summary(points).collect()}
    assert out["a"]["latest"] == 2.0 and out["a"]["max"] == 9.0 and out["a"]["state"] == "improving" and out["a"]["n_dated"] == 3
    assert out["b"]["trend"] == 0.0 and out["b"]["slope"] == 0.0


def test_gaps_match_whole_words_only(spark):
    rows = [record(1, 0, title="Fedora released"), record(2, 1, title="The Fed moved", candidate_symbols=["F"])]
    terms = spark.createDataFrame([("fed",), ("F",), ("none",)], "term string")
    as_of = int((T0 + timedelta(minutes=2) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    out = {r["term"]: (r["matches"], r["gap"]) for r in evaluate.coverage_gaps(frame(spark, rows), terms, as_of).collect()}
    assert out == {"fed": (1, False), "F": (1, False), "none": (0, True)}


def test_dashboard_goes_on_after_a_failure(spark):
    def broken(_):
        raise ValueError("no")

    out = {r["signal"]: r["error"] for r in dashboard.snapshot(frame(spark, [record(1)]), {"bad": broken, "good": lambda r: r}).collect()}
    assert out == {"bad": "ValueError", "good": None}


def test_deviations_are_those_of_the_sql_to_the_last_bit(spark):
    """A z at its threshold decides by its last bit; repeated counts (three copies of a table) showed other surges than SQL."""
    import duckdb

    rng = random.Random(8)
    rows = [(asset, i * 1800, 3.0 * rng.randint(0, 9)) for asset in "ab" for i in range(200)]
    over = "OVER (PARTITION BY asset ORDER BY bucket ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"
    values = ", ".join(map(str, rows))
    want = duckdb.sql(f"SELECT asset, bucket, CASE WHEN count(x) {over} >= 3 THEN stddev_samp(x) {over} END FROM (VALUES {values}) AS t(asset, bucket, x)").fetchall()
    got = bursts.rolling_z(spark.createDataFrame(rows, "asset string, bucket long, x double"), "x", 8, by=["asset"]).select("asset", "bucket", "std").collect()
    assert sorted(map(tuple, got)) == [(a, b, s if s is None else float(s)) for a, b, s in sorted(want)]


def test_empty_input_gives_empty_signals(spark):
    empty = frame(spark, [])
    for signal in (bursts.volume_anomalies, bursts.symbol_bursts, bursts.spillover, bursts.symbol_correlation, bursts.news_velocity, mix.regime_shifts, mix.sentiment_momentum, mix.persistence, stories.cluster_records):
        assert signal(empty).count() == 0, signal
    assert mix.by_session(empty).agg(F.sum("volume")).first()[0] == 0


@pytest.mark.parametrize(("seed", "chunk", "span"), [(1, 40, 2), (2, 25, 3), (3, 60, 32)])
def test_clusters_of_one_great_island_in_parallel(spark, monkeypatch, seed, chunk, span):
    """Compared in chunks and spans, an island gives the clusters that one task gives, dying stories and ties included."""
    rng = random.Random(seed)
    rows, at = [], 0.0
    for i in range(400):
        at += rng.choice([0.0, 0.2, 2.0, 14.0])
        lists = {c: rng.sample([f"{c[0]}{k}" for k in range(5)], rng.randint(0, 2)) for c in ("candidate_symbols", "impact_reason_codes", "asset_classes", "candidate_entities")}
        rows.append(record(i, at, title=" ".join(f"w{rng.randint(0, 6)}" for _ in range(rng.randint(0, 3))), **lists))
    df = frame(spark, rows)
    placed = [r.asDict() for r in stories.islands(df).collect()]
    want = sorted(sorted(placed[i]["capture_id"] for i in m) for m in stories.assign_stories(placed, 1_800_000_000, 0.35) if len(m) > 1)
    assert len({r["island"] for r in placed}) == 1
    alone = sorted(sorted(r["capture_ids"]) for r in stories.cluster_records(df).collect())
    monkeypatch.setattr(stories, "ALONE_ROWS", 0)
    monkeypatch.setattr(stories, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(stories, "SPAN_CHUNKS", span)
    split = sorted(sorted(r["capture_ids"]) for r in stories.cluster_records(df).collect())
    assert alone == want and split == want


def test_repeated_features_of_a_great_island_are_compared_once(spark, monkeypatch):
    """What is compared and shipped grows with distinct features, not with rows; every column is that of one task."""
    rng = random.Random(4)
    kinds = [{c: rng.sample([f"{c[0]}{k}" for k in range(4)], rng.randint(0, 2)) for c in ("candidate_symbols", "impact_reason_codes", "asset_classes", "candidate_entities")} for _ in range(30)]
    at, rows = 0.0, []
    for i in range(600):
        at += rng.choice([0.0, 0.5, 9.0])
        own = rng.randrange(30)
        rows.append(record(i, at, title=f"w{own % 3} t{own}", domain=f"d{i % 3}.example", finance_relevance_score=rng.random(), **kinds[own]))
    df = frame(spark, rows)
    alone = sorted(map(tuple, stories.cluster_records(df, domains=2).collect()))
    monkeypatch.setattr(stories, "ALONE_ROWS", 0)
    monkeypatch.setattr(stories, "CHUNK_ROWS", 10)
    asked, real = [], stories.nearest_earlier
    monkeypatch.setattr(stories, "nearest_earlier", lambda rows, *more: asked.append(rows.count()) or real(rows, *more))
    split = sorted(map(tuple, stories.cluster_records(df, domains=2).collect()))
    assert asked == [30]
    assert [x[:-1] for x in split] == [x[:-1] for x in alone] and [x[-1] for x in split] == pytest.approx([x[-1] for x in alone])


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_runs_of_equal_features_are_followed_as_one(spark, monkeypatch, seed):
    """One task follows runs, not rows; features that others extend, too few to be near, and rows without a time included."""
    rng = random.Random(seed)
    kinds = [{"candidate_symbols": ["a"], "impact_reason_codes": ["r"]}, {"candidate_symbols": ["a"], "impact_reason_codes": ["r"], "candidate_entities": ["e"]}, {"candidate_symbols": ["a"]}]
    kinds += [{"impact_reason_codes": [f"r{k % 3}"], "title": f"w{k}"} for k in range(4)] + [{"asset_classes": ["x"]}, {}]
    kinds = kinds[: 3 if seed == 1 else None]
    at, rows = 0.0, []
    for i in range(500):
        at += rng.choice([0.0, 0.5, 3.0, 12.0])
        untimed = {"published_ts": None, "created_at": None} if seed == 4 and rng.random() < 0.1 else {}
        rows.append(record(i, at, domain=f"d{i % 3}.example", finance_relevance_score=rng.random(), **rng.choice(kinds), **untimed))
    df = frame(spark, rows)
    alone = sorted(map(tuple, stories.cluster_records(df, least=1).collect()))
    monkeypatch.setattr(stories, "ALONE_ROWS", 0)
    monkeypatch.setattr(stories, "CHUNK_ROWS", 3)
    followed, real = [], stories.placed_runs
    monkeypatch.setattr(stories, "placed_runs", lambda rows, *more: followed.append(rows.filter("place = run").count()) or real(rows, *more))
    split = sorted(map(tuple, stories.cluster_records(df, least=1).collect()))
    assert [x[:-1] for x in split] == [x[:-1] for x in alone] and [x[-1] for x in split] == pytest.approx([x[-1] for x in alone])
    assert followed[0] < 500


def test_long_stretches_of_equal_features_are_few_runs(spark, monkeypatch):
    rows = [record(i, i * 0.5 + (60 if i >= 200 else 0), title=f"w{i % 4} t{i % 4}", candidate_symbols=["s"], impact_reason_codes=[f"r{i % 4}"]) for i in range(400)]
    monkeypatch.setattr(stories, "ALONE_ROWS", 0)
    followed, real = [], stories.placed_runs
    monkeypatch.setattr(stories, "placed_runs", lambda rows, *more: followed.append(rows.filter("place = run").count()) or real(rows, *more))
    got = {r["size"] for r in stories.cluster_records(frame(spark, rows)).collect()}
    assert got == {200} and followed == [8]  # four features, before and after the pause


def test_novelty_compares_equal_features_once(spark, monkeypatch):
    rng = random.Random(5)
    rows = [record(i, i, title=f"word{i % 5} news", candidate_symbols=[f"s{i % 3}"], impact_reason_codes=["r"] if rng.random() < 0.5 else []) for i in range(300)]
    df = frame(spark, rows).repartition(3)
    seen, real = [], stories.least_of_equal
    monkeypatch.setattr(stories, "least_of_equal", lambda *a: seen.append(real(*a).count()) or real(*a))
    once = sorted(map(tuple, stories.novelty(df, 20).collect()))
    monkeypatch.setattr(stories, "least_of_equal", lambda rows, asked: rows)
    each = sorted(map(tuple, stories.novelty(df, 20).collect()))
    assert once == each and len(once) == 20 and seen[0] <= 30 + 20


def test_dashboard_items_do_not_pass_the_driver(spark):
    out = dashboard.snapshot(frame(spark, [record(i, i) for i in range(5)]), {"all": lambda r: r.orderBy("capture_id"), "none": lambda r: r.limit(0)})
    assert out.inputFiles()
    got = [(r["signal"], r["rank"], r["item"] and '"capture_id":"' in r["item"], r["error"]) for r in out.orderBy("signal", "rank").collect()]
    assert got == [("all", k, True, None) for k in range(1, 6)] + [("none", 0, None, None)]


def test_dashboard_ranks_clusters_without_ordering_their_members(spark):
    rows = [record(i, 100 * (i % 7) + i % 2, domain=f"d{i % 2}.example", candidate_symbols=[f"s{i % 7}"], title=f"t{i % 7}") for i in range(56)]
    df = frame(spark, rows)
    shown = dashboard.snapshot(df, {k: v for k, v in dashboard.sharing_clusters(dashboard.SIGNALS).items() if k == "clusters"})
    plainly = dashboard.snapshot(df, {"clusters": dashboard.SIGNALS["clusters"]})
    got, want = ([tuple(r) for r in x.orderBy("rank").collect()] for x in (shown, plainly))
    assert got == want and len(got) == 7
    ranked = dashboard.ranked_clusters(dashboard.ordered_clusters(df).withColumn(dashboard.NUMBER, F.monotonically_increasing_id()), 3)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Sort" in line and "capture_ids" in line for line in plan.splitlines()) and ranked.count() == 3
