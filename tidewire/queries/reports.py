"""Queries for the signals as they are reported: in order, cut at their top, with samples and a sentence each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.plans import bursts, dashboard, evaluate, mix, narratives, stories
from tidewire.queries.registry import SQL, query, table
from tidewire.queries.signals import ANCHORED, GRID, HOURLY, PAIRS, SHARES, R
from tidewire.sources.records import events_as_records

#: "rank" is the place in the report's order, so that the order itself is compared.
BURSTS = f"""{ANCHORED}, ords AS (SELECT bucket, row_number() OVER (ORDER BY bucket) - 1 AS i FROM (SELECT DISTINCT bucket FROM placed) AS d),
named AS (SELECT bucket, us, capture_id, unnest(candidate_symbols) AS symbol FROM placed), counts AS (SELECT symbol, bucket, count(*) AS observed FROM named GROUP BY symbol, bucket),
w AS (SELECT c.symbol, c.bucket, c.observed, o.i, sum(c.observed) OVER (PARTITION BY c.symbol ORDER BY o.i RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING) AS past FROM counts c JOIN ords o ON c.bucket = o.bucket),
ms AS (SELECT symbol, bucket, observed, coalesce(past, 0) / CAST(least(i, 12) AS DOUBLE) AS mean FROM w WHERE i >= 3),
zs AS (SELECT *, (observed - mean) / sqrt(greatest(1.0, mean)) AS z FROM ms WHERE observed >= 2),
best AS (SELECT *, CAST(row_number() OVER (ORDER BY round(z, 9) DESC, symbol, bucket) AS INTEGER) AS rank FROM zs WHERE z >= 2 QUALIFY rank <= 25),
firsts AS (SELECT n.symbol, n.bucket, n.capture_id, row_number() OVER (PARTITION BY n.symbol, n.bucket ORDER BY n.us, n.capture_id) AS k FROM named n JOIN best b ON n.symbol = b.symbol AND n.bucket = b.bucket),
samples AS (SELECT symbol, bucket, string_agg(capture_id, ',' ORDER BY k) AS samples FROM firsts WHERE k <= 3 GROUP BY symbol, bucket)"""


def placed(rows, order):
    """Number the rows of a report, which are few."""
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@query("k2_top_bursts", f"{BURSTS} SELECT b.rank, b.symbol, b.bucket, b.observed, b.mean, b.z, s.samples FROM best b JOIN samples s ON s.symbol = b.symbol AND s.bucket = b.bucket", "mean z")
def k2_top(spark, sf_dir):
    rows = bursts.symbol_bursts(events_as_records(spark, sf_dir), top=25)
    return placed(rows, [F.desc(F.round("z", 9)), "symbol", "bucket"]).withColumn("samples", F.array_join("samples", ","))


@query("i30_burst_text", f"{BURSTS} SELECT rank, printf('Symbol burst on %s: %d mentions, z-score %.1f.', symbol, observed, z) AS text FROM best")
def i30_burst(spark, sf_dir):
    rows = placed(bursts.symbol_bursts(events_as_records(spark, sf_dir), top=25, samples=False), [F.desc(F.round("z", 9)), "symbol", "bucket"])
    return rows.select("rank", narratives.burst_text(F.col("symbol"), F.col("observed"), F.col("z")).alias("text"))


@query("k3_top_labels", f"{R}, {SHARES} SELECT bucket, kind, key, share, CAST(row_number() OVER (PARTITION BY bucket, kind ORDER BY round(share, 9) DESC, key) AS INTEGER) AS rank FROM shares QUALIFY rank <= 6", "share")
def k3_top(spark, sf_dir):
    return mix.top_labels(events_as_records(spark, sf_dir))


@query("k3_sentiment_shares", f"""{R}, c AS (SELECT {HOURLY} AS bucket, count(*) FILTER (sentiment_label = 'positive') AS positive, count(*) FILTER (sentiment_label = 'neutral') AS neutral, count(*) FILTER (sentiment_label = 'negative') AS negative FROM records GROUP BY 1),
u AS (UNPIVOT c ON positive, neutral, negative INTO NAME label VALUE n) SELECT bucket, label, coalesce(n / nullif(CAST(sum(n) OVER (PARTITION BY bucket) AS DOUBLE), 0), 0.0) AS share FROM u""", "share")
def k3_sentiment(spark, sf_dir):
    return mix.sentiment_shares(events_as_records(spark, sf_dir))


@query("i30_shift_text", f"""{R}, {SHARES}, t AS (SELECT bucket, key, share, row_number() OVER (PARTITION BY bucket ORDER BY round(share, 9) DESC, key) AS k FROM shares WHERE kind = 'asset'),
x AS (SELECT bucket, string_agg(key || ' ' || CAST(CAST(round(share * 100) AS BIGINT) AS VARCHAR) || '%', ', ' ORDER BY k) AS shown FROM t WHERE k <= 2 GROUP BY bucket) SELECT bucket, 'Topic mix shifted at ' || CAST(bucket AS VARCHAR) || ' (KL=0.50); now dominated by ' || shown || '.' AS text FROM x""")
def i30_shift(spark, sf_dir):
    """The sentence for every hour's mix, with a stated divergence."""
    top = mix.top_labels(events_as_records(spark, sf_dir), top=2).filter("kind = 'asset'")
    own = top.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key", "share"))), lambda x: F.struct(x["key"].alias("key"), x["share"].alias("share"))).alias("assets"))
    return own.select("bucket", narratives.shift_text(F.col("bucket").cast("string"), F.lit(0.5), F.col("assets")).alias("text"))


MOMENTUM = SQL["k4_sentiment_momentum"]


@query("k4_top_tickers", f"SELECT *, CAST(row_number() OVER (ORDER BY abs(round(momentum, 6)) DESC, symbol) AS INTEGER) AS rank FROM ({MOMENTUM}) AS m QUALIFY rank <= 25")
def k4_top(spark, sf_dir):
    rows = mix.sentiment_momentum(events_as_records(spark, sf_dir), top=25)
    rows = rows.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("overall_net", "momentum", "velocity")})
    return placed(rows, [F.desc(F.abs("momentum")), "symbol"])


@query("k4_ticker_buckets", f"""{R}, anchor AS (SELECT min(us) AS a FROM records),
named AS (SELECT ((us - a) // 1000000) // 14400 AS slot, a, unnest(candidate_symbols) AS symbol, sentiment_label, sentiment_score FROM records CROSS JOIN anchor)
SELECT symbol, CAST(slot AS BIGINT) AS slot, count(*) AS n, count(*) FILTER (sentiment_label = 'positive') AS pos, count(*) FILTER (sentiment_label = 'negative') AS neg, count(sentiment_label) AS labelled, avg(sentiment_score) AS mean_score,
  CAST(max(a) + slot * 14400000000 AS BIGINT) AS start_us, coalesce((count(*) FILTER (sentiment_label = 'positive') - count(*) FILTER (sentiment_label = 'negative')) / nullif(CAST(count(sentiment_label) AS DOUBLE), 0), 0.0) AS net FROM named GROUP BY symbol, slot""", "mean_score net")
def k4_buckets(spark, sf_dir):
    return mix.momentum_cells(events_as_records(spark, sf_dir))


@query("k5_top_cells", f"""{R}, {PAIRS}, cells AS (SELECT asset, reason, count(*) AS n, avg(rel) AS mean_relevance FROM pairs GROUP BY asset, reason),
l AS (SELECT asset, reason, n, mean_relevance, n * CAST(sum(n) OVER () AS DOUBLE) / (CAST(sum(n) OVER (PARTITION BY asset) AS DOUBLE) * CAST(sum(n) OVER (PARTITION BY reason) AS DOUBLE)) AS lift FROM cells)
SELECT *, CAST(row_number() OVER (ORDER BY round(lift, 9) DESC, n DESC, asset, reason) AS INTEGER) AS rank FROM l QUALIFY rank <= 50""", "mean_relevance lift")
def k5_cells(spark, sf_dir):
    return placed(mix.top_cells(events_as_records(spark, sf_dir)), [F.desc(F.round("lift", 9)), F.desc("n"), "asset", "reason"])


@query("k5_top_edges", f"""{R}, s AS (SELECT capture_id, unnest(candidate_symbols) AS a, candidate_symbols AS all_s FROM records), p AS (SELECT * FROM (SELECT capture_id, a, unnest(all_s) AS b FROM s) AS x WHERE a < b),
e AS (SELECT a, b, count(*) AS weight FROM p GROUP BY a, b HAVING count(*) >= 2), t AS (SELECT *, CAST(row_number() OVER (ORDER BY weight DESC, a, b) AS INTEGER) AS rank FROM e QUALIFY rank <= 60),
f AS (SELECT p.a, p.b, p.capture_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY length(p.capture_id), p.capture_id) AS k FROM p JOIN t ON p.a = t.a AND p.b = t.b)
SELECT t.rank, t.a, t.b, t.weight, string_agg(f.capture_id, ',' ORDER BY f.k) AS samples FROM t JOIN f ON t.a = f.a AND t.b = f.b AND f.k <= 3 GROUP BY t.rank, t.a, t.b, t.weight""")
def k5_edges(spark, sf_dir):
    rows = placed(mix.co_occurrence_edges(events_as_records(spark, sf_dir), top=60), [F.desc("weight"), "a", "b"])
    return rows.withColumn("samples", F.array_join("samples", ","))


@query("k5_asset_reasons", f"""{R}, {PAIRS}, recs AS (SELECT asset, count(*) AS records FROM (SELECT unnest(asset_classes) AS asset FROM records) AS u GROUP BY asset),
cells AS (SELECT asset, reason, count(*) AS n FROM pairs GROUP BY asset, reason), sh AS (SELECT asset, reason, n / CAST(sum(n) OVER (PARTITION BY asset) AS DOUBLE) AS p FROM cells),
rk AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY round(p, 9) DESC, reason) AS k FROM sh),
g AS (SELECT asset, sum(p * p) AS hhi, count(*) AS reasons, string_agg(reason, ',' ORDER BY k) FILTER (k <= 5) AS top_reasons FROM rk GROUP BY asset)
SELECT r.asset, r.records, coalesce(g.reasons, 0) AS reasons, coalesce(g.hhi, 0.0) AS hhi, coalesce(g.top_reasons, '') AS top_reasons FROM recs r LEFT JOIN g ON r.asset = g.asset""", "hhi")
def k5_assets(spark, sf_dir):
    return mix.asset_concentration(events_as_records(spark, sf_dir)).withColumn("top_reasons", F.array_join("top_reasons", ","))


@query("k6_self_loops", f"""{GRID}, el AS (SELECT s.*, coalesce(t.surge, false) AS again FROM su s LEFT JOIN su t ON t.asset = s.asset AND t.i = s.i + 1 WHERE s.i >= least(3, s.b) AND s.i < s.b - 1),
a AS (SELECT asset, count(*) AS n, count(*) FILTER (surge) AS sources, count(*) FILTER (again) AS targets, count(*) FILTER (surge AND again) AS co FROM el GROUP BY asset),
p AS (SELECT asset, bucket, row_number() OVER (PARTITION BY asset ORDER BY bucket) AS k FROM el WHERE surge AND again), q AS (SELECT asset, string_agg(CAST(bucket AS VARCHAR), ',' ORDER BY k) AS pivots FROM p WHERE k <= 3 GROUP BY asset)
SELECT a.asset, co, sources - co AS source_only, targets - co AS target_only, greatest(-1.0, coalesce(co / nullif(CAST(sources AS DOUBLE), 0), 0.0) - targets / CAST(n AS DOUBLE)) AS score, coalesce(q.pivots, '') AS pivots FROM a LEFT JOIN q ON q.asset = a.asset""", "score")
def k6_loops(spark, sf_dir):
    return bursts.spillover_loops(events_as_records(spark, sf_dir)).withColumn("pivots", F.array_join(F.transform("pivots", lambda x: x.cast("string")), ","))


@query("i30_spillover_text", f"SELECT source, target, printf('Spillover detected: %s => %s (score %.2f).', source, target, score) AS text FROM ({SQL['k6_spillover']}) AS s")
def i30_spillover(spark, sf_dir):
    rows = bursts.spillover(events_as_records(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return rows.select("source", "target", narratives.spillover_text(F.col("source"), F.col("target"), F.col("score")).alias("text"))


@query("i30_anomaly_text", f"SELECT bucket, printf('Volume/sentiment anomaly: observed=%d, z-score %.1f.', observed, z) AS text FROM ({SQL['k2_volume_anomalies']}) AS s")
def i30_anomaly(spark, sf_dir):
    rows = bursts.volume_anomalies(events_as_records(spark, sf_dir)).withColumn("z", F.round("z", 6))
    return rows.select("bucket", narratives.anomaly_text(F.col("observed"), F.col("z")).alias("text"))


@query("k7_top_pairs", f"SELECT *, CAST(row_number() OVER (ORDER BY abs(r) DESC, mentions DESC, a, b) AS INTEGER) AS rank FROM ({SQL['k7_symbol_correlation']}) AS p QUALIFY rank <= 30")
def k7_top(spark, sf_dir):
    rows = bursts.top_correlations(events_as_records(spark, sf_dir)).withColumn("r", F.round("r", 6) + F.lit(0.0))
    return placed(rows, [F.desc(F.abs("r")), F.desc("mentions"), "a", "b"])


@query("k13_headline", f"""WITH s AS ({SQL['k13_market_sessions']}), o AS (SELECT *, list_position(['pre_open', 'open', 'lunch', 'close', 'after_hours', 'overnight', 'weekend'], session) AS p FROM s WHERE volume > 0)
SELECT (SELECT CAST(coalesce(sum(volume), 0) AS BIGINT) FROM s) AS total, (SELECT session FROM o ORDER BY avg_score DESC, p LIMIT 1) AS highest_score, (SELECT session FROM o ORDER BY volume DESC, p LIMIT 1) AS highest_volume""")
def k13_headline(spark, sf_dir):
    return mix.session_headline(events_as_records(spark, sf_dir))


@query("k14_peaks", f"""WITH h AS ({SQL['k14_arrival_heatmap']}), m AS (SELECT max(n) AS top, CAST(sum(n) AS BIGINT) AS total FROM h)
SELECT (SELECT top FROM m) AS max, (SELECT total FROM m) AS total, (SELECT coalesce(string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell), '') FROM (SELECT weekday * 24 + hour AS cell FROM h, m WHERE n = top AND top > 0 ORDER BY cell LIMIT 5) AS x) AS peaks""")
def k14_peaks(spark, sf_dir):
    return mix.heatmap_summary(events_as_records(spark, sf_dir)).withColumn("peaks", F.array_join(F.transform("peaks", lambda x: x.cast("string")), ","))


@query("k16_top", f"""{R}, d AS (SELECT *, us // 86400000000 AS day FROM records), t AS (SELECT max(day) AS top FROM d),
n AS (SELECT unnest(asset_classes) AS asset, candidate_symbols[1] AS symbol, day, us, capture_id, left(title, 100) AS title FROM d CROSS JOIN t WHERE day > top - 7),
g AS (SELECT asset, symbol, count(DISTINCT day) AS days, count(*) AS total, count(DISTINCT day) / 7.0 AS ratio FROM n GROUP BY asset, symbol HAVING count(*) >= 3),
b AS (SELECT *, CAST(row_number() OVER (ORDER BY ratio DESC, total DESC, asset, symbol) AS INTEGER) AS rank FROM g QUALIFY rank <= 20),
f AS (SELECT n.asset, n.symbol, n.title, row_number() OVER (PARTITION BY n.asset, n.symbol ORDER BY n.us, length(n.capture_id), n.capture_id) AS k FROM n JOIN b ON n.asset = b.asset AND n.symbol = b.symbol)
SELECT b.rank, b.asset, b.symbol, b.days, b.total, b.ratio, string_agg(f.title, ';' ORDER BY f.k) AS titles FROM b JOIN f ON f.asset = b.asset AND f.symbol = b.symbol AND f.k <= 3 GROUP BY ALL""", "ratio")
def k16_top(spark, sf_dir):
    rows = mix.persistence(events_as_records(spark, sf_dir), top=20)
    return placed(rows, [F.desc("ratio"), F.desc("total"), "asset", "symbol"]).withColumn("titles", F.array_join("titles", ";"))


@query("k18_overall_tone", f"""SELECT round(avg(latest), 4) AS tone, coalesce(avg(trend) FILTER (n_dated >= 2), 0.0) AS trend, count(*) AS themes,
CASE WHEN coalesce(avg(trend) FILTER (n_dated >= 2), 0.0) > 0.5 THEN 'improving' WHEN coalesce(avg(trend) FILTER (n_dated >= 2), 0.0) < -0.5 THEN 'deteriorating' ELSE 'stable' END AS state FROM ({SQL['k18_global_tone']}) AS t""", "trend")
def k18_overall(spark, sf_dir):
    from tidewire.queries.signals import k18

    return evaluate.overall_tone(k18(spark, sf_dir))


@query("k23_golden_summary", """WITH g AS (SELECT d.doc_id, [d.lang, coalesce(d.source, 'none')] AS es, [d.lang, CASE WHEN l.quality = 1 THEN 'book' ELSE 'web' END] AS ps, CASE WHEN l.toxic = 1 THEN 'negative' ELSE 'neutral' END AS el, CASE WHEN d.n_chars > 500 THEN 'neutral' ELSE 'negative' END AS pl FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT CAST(sum(len(list_intersect(es, ps))) AS DOUBLE) / CAST(sum(len(list_distinct(es))) AS DOUBLE) AS symbol_recall, count(*) FILTER (el = pl) / CAST(count(*) AS DOUBLE) AS sentiment_accuracy, CAST(sum(len(list_distinct(es))) AS BIGINT) AS expected, count(*) AS judged FROM g""", "symbol_recall sentiment_accuracy")
def k23_summary(spark, sf_dir):
    """Over the labelled documents, with lists and labels made from their columns on both sides."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.golden_summary(rows.select(
        F.array("lang", F.coalesce("source", F.lit("none"))).alias("expected_symbols"), F.array(F.col("lang"), F.when(F.col("quality") == 1, "book").otherwise("web")).alias("predicted_symbols"),
        F.when(F.col("toxic") == 1, "negative").otherwise("neutral").alias("expected_sentiment"), F.when(F.col("n_chars") > 500, "neutral").otherwise("negative").alias("predicted_sentiment"),
    ))


@query("i30_cluster_text")
def i30_cluster(spark, sf_dir):
    """A sentence for every event cluster; compared with a plain one in the tests."""
    rows = stories.cluster_records(events_as_records(spark, sf_dir), domains=2)
    return rows.select("cluster_id", narratives.cluster_text(F.col("size"), F.col("domains"), F.col("symbols"), F.col("reasons")).alias("text"))


@query("k25_live_text")
def k25_text(spark, sf_dir):
    context = dashboard.live_context(events_as_records(spark, sf_dir)).select(F.struct("*").alias("c"))
    return context.select(narratives.live_text(F.col("c")).alias("text"), dashboard.has_signal(F.col("c")).alias("has_signal"))


@query("k8_cluster_leaders")
def k8_clusters(spark, sf_dir):
    """Lead and lag over the event clusters themselves."""
    rows = events_as_records(spark, sf_dir)
    return stories.lead_lag_scores(stories.lead_lag_events(stories.cluster_records(rows, domains=2), rows))
