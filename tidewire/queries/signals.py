"""Queries for the signals over the records made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.plans import bursts, evaluate, mix, stories
from tidewire.queries.registry import query, table
from tidewire.sources.records import RECORDS_SQL, events_as_records

R = f"WITH {RECORDS_SQL}"
#: The anchor of K2: the first record's minute, floored to a multiple of 30 in its hour.
ANCHORED = f"""{R}, anchor AS (SELECT min(us) - min(us) % 3600000000 + ((min(us) // 60000000) % 60 - ((min(us) // 60000000) % 60) % 30) * 60000000 AS a FROM records),
placed AS (SELECT r.*, CAST((us - (us - a) % 1800000000) // 1000000 AS BIGINT) AS bucket FROM records r CROSS JOIN anchor)"""
Z = """CASE WHEN cnt >= 3 THEN m END AS mean, CASE WHEN cnt >= 3 THEN coalesce(s, 0.0) END AS std,
CASE WHEN cnt >= 3 THEN CASE WHEN coalesce(s, 0.0) <= 1e-12 THEN 0.0 ELSE ({v} - m) / s END END AS z"""


def frame(value: str, before: int, by: str = "") -> str:
    over = f"OVER ({by} ORDER BY bucket ROWS BETWEEN {before} PRECEDING AND 1 PRECEDING)"
    return f"count({value}) {over} AS cnt, avg({value}) {over} AS m, stddev_samp({value}) {over} AS s"


@query("k2_volume_anomalies", f"""{ANCHORED}, counts AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS observed FROM placed GROUP BY bucket),
w AS (SELECT *, {frame('observed', 12)} FROM counts), zs AS (SELECT bucket, observed, {Z.format(v='observed')} FROM w)
SELECT bucket, CAST(observed AS BIGINT) AS observed, mean, std, z, CASE WHEN abs(z) >= 4 THEN 'high' WHEN abs(z) >= 3 THEN 'medium' ELSE 'low' END AS severity FROM zs WHERE abs(z) >= 2""", "mean std z")
def k2_volume(spark, sf_dir):
    return bursts.volume_anomalies(events_as_records(spark, sf_dir))


@query("k2_sentiment_shocks", f"""{ANCHORED}, nets AS (SELECT bucket, (count(*) FILTER (sentiment_label = 'positive') - count(*) FILTER (sentiment_label = 'negative')) / CAST(count(sentiment_label) AS DOUBLE) AS net
  FROM placed GROUP BY bucket HAVING count(sentiment_label) > 0),
w AS (SELECT *, {frame('net', 12)} FROM nets), zs AS (SELECT bucket, net, {Z.format(v='net')} FROM w)
SELECT bucket, net, mean, std, z, CASE WHEN z > 0 AND net > 0.2 THEN 'bullish_shock' WHEN z < 0 AND net < -0.2 THEN 'bearish_shock' ELSE 'neutral' END AS direction FROM zs WHERE abs(z) >= 2""", "net mean std z")
def k2_shocks(spark, sf_dir):
    return bursts.sentiment_shocks(events_as_records(spark, sf_dir))


@query("k2_symbol_bursts", f"""{ANCHORED}, ords AS (SELECT bucket, row_number() OVER (ORDER BY bucket) - 1 AS i FROM (SELECT DISTINCT bucket FROM placed) AS d),
named AS (SELECT bucket, unnest(candidate_symbols) AS symbol FROM placed), counts AS (SELECT symbol, bucket, count(*) AS observed FROM named GROUP BY symbol, bucket),
w AS (SELECT c.symbol, c.bucket, c.observed, o.i, sum(c.observed) OVER (PARTITION BY c.symbol ORDER BY o.i RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING) AS past FROM counts c JOIN ords o ON c.bucket = o.bucket),
ms AS (SELECT symbol, bucket, observed, coalesce(past, 0) / CAST(least(i, 12) AS DOUBLE) AS mean FROM w WHERE i >= 3)
SELECT symbol, bucket, observed, mean, (observed - mean) / sqrt(greatest(1.0, mean)) AS z FROM ms WHERE observed >= 2 AND (observed - mean) / sqrt(greatest(1.0, mean)) >= 2""", "mean z")
def k2_bursts(spark, sf_dir):
    return bursts.symbol_bursts(events_as_records(spark, sf_dir), samples=False)


HOURLY = "CAST(us // 1000000 - (us // 1000000) % 3600 AS BIGINT)"
SHARES = f"""rb AS (SELECT *, {HOURLY} AS bucket FROM records),
spread AS (SELECT bucket, 'asset' AS kind, unnest(asset_classes) AS key, 1.0 / len(asset_classes) AS w FROM rb
  UNION ALL SELECT bucket, 'reason' AS kind, unnest(impact_reason_codes) AS key, 1.0 / len(impact_reason_codes) AS w FROM rb),
mass AS (SELECT bucket, kind, key, sum(CAST(w AS DOUBLE)) AS w FROM spread GROUP BY bucket, kind, key),
shares AS (SELECT bucket, kind, key, w / sum(w) OVER (PARTITION BY bucket, kind) AS share FROM mass)"""


@query("k3_regime_shifts", f"""{R}, {SHARES}, counts AS (SELECT bucket, count(*) AS n, avg(finance_relevance_score) AS mean_relevance FROM rb GROUP BY bucket),
steps AS (SELECT *, lag(bucket) OVER (ORDER BY bucket) AS before, lag(n) OVER (ORDER BY bucket) AS n_before FROM counts),
now AS (SELECT s.bucket, s.kind, s.key, s.share AS p FROM shares s JOIN steps t ON s.bucket = t.bucket WHERE t.before IS NOT NULL),
past AS (SELECT t.bucket, s.kind, s.key, s.share AS q FROM shares s JOIN steps t ON s.bucket = t.before),
pair AS (SELECT coalesce(a.bucket, b.bucket) AS bucket, coalesce(a.p, 0.001) AS p, coalesce(b.q, 0.001) AS q FROM now a FULL OUTER JOIN past b ON a.bucket = b.bucket AND a.kind = b.kind AND a.key = b.key),
kls AS (SELECT bucket, sum(p * ln(p / q)) / sum(p) + ln(sum(q) / sum(p)) AS kl FROM pair GROUP BY bucket)
SELECT s.bucket, s.n, s.mean_relevance, k.kl, coalesce(k.kl > 0.4 AND s.n >= 3 AND s.n_before >= 3, false) AS shift FROM steps s LEFT JOIN kls k ON s.bucket = k.bucket""", "mean_relevance kl")
def k3(spark, sf_dir):
    return mix.regime_shifts(events_as_records(spark, sf_dir))


@query("k3_label_shares", f"{R}, {SHARES} SELECT bucket, kind, key, share FROM shares", "share")
def k3_shares(spark, sf_dir):
    return mix.label_shares(events_as_records(spark, sf_dir))


@query("k4_sentiment_momentum", f"""{R}, anchor AS (SELECT min(us) AS a FROM records),
named AS (SELECT ((us - a) // 1000000) // 14400 AS slot, unnest(candidate_symbols) AS symbol, sentiment_label FROM records CROSS JOIN anchor),
cells AS (SELECT symbol, slot, count(*) AS n, count(*) FILTER (sentiment_label = 'positive') AS pos, count(*) FILTER (sentiment_label = 'negative') AS neg, count(sentiment_label) AS labelled FROM named GROUP BY symbol, slot),
nets AS (SELECT *, CASE WHEN labelled = 0 THEN 0.0 ELSE (pos - neg) / CAST(labelled AS DOUBLE) END AS net, row_number() OVER (PARTITION BY symbol ORDER BY slot) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS b FROM cells),
parts AS (SELECT *, i >= b // 2 AS later, i >= b - greatest(1, CAST(ceil(b * 0.25) AS BIGINT)) AS tailed FROM nets),
agg AS (SELECT symbol, CAST(sum(n) AS BIGINT) AS mentions, max(b) AS buckets, CASE WHEN sum(labelled) = 0 THEN 0.0 ELSE CAST(sum(pos) - sum(neg) AS DOUBLE) / CAST(sum(labelled) AS DOUBLE) END AS overall_net,
  avg(net) FILTER (NOT later) AS e, avg(net) FILTER (later) AS x, avg(net) FILTER (NOT tailed) AS h, avg(net) FILTER (tailed) AS t, arg_min(net, i) AS f, arg_max(net, i) AS z FROM parts GROUP BY symbol)
SELECT symbol, mentions, buckets, overall_net, CASE WHEN buckets = 1 THEN 0.0 ELSE greatest(-2.0, least(2.0, x - e)) END AS momentum,
  CASE WHEN buckets = 1 THEN 0.0 ELSE (z - f) / (buckets - 1) END AS velocity,
  CASE WHEN buckets = 1 THEN 'stable' WHEN e > 0.2 AND x < -0.2 THEN 'flipping_negative' WHEN e < -0.2 AND x > 0.2 THEN 'flipping_positive'
    WHEN x - e > 0.3 AND x > 0.2 THEN 'strengthening_positive' WHEN x - e < -0.3 AND x < -0.2 THEN 'strengthening_negative' ELSE 'stable' END AS direction,
  coalesce(buckets > 1 AND abs(h) > 1e-9 AND abs(t) > 1e-9 AND (h > 0) <> (t > 0), false) AS flip FROM agg WHERE mentions >= 4""", "overall_net momentum velocity")
def k4(spark, sf_dir):
    return mix.sentiment_momentum(events_as_records(spark, sf_dir))


PAIRS = "pairs AS (SELECT asset, unnest(reasons) AS reason, rel FROM (SELECT unnest(asset_classes) AS asset, impact_reason_codes AS reasons, finance_relevance_score AS rel FROM records) AS u)"


@query("k5_co_occurrence", f"""{R}, {PAIRS}, cells AS (SELECT asset, reason, count(*) AS n, avg(rel) AS mean_relevance FROM pairs GROUP BY asset, reason)
SELECT asset, reason, n, mean_relevance, n * CAST(sum(n) OVER () AS DOUBLE) / (CAST(sum(n) OVER (PARTITION BY asset) AS DOUBLE) * CAST(sum(n) OVER (PARTITION BY reason) AS DOUBLE)) AS lift FROM cells""", "mean_relevance lift")
def k5(spark, sf_dir):
    return mix.co_occurrence_cells(events_as_records(spark, sf_dir))


@query("k5_symbol_edges", f"""{R}, s AS (SELECT capture_id, unnest(candidate_symbols) AS a, candidate_symbols AS all_s FROM records), p AS (SELECT capture_id, a, unnest(all_s) AS b FROM s)
SELECT a, b, count(*) AS weight FROM p WHERE a < b GROUP BY a, b HAVING count(*) >= 2""")
def k5_edges(spark, sf_dir):
    return mix.co_occurrence_edges(events_as_records(spark, sf_dir), samples=False)


@query("k5_concentration", f"""{R}, {PAIRS}, cells AS (SELECT asset, reason, count(*) AS n FROM pairs GROUP BY asset, reason),
sh AS (SELECT asset, n / CAST(sum(n) OVER (PARTITION BY asset) AS DOUBLE) AS p FROM cells) SELECT asset, sum(p * p) AS hhi, count(*) AS reasons FROM sh GROUP BY asset""", "hhi")
def k5_hhi(spark, sf_dir):
    return mix.reason_concentration(events_as_records(spark, sf_dir))


GRID = f"""{R}, marks AS (SELECT DISTINCT capture_id, CAST(us // 1000000 - (us // 1000000) % 1800 AS BIGINT) AS bucket, unnest(asset_classes) AS asset FROM records),
counts AS (SELECT asset, bucket, count(*) AS n FROM marks GROUP BY asset, bucket), spine AS (SELECT unnest(range(lo, hi + 1, 1800)) AS bucket FROM (SELECT min(bucket) AS lo, max(bucket) AS hi FROM counts) AS e),
grid AS (SELECT a.asset, s.bucket, CAST(coalesce(c.n, 0) AS DOUBLE) AS observed FROM (SELECT DISTINCT asset FROM counts) AS a CROSS JOIN spine s LEFT JOIN counts c ON c.asset = a.asset AND c.bucket = s.bucket),
w AS (SELECT *, {frame('observed', 8, 'PARTITION BY asset')} FROM grid),
zs AS (SELECT asset, bucket, observed, {Z.format(v='observed')}, row_number() OVER (PARTITION BY asset ORDER BY bucket) - 1 AS i, count(*) OVER (PARTITION BY asset) AS b FROM w),
su AS (SELECT *, coalesce(z >= 1.5, false) AS surge FROM zs)"""


@query("k6_spillover", f"""{GRID}, el AS (SELECT * FROM su WHERE i >= least(3, b) AND i < b - 1), src AS (SELECT asset AS source, i FROM el WHERE surge),
ahead AS (SELECT asset AS target, i - 1 AS i, b FROM su WHERE surge), spans AS (SELECT asset AS source, count(*) AS eligible, count(*) FILTER (surge) AS source_surges FROM el GROUP BY asset),
base AS (SELECT target, count(*) AS target_surges FROM ahead WHERE i >= least(3, b) AND i < b - 1 GROUP BY target),
co_ AS (SELECT s.source, a.target, count(*) AS co FROM src s JOIN ahead a ON s.i = a.i GROUP BY s.source, a.target),
sc AS (SELECT o.source, o.target, o.co, p.source_surges, t.target_surges, p.eligible, greatest(-1.0, o.co / CAST(p.source_surges AS DOUBLE) - t.target_surges / CAST(p.eligible AS DOUBLE)) AS score FROM co_ o JOIN spans p ON o.source = p.source JOIN base t ON o.target = t.target)
SELECT * FROM sc WHERE score > 0 AND co >= 2""", "score")
def k6(spark, sf_dir):
    return bursts.spillover(events_as_records(spark, sf_dir))


@query("k7_symbol_correlation", f"""{R}, marks AS (SELECT {HOURLY} AS bucket, unnest(candidate_symbols) AS symbol FROM records), counts AS (SELECT symbol, bucket, CAST(count(*) AS DOUBLE) AS x FROM marks GROUP BY symbol, bucket),
e AS (SELECT (max(bucket) - min(bucket)) / 3600.0 + 1 AS n FROM counts), sums AS (SELECT symbol, sum(x) AS total, sum(x) AS sx, sum(x * x) AS sxx FROM counts GROUP BY symbol HAVING sum(x) >= 3),
prod AS (SELECT p.symbol AS a, q.symbol AS b, sum(p.x * q.x) AS sxy FROM counts p JOIN counts q ON p.bucket = q.bucket AND p.symbol < q.symbol GROUP BY p.symbol, q.symbol),
al AS (SELECT a.symbol AS a, b.symbol AS b, a.sx AS sa, a.sxx AS saa, b.sx AS sb, b.sxx AS sbb, a.total + b.total AS t FROM sums a JOIN sums b ON a.symbol < b.symbol)
SELECT l.a, l.b, greatest(-1.0, least(1.0, coalesce((e.n * coalesce(p.sxy, 0.0) - l.sa * l.sb) / nullif(sqrt(greatest((e.n * l.saa - l.sa * l.sa) * (e.n * l.sbb - l.sb * l.sb), 0.0)), 0.0), 0.0))) AS r, CAST(l.t AS BIGINT) AS mentions
FROM al l CROSS JOIN e LEFT JOIN prod p ON p.a = l.a AND p.b = l.b""", "r")
def k7(spark, sf_dir):
    return bursts.symbol_correlation(events_as_records(spark, sf_dir))


@query("k1_event_clusters")
def k1(spark, sf_dir):
    """Greedy and order-dependent: compared with a plain model in the tests."""
    return stories.cluster_records(events_as_records(spark, sf_dir), domains=2)


@query("k1_islands", f"""{R}, o AS (SELECT us, us - lag(us) OVER (ORDER BY us) > 1800000000 AS gap FROM records),
g AS (SELECT us, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT CAST(min(us) // 1800000000 AS BIGINT) AS island, count(*) AS n FROM g GROUP BY g""")
def k1_islands(spark, sf_dir):
    return stories.islands(events_as_records(spark, sf_dir)).groupBy("island").agg(F.count(F.lit(1)).alias("n"))


def windows_as_clusters(spark, sf_dir):
    """Stand-in clusters that SQL can make too: the records of one hour and first asset class."""
    rows = events_as_records(spark, sf_dir).withColumn("h", F.date_trunc("hour", "published_ts"))
    return rows.groupBy(F.date_format("h", "yyyyMMddHH").alias("hour"), F.get("asset_classes", 0).alias("a")).agg(F.collect_list("capture_id").alias("capture_ids")).select(F.concat_ws("|", "hour", "a").alias("cluster_id"), "capture_ids")


LEAD = f"""{R}, m AS (SELECT strftime(published_ts, '%Y%m%d%H') || '|' || asset_classes[1] AS cluster_id, domain, us, capture_id FROM records),
h AS (SELECT cluster_id, domain AS lead_domain, us AS lead_us FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY us, capture_id) AS rn FROM m) AS o WHERE rn = 1),
ev2 AS (SELECT m.cluster_id, m.domain, m.domain = h.lead_domain AS leader, CASE WHEN m.domain <> h.lead_domain THEN (min(m.us) - h.lead_us) // 1000000 END AS lag_s FROM m JOIN h ON m.cluster_id = h.cluster_id GROUP BY m.cluster_id, m.domain, h.lead_domain, h.lead_us)"""


@query("k8_lead_lag_events", f"{LEAD} SELECT cluster_id, domain, leader, CAST(lag_s AS BIGINT) AS lag_s FROM ev2")
def k8_events(spark, sf_dir):
    return stories.lead_lag_events(windows_as_clusters(spark, sf_dir), events_as_records(spark, sf_dir))


@query("k8_lead_lag_scores", f"""{LEAD}, g AS (SELECT cluster_id, min(lag_s) AS gap FROM ev2 GROUP BY cluster_id),
a AS (SELECT domain, count(*) AS participated, count(*) FILTER (leader) AS led, avg(lag_s) AS mean_lag, avg(gap) FILTER (leader) AS mean_lead FROM ev2 JOIN g ON ev2.cluster_id = g.cluster_id GROUP BY domain)
SELECT *, led / CAST(participated AS DOUBLE) AS lead_rate, 0.6 * (led / CAST(participated AS DOUBLE)) + 0.4 * least(1.0, log10(led + 1) / 2) AS composite FROM a""", "mean_lag mean_lead lead_rate composite")
def k8_scores(spark, sf_dir):
    return stories.lead_lag_scores(stories.lead_lag_events(windows_as_clusters(spark, sf_dir), events_as_records(spark, sf_dir)))


@query("k9_novelty")
def k9(spark, sf_dir):
    """The 200 newest records against all; set operations on whole arrays are compared with a plain model in the tests."""
    return stories.novelty(events_as_records(spark, sf_dir), 200).withColumn("novelty", F.round("novelty", 6))


AS_OF = 1_706_659_200_000_000


@query("k10_source_scorecards", f"""{R}, w AS (SELECT * FROM records WHERE us BETWEEN {AS_OF} - 30 * 86400000000 AND {AS_OF} + 86400000000),
b AS (SELECT domain, count(*) AS records, count(*) FILTER (is_finance_relevant) AS relevant, coalesce(avg(finance_relevance_score) FILTER (is_finance_relevant), 0.0) AS mean_relevance, count(*) FILTER (finance_relevance_score >= 0.7) AS high,
  count(*) FILTER (sentiment_label = 'positive') AS pos, count(*) FILTER (sentiment_label = 'negative') AS neg, count(sentiment_label) AS labelled FROM w GROUP BY domain HAVING count(*) >= 3),
en AS (SELECT domain, kind, CASE WHEN count(*) < 2 THEN 0.0 ELSE greatest(0.0, least(1.0, -sum(p * ln(p)) / ln(count(*)))) END AS h FROM (SELECT domain, kind, n / CAST(sum(n) OVER (PARTITION BY domain, kind) AS DOUBLE) AS p FROM
  (SELECT domain, kind, v, count(*) AS n FROM (SELECT domain, 'a' AS kind, unnest(asset_classes) AS v FROM w UNION ALL SELECT domain, 'r' AS kind, unnest(impact_reason_codes) AS v FROM w) AS x GROUP BY domain, kind, v) AS y) AS z GROUP BY domain, kind),
sy AS (SELECT DISTINCT domain, s FROM (SELECT domain, unnest(candidate_symbols) AS s FROM w) AS x), ho AS (SELECT s, count(*) AS homes FROM sy GROUP BY s),
un AS (SELECT sy.domain, count(*) FILTER (homes = 1) / CAST(count(*) AS DOUBLE) AS u FROM sy JOIN ho ON sy.s = ho.s GROUP BY sy.domain),
o AS (SELECT b.domain, b.records, b.relevant, b.relevant / CAST(b.records AS DOUBLE) AS relevant_rate, b.mean_relevance, b.high / CAST(b.records AS DOUBLE) AS density, CASE WHEN labelled = 0 THEN 0.0 ELSE (pos - neg) / CAST(labelled AS DOUBLE) END AS skew,
  coalesce(ea.h, 0.0) AS asset_diversity, coalesce(er.h, 0.0) AS reason_diversity, coalesce(un.u, 0.0) AS uniqueness FROM b LEFT JOIN en ea ON ea.domain = b.domain AND ea.kind = 'a' LEFT JOIN en er ON er.domain = b.domain AND er.kind = 'r' LEFT JOIN un ON un.domain = b.domain)
SELECT *, (relevant_rate + mean_relevance + density + abs(skew) + asset_diversity + reason_diversity + uniqueness) / 7 AS composite FROM o""", "relevant_rate mean_relevance density skew asset_diversity reason_diversity uniqueness composite")
def k10(spark, sf_dir):
    return stories.source_scorecards(events_as_records(spark, sf_dir), AS_OF)


@query("k11_dispersion", f"""{R}, c AS (SELECT scope, count(*) AS mentions, count(*) FILTER (l = 'positive') AS p, count(*) FILTER (l = 'neutral') AS n, count(*) FILTER (l = 'negative') AS g FROM (SELECT unnest(asset_classes) AS scope, sentiment_label AS l FROM records) AS x GROUP BY scope),
t AS (SELECT *, p + n + g AS sample_size, greatest(p, n, g) AS top FROM c),
e AS (SELECT *, CASE WHEN sample_size = 0 THEN 0.0 ELSE CASE WHEN p > 0 THEN -(p / CAST(sample_size AS DOUBLE)) * log2(p / CAST(sample_size AS DOUBLE)) ELSE 0.0 END + CASE WHEN n > 0 THEN -(n / CAST(sample_size AS DOUBLE)) * log2(n / CAST(sample_size AS DOUBLE)) ELSE 0.0 END
  + CASE WHEN g > 0 THEN -(g / CAST(sample_size AS DOUBLE)) * log2(g / CAST(sample_size AS DOUBLE)) ELSE 0.0 END END AS entropy FROM t)
SELECT scope, mentions, sample_size, entropy, entropy / log2(3.0) AS normalized, CASE WHEN sample_size = 0 OR (CASE WHEN p = top THEN 1 ELSE 0 END + CASE WHEN n = top THEN 1 ELSE 0 END + CASE WHEN g = top THEN 1 ELSE 0 END) > 1 THEN 'tied' WHEN p = top THEN 'positive' WHEN n = top THEN 'neutral' ELSE 'negative' END AS dominant FROM e""", "entropy normalized")
def k11(spark, sf_dir):
    return mix.dispersion(events_as_records(spark, sf_dir))


@query("k12_intensity", f"""{R} SELECT scope, count(*) AS n, avg(x) AS mean, max(x) AS max, count(*) FILTER (x > 0.5) AS high FROM (SELECT unnest(asset_classes) AS scope, finance_relevance_score * abs(sentiment_score) AS x FROM records) AS u GROUP BY scope""", "mean max")
def k12(spark, sf_dir):
    return mix.intensity(events_as_records(spark, sf_dir))


@query("k12_most_intense", f"{R} SELECT capture_id, finance_relevance_score * abs(sentiment_score) AS intensity FROM records ORDER BY intensity DESC, length(capture_id), capture_id LIMIT 5", "intensity")
def k12_top(spark, sf_dir):
    return mix.most_intense(events_as_records(spark, sf_dir))


#: January in New York is five hours behind UTC all through.
LOCAL = f"{R}, l AS (SELECT *, published_ts - INTERVAL 5 HOUR AS lt FROM records), m AS (SELECT *, hour(lt) * 60 + minute(lt) AS mins, (isodow(lt) - 1) AS wd FROM l)"


@query("k13_market_sessions", f"""{LOCAL}, s AS (SELECT *, CASE WHEN wd = 5 OR (wd = 6 AND mins < 1080) THEN 'weekend' WHEN mins < 240 THEN 'overnight' WHEN mins < 570 THEN 'pre_open' WHEN mins < 660 THEN 'open' WHEN mins < 840 THEN 'lunch' WHEN mins < 990 THEN 'close' WHEN mins < 1200 THEN 'after_hours' ELSE 'overnight' END AS session FROM m),
a AS (SELECT session, count(*) AS volume, avg(finance_relevance_score) AS avg_score, count(*) FILTER (finance_relevance_score >= 0.5) AS relevant FROM s GROUP BY session),
sp AS (SELECT unnest(['pre_open', 'open', 'lunch', 'close', 'after_hours', 'overnight', 'weekend']) AS session)
SELECT sp.session, coalesce(a.volume, 0) AS volume, coalesce(a.avg_score, 0.0) AS avg_score, coalesce(a.relevant, 0) AS relevant FROM sp LEFT JOIN a ON sp.session = a.session""", "avg_score")
def k13(spark, sf_dir):
    return mix.by_session(events_as_records(spark, sf_dir))


@query("k14_arrival_heatmap", f"""{LOCAL}, c AS (SELECT CAST(wd * 24 + hour(lt) AS INTEGER) AS cell, count(*) AS n FROM m GROUP BY 1), sp AS (SELECT CAST(unnest(range(0, 168)) AS INTEGER) AS cell)
SELECT CAST(sp.cell // 24 AS INTEGER) AS weekday, CAST(sp.cell % 24 AS INTEGER) AS hour, coalesce(c.n, 0) AS n FROM sp LEFT JOIN c ON sp.cell = c.cell""")
def k14(spark, sf_dir):
    return mix.arrival_heatmap(events_as_records(spark, sf_dir))


@query("k15_news_velocity", f"""{R}, t AS (SELECT max(us) AS top FROM records), c AS (SELECT (us // 1000000) - (us // 1000000) % 300 AS bucket, count(*) AS n FROM records CROSS JOIN t WHERE us >= top - 3600000000 GROUP BY 1),
e AS (SELECT ((top - 3600000000) // 1000000) - ((top - 3600000000) // 1000000) % 300 AS lo, (top // 1000000) - (top // 1000000) % 300 AS hi FROM t),
sp AS (SELECT unnest(range(lo, hi + 1, 300)) AS bucket FROM e), se AS (SELECT sp.bucket, coalesce(c.n, 0) / 5.0 AS rate FROM sp LEFT JOIN c ON sp.bucket = c.bucket),
w AS (SELECT bucket, CAST(rate AS DOUBLE) AS rate, row_number() OVER (ORDER BY bucket) AS i, count(*) OVER () AS n FROM se),
a AS (SELECT arg_max(rate, bucket) AS rate, sum(rate * CASE WHEN i = 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - i) END) AS ema_fast, sum(rate * CASE WHEN i = 1 THEN pow(0.95, n - 1) ELSE 0.05 * pow(0.95, n - i) END) AS ema_slow, median(rate) AS median, coalesce(stddev_samp(rate), 0.0) AS std, count(*) AS buckets FROM w),
z AS (SELECT *, CASE WHEN std <= 1e-12 THEN 0.0 ELSE (rate - median) / std END AS z FROM a) SELECT *, CASE WHEN z >= 2 THEN 'burst' WHEN z >= 1 THEN 'active' WHEN z <= -1 THEN 'quiet' ELSE 'calm' END AS regime FROM z""", "rate ema_fast ema_slow median std z")
def k15(spark, sf_dir):
    return bursts.news_velocity(events_as_records(spark, sf_dir))


@query("k16_persistence", f"""{R}, d AS (SELECT *, us // 86400000000 AS day FROM records), t AS (SELECT max(day) AS top FROM d),
n AS (SELECT unnest(asset_classes) AS asset, candidate_symbols[1] AS symbol, day FROM d CROSS JOIN t WHERE day > top - 7) SELECT asset, symbol, count(DISTINCT day) AS days, count(*) AS total, count(DISTINCT day) / 7.0 AS ratio FROM n GROUP BY asset, symbol HAVING count(*) >= 3""", "ratio")
def k16(spark, sf_dir):
    return mix.persistence(events_as_records(spark, sf_dir), samples=False)


QUOTES_SQL = "quotes AS (SELECT * FROM (VALUES ('SYM1', 10.5, 10.0, NULL), ('SYM2', 9.0, 10.0, NULL), ('SYM3', 5.0, 0.0, NULL), ('SYM4', 7.0, 7.5, 'stale'), ('SPY', 101.0, 100.0, NULL)) AS q(symbol, last, prev_close, error_code))"


def sample_quotes(spark):
    rows = [("SYM1", 10.5, 10.0, None), ("SYM2", 9.0, 10.0, None), ("SYM3", 5.0, 0.0, None), ("SYM4", 7.0, 7.5, "stale"), ("SPY", 101.0, 100.0, None)]
    return spark.createDataFrame(rows, "symbol string, last double, prev_close double, error_code string")


@query("k17_market_reaction", f"""{R}, {QUOTES_SQL}, p AS (SELECT symbol, CAST(last AS DOUBLE) AS last, CASE WHEN prev_close <> 0 THEN (last - prev_close) / CAST(prev_close AS DOUBLE) * 100 END AS pct, error_code FROM quotes),
o AS (SELECT r.capture_id, r.candidate_symbols[1] AS symbol, p.pct, coalesce(p.error_code, CASE WHEN p.last IS NULL THEN 'quote_unavailable' END) AS error FROM records r LEFT JOIN p ON p.symbol = r.candidate_symbols[1]),
b AS (SELECT max(pct) AS benchmark_pct FROM p WHERE symbol = 'SPY')
SELECT o.capture_id, o.symbol, h.horizon, CASE WHEN error IS NULL THEN pct END AS symbol_pct, benchmark_pct, CASE WHEN error IS NULL THEN pct END - benchmark_pct AS excess_pct, error FROM o CROSS JOIN b CROSS JOIN (SELECT unnest(['intraday', 'one_day']) AS horizon) AS h""", "symbol_pct benchmark_pct excess_pct")
def k17(spark, sf_dir):
    return evaluate.market_reaction(events_as_records(spark, sf_dir), sample_quotes(spark))


@query("k18_global_tone", f"""{R}, p AS (SELECT domain AS theme, CASE WHEN k % 7 <> 0 THEN us // 1000000 END AS date, (k % 21) - 10.0 + CAST(capture_id AS BIGINT) / 100000.0 AS value FROM records),
q AS (SELECT *, count(date) OVER (PARTITION BY theme) AS dated FROM p), u AS (SELECT *, date IS NOT NULL OR dated = 0 AS used FROM q),
o AS (SELECT theme, CAST(value AS DOUBLE) AS value, used, row_number() OVER (PARTITION BY theme ORDER BY used DESC, date, value) - 1 AS i, count(*) FILTER (used) OVER (PARTITION BY theme) AS m FROM u),
r AS (SELECT *, i >= m - least(greatest(1, CAST(round_even(m * 0.4, 0) AS BIGINT)), m - 1) AS late FROM o),
a AS (SELECT theme, arg_max(value, i) FILTER (used) AS latest, avg(value) AS mean, min(value) AS min, max(value) AS max, avg(value) FILTER (used AND late) AS l, avg(value) FILTER (used AND NOT late) AS e, sum(i * value) FILTER (used) AS sxy, sum(value) FILTER (used) AS sy, max(m) AS n_dated, count(*) AS n_points FROM r GROUP BY theme),
t AS (SELECT *, CASE WHEN n_dated >= 2 THEN l - e ELSE 0.0 END AS trend, CASE WHEN n_dated >= 2 THEN (sxy - (n_dated - 1) / 2.0 * sy) / (CAST(n_dated AS DOUBLE) * (CAST(n_dated AS DOUBLE) * n_dated - 1) / 12) ELSE 0.0 END AS slope FROM a)
SELECT theme, latest, mean, min, max, trend, slope, CASE WHEN trend > 0.5 THEN 'improving' WHEN trend < -0.5 THEN 'deteriorating' ELSE 'stable' END AS state, n_points, n_dated FROM t""", "latest mean min max trend slope")
def k18(spark, sf_dir):
    rows = events_as_records(spark, sf_dir)
    k = F.regexp_extract("title", r"k(\d+)$", 1).cast("long")
    points = rows.select(F.col("domain").alias("theme"), F.when(k % 7 != 0, F.unix_seconds(F.col("published_ts").cast("timestamp"))).alias("date"), ((k % 21) - 10.0 + F.col("capture_id").cast("long") / 100000.0).cast("double").alias("value"))
    return evaluate.tone_summary(points)


TERMS = ["SYM1", "sym2", "Sym1", "purchase", "SYM99", "k12"]
TERM_SQL = "terms AS (SELECT * FROM (VALUES ('SYM1'), ('sym2'), ('purchase'), ('SYM99'), ('k12')) AS t(term))"


def terms(spark):
    return spark.createDataFrame([(t,) for t in TERMS if t != "Sym1"], "term string")


@query("k19_coverage_gaps", f"""{R}, {TERM_SQL}, w AS (SELECT *, list_transform(candidate_symbols, lambda x: lower(x)) AS ls FROM records WHERE us >= {AS_OF} - 86400 * 1000000::BIGINT * 3),
m AS (SELECT term, count(*) AS matches, max(us) AS newest FROM w JOIN terms ON list_contains(ls, lower(term)) OR regexp_matches(lower(title), '(^|[^a-z0-9_])' || lower(term) || '([^a-z0-9_]|$)') GROUP BY term)
SELECT t.term, coalesce(m.matches, 0) AS matches, CAST(({AS_OF} - m.newest) // 1000000 AS BIGINT) AS age_s, m.newest IS NULL AS gap FROM terms t LEFT JOIN m ON t.term = m.term""")
def k19(spark, sf_dir):
    return evaluate.coverage_gaps(events_as_records(spark, sf_dir), terms(spark), AS_OF, 86_400 * 3)


@query("k20_portfolio", f"""{R}, {QUOTES_SQL}, h AS (SELECT * FROM (VALUES ('SYM1'), ('SYM2'), ('SYM4'), ('SYM99')) AS t(symbol)),
m AS (SELECT h.symbol, r.capture_id, r.finance_relevance_score AS s, r.sentiment_label AS l, row_number() OVER (PARTITION BY h.symbol ORDER BY r.finance_relevance_score DESC, length(r.capture_id), r.capture_id) AS rn FROM records r JOIN h ON list_contains(candidate_symbols, h.symbol) OR regexp_matches(lower(title), '(^|[^a-z0-9_])' || lower(h.symbol) || '([^a-z0-9_]|$)')),
a AS (SELECT symbol, count(*) AS mentions, max(l) FILTER (rn = 1) AS sentiment, max(capture_id) FILTER (rn = 1) AS first FROM m GROUP BY symbol)
SELECT h.symbol, coalesce(a.mentions, 0) AS mentions, a.first, a.sentiment, CASE WHEN q.error_code IS NULL AND q.prev_close <> 0 THEN (q.last - q.prev_close) / CAST(q.prev_close AS DOUBLE) END AS change FROM h LEFT JOIN a ON a.symbol = h.symbol LEFT JOIN quotes q ON q.symbol = h.symbol""", "change")
def k20(spark, sf_dir):
    holdings = spark.createDataFrame([("SYM1",), ("sym2",), ("SYM4",), ("SYM99",)], "symbol string")
    out = evaluate.portfolio(events_as_records(spark, sf_dir), holdings, sample_quotes(spark))
    return out.select("symbol", "mentions", F.get("top", 0).alias("first"), "sentiment", "change")
