"""Queries for sources, sinks and the enrichment of captures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import lexicon
from tidewire.functions import text as tx
from tidewire.operators import lookup
from tidewire.plans import enrich as en
from tidewire.queries.registry import query, table
from tidewire.session import shared_dir
from tidewire.sources import captures as cap
from tidewire.sources import feeds, sinks
from tidewire.sources.records import RECORDS_SQL, events_as_records

R = f"WITH {RECORDS_SQL}"
# Our own sentences, from which captures are put together.
SENTENCES = [
    "The Federal Reserve raised rates as inflation stayed strong.", "Apple earnings beat forecasts and revenue growth was robust.", "Crude oil prices fell after a weak report from refiners.",
    "Bitcoin and ethereum rally while the dollar sinks.", "The court set a lawsuit hearing over fraud claims.", "A local recipe for soup won the village prize.",
    "The striker scored a goal and the match ended level.", "Gold and silver gain as bonds slump.", "Regulators warn of a probe into the merger deal.",
    "Payrolls and jobs numbers missed, a recession headwind.", "Shipping shortage hits the supply chain at the port.", "Subscribe to our newsletter for updates.",
]
SENT_SQL = "[" + ", ".join("'" + s + "'" for s in SENTENCES) + "]"
CAPS = f"""{R}, caps AS (SELECT capture_id, {SENT_SQL}[(k % 12) + 1] AS title, {SENT_SQL}[(user_id % 12) + 1] || ' ' || {SENT_SQL}[((k + user_id) % 12) + 1] AS text,
CASE WHEN user_id % 3 = 0 THEN 'reuters.com' WHEN user_id % 3 = 1 THEN 'espn.com' ELSE 'site.example' END AS domain, CASE WHEN k % 2 = 0 THEN 'rss' ELSE 'wire' END AS source_type FROM records)"""


def sample_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Enrichment costs far more than moving a row: a table of few files is dealt to all cores first.
    events = table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    line = lambda i: F.array(*map(F.lit, SENTENCES))[(i % 12).cast("int")]
    u, k = F.col("user_id"), F.col("k")
    return events.select(
        F.col("event_id").cast("string").alias("capture_id"), F.col("event_id").cast("string").alias("doc_id"), line(k).alias("title"), F.concat_ws(" ", line(u), line(k + u)).alias("text"),
        F.when(u % 3 == 0, "reuters.com").when(u % 3 == 1, "espn.com").otherwise("site.example").alias("domain"), F.when(k % 2 == 0, "rss").otherwise("wire").alias("source_type"),
        F.concat(F.lit("https://site.example/"), F.col("event_id").cast("string")).alias("url"), F.col("ts").cast("timestamp").alias("published_ts"),
    )


def _hit(text: str, word: str) -> str:
    """SQL for a whole-word hit; words with other characters match anywhere."""
    k = word.strip().lower()
    if not k.replace(" ", "").isalnum():
        return f"contains({text}, '{k}')"
    return f"regexp_matches({text}, '(^|[^a-z0-9]){k}([^a-z0-9]|$)')"


def _count(text: str, words: tuple[str, ...], always: bool = False) -> str:
    one = (lambda w: f"regexp_matches({text}, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')") if always else (lambda w: _hit(text, w))
    return " + ".join(f"CASE WHEN {one(w)} THEN 1 ELSE 0 END" for w in words)


@query("j1_prefilter", f"""{CAPS}, l AS (SELECT *, lower(trim(title) || chr(10) || substr(trim(text), 1, 800)) AS low FROM caps),
m AS (SELECT capture_id, low, {_count('low', lexicon.FINANCE_KEYWORDS)} AS matched, {_count('low', lexicon.HARD_NEGATIVE_KEYWORDS)} AS blocked, CASE domain WHEN 'reuters.com' THEN 0.95 WHEN 'espn.com' THEN 0.05 ELSE 0.45 END AS dp, CASE source_type WHEN 'rss' THEN 0.55 ELSE 0.40 END AS sp FROM l)
SELECT capture_id, matched, blocked, CAST(CASE WHEN blocked >= 2 AND matched = 0 AND dp < 0.3 THEN 0.05 WHEN length(low) < 80 THEN greatest(dp, 0.2) ELSE greatest(0.0, least(1.0, 0.45 * dp + 0.2 * sp + 0.35 * least(1.0, matched / 4.0))) END AS DOUBLE) AS rule_score, NOT (blocked >= 2 AND matched = 0 AND dp < 0.3) AS keep FROM m""", "rule_score")
def j1(spark, sf_dir):
    rows = en.prefilter(sample_captures(spark, sf_dir))
    return rows.select("capture_id", F.size("matched").alias("matched"), F.size("blocked").alias("blocked"), F.col("rule_score").cast("double").alias("rule_score"), "keep")


@query("j3_sentiment", f"""{CAPS}, l AS (SELECT capture_id, lower(title || ' ' || substr(text, 1, 3000)) AS low FROM caps), m AS (SELECT capture_id, {_count('low', lexicon.POSITIVE, True)} AS p, {_count('low', lexicon.NEGATIVE, True)} AS n FROM l)
SELECT capture_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment_label, CAST(CASE WHEN p = n THEN CASE WHEN p = 0 THEN 0.5 ELSE 0.55 END ELSE least(1.0, 0.5 + 0.1 * abs(p - n)) END AS DOUBLE) AS sentiment_score FROM m""", "sentiment_score")
def j3(spark, sf_dir):
    return en.sentiment(sample_captures(spark, sf_dir)).select("capture_id", "sentiment_label", F.col("sentiment_score").cast("double").alias("sentiment_score"))


@query("j2_label_scores")
def j2(spark, sf_dir):
    """Weighted alias counts; a plain model checks them in the tests."""
    return en.label_scores(sample_captures(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("j_enrich")
def j_all(spark, sf_dir):
    """The whole enrichment; golden captures check it in the tests."""
    out = en.enrich(sample_captures(spark, sf_dir))
    return out.select("capture_id", "is_finance_relevant", F.round("finance_relevance_score", 6).alias("finance_relevance_score"), "asset_classes", "impact_reason_codes", "candidate_symbols", "candidate_entities", "impact_horizons", "sentiment_label", "evidence_sentences", "reason_text")


@query("j12_horizons", f"""{R}, x AS (SELECT capture_id, list_has_any(impact_reason_codes, ['central_bank', 'earnings', 'guidance', 'cyber_outage', 'natural_disaster', 'fraud_governance', 'litigation', 'product_launch']) AS s,
list_has_any(impact_reason_codes, ['m_and_a', 'regulation', 'sanctions_trade', 'supply_chain', 'energy', 'metals']) AS w, list_has_any(impact_reason_codes, ['inflation', 'growth_recession', 'employment', 'esg_reputation', 'funding_liquidity', 'geopolitics']) AS t FROM records)
SELECT capture_id, array_to_string(list_filter([CASE WHEN s THEN 'intraday' END, CASE WHEN s THEN 'one_day' END, CASE WHEN w THEN 'one_week' END, CASE WHEN t THEN 'structural' END], lambda x: x IS NOT NULL), ',') AS horizons FROM x""")
def j12(spark, sf_dir):
    return events_as_records(spark, sf_dir).select("capture_id", F.array_join(en.horizons(F.col("impact_reason_codes")), ",").alias("horizons"))


@query("j15_channels", f"""{R}, rules AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{r}', '{c}')" for i, (a, r, c) in enumerate(lexicon.CHANNELS))}) AS t(i, asset, reason, channel))
SELECT DISTINCT capture_id, channel FROM records JOIN rules ON list_contains(asset_classes, asset) AND (reason = '*' OR list_contains(impact_reason_codes, reason))""")
def j15(spark, sf_dir):
    return events_as_records(spark, sf_dir).select("capture_id", F.explode(en.channels(F.col("asset_classes"), F.col("impact_reason_codes"))).alias("channel"))


@query("j4_embedding")
def j4(spark, sf_dir):
    """Signed hash vectors of documents; the tests check them against a plain model."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return en.hash_embedding(rows).select("doc_id", F.transform("vector", lambda x: F.round(x.cast("double"), 5)).alias("vector"))


@query("i5_sentences")
def i5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).alias("n"))


@query("i7_titles")
def i7(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normal_title(F.col("text")).alias("title"))


@query("a16_html_text")
def a16(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.plain_html(F.col("html")).alias("text"))


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a1_captures_round_trip", f"{CAPS} SELECT capture_id, title, text, domain, source_type FROM caps")
def a1(spark, sf_dir):
    path = _folder(spark, "captures")
    cap.write_captures(sample_captures(spark, sf_dir), path)
    return cap.read_captures(spark, path).select("capture_id", "title", "text", "domain", "source_type")


@query("a2_invalid_rows", f"{CAPS} SELECT count(*) AS n FROM caps WHERE CAST(capture_id AS BIGINT) % 4 <> 0")
def a2(spark, sf_dir):
    path = _folder(spark, "raw")
    rows = sample_captures(spark, sf_dir)
    broken = F.col("capture_id").cast("long") % 4 == 0
    line = F.when(broken, F.when(F.col("capture_id").cast("long") % 8 == 0, "{not json").otherwise('{"capture_id": "x"}')).otherwise(F.to_json(F.struct("capture_id", "doc_id", "title", "text")))
    rows.select(line.alias("value")).write.text(path)
    spark_rows = spark.read.option("pathGlobFilter", "*").text(path)
    parsed = spark_rows.select(F.from_json("value", "capture_id string, doc_id string, title string, text string").alias("x")).select("x.*")
    return cap._valid(parsed).agg(F.count(F.lit(1)).alias("n"))


BATCH = "SELECT CAST(k // 25 AS BIGINT) AS batch FROM (SELECT unnest(range(0, 10)) AS k) AS x"


def _bodies(rows: DataFrame, item, wrap) -> DataFrame:
    """Bodies of up to 50 items: ``item`` makes a row's JSON struct, ``wrap`` the body from the array of them."""
    return rows.groupBy(F.floor(F.col("event_id") / 50).alias("batch")).agg(wrap(F.collect_list(item)).alias("body"))


@query("a8_articles", "SELECT event_id // 50 AS batch, 'T ' || event_type || ' ' || event_id AS title, 'https://www.news' || (user_id % 7) || '.example/a/' || event_id AS url, 'news' || (user_id % 7) || '.example' AS domain FROM events")
def a8(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    item = F.struct(F.concat_ws("", F.lit("https://www.news"), F.col("user_id") % 7, F.lit(".example/a/"), "event_id").alias("url"), F.concat_ws(" ", F.lit("T"), "event_type", "event_id").alias("title"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"))
    return feeds.parse(_bodies(rows, item, lambda a: F.to_json(F.struct(a.alias("articles")))), "gdelt").select("batch", "title", "url", "domain")


@query("a10_listing", "SELECT event_id // 50 AS batch, 'P ' || event_id AS title, CASE WHEN user_id % 2 = 0 THEN 'body ' || event_type ELSE 'P ' || event_id END AS text, 'https://www.reddit.com/r/x/' || event_id AS url FROM events")
def a10(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    post = F.struct(F.concat_ws(" ", F.lit("P"), "event_id").alias("title"), F.concat(F.lit("/r/x/"), F.col("event_id").cast("string")).alias("permalink"), F.when(F.col("user_id") % 2 == 0, F.concat_ws(" ", F.lit("body"), "event_type")).otherwise("").alias("selftext"), F.lit(1.7e9).alias("created_utc"))
    return feeds.parse(_bodies(rows, F.struct(post.alias("data")), lambda a: F.to_json(F.struct(F.struct(a.alias("children")).alias("data")))), "reddit").select("batch", "title", "text", "url")


@query("a11_hits", "SELECT event_id // 50 AS batch, 'H ' || event_id AS title, CASE WHEN user_id % 3 = 0 THEN 'https://news.ycombinator.com/item?id=' || event_id ELSE 'https://www.site' || (user_id % 5) || '.example/' || event_id END AS url, CASE WHEN user_id % 3 = 0 THEN 'news.ycombinator.com' ELSE 'site' || (user_id % 5) || '.example' END AS domain FROM events")
def a11(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    own = F.concat_ws("", F.lit("https://www.site"), F.col("user_id") % 5, F.lit(".example/"), "event_id")
    hit = F.struct(F.when(F.col("user_id") % 2 == 0, F.concat_ws(" ", F.lit("H"), "event_id")).alias("title"), F.concat_ws(" ", F.lit("H"), "event_id").alias("story_title"), F.when(F.col("user_id") % 3 != 0, own).alias("url"), F.col("event_id").cast("string").alias("objectID"), F.lit(1_700_000_000).alias("created_at_i"))
    return feeds.parse(_bodies(rows, hit, lambda a: F.to_json(F.struct(a.alias("hits")))), "hn").select("batch", "title", "url", "domain")


@query("a7_rss", "SELECT event_id // 50 AS batch, 'R ' || event_id AS title, 'seen & told ' || event_type AS text, 'https://rss.example/' || event_id AS url, 'rss.example' AS domain, CAST(1700000000 + event_id AS BIGINT) AS published FROM events")
def a7(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    when = F.date_format(F.timestamp_seconds(1_700_000_000 + F.col("event_id")), "EEE, dd MMM yyyy HH:mm:ss")
    item = F.concat(F.lit("<item><title>R "), F.col("event_id").cast("string"), F.lit(" - Wire</title><link>https://rss.example/"), F.col("event_id").cast("string"), F.lit("</link><source url=\"https://w.example\">Wire</source><description>&lt;p&gt;seen &amp;amp; told&lt;/p&gt; "), F.col("event_type"), F.lit("</description><pubDate>"), when, F.lit(" +0000</pubDate></item>"))
    bodies = rows.groupBy(F.floor(F.col("event_id") / 50).alias("batch")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("body"))
    return feeds.parse(bodies, "rss").select("batch", "title", "text", "url", "domain", F.unix_seconds("published_ts").alias("published"))


@query("a13_push", "SELECT event_id, 'Push ' || event_type AS title, CASE WHEN user_id % 2 = 0 THEN 'https://www.push.example/' || event_id ELSE 'https://ws.local/ws/push-' || event_type END AS url, CASE WHEN user_id % 2 = 0 THEN 'push.example' ELSE 'ws.local' END AS domain FROM events")
def a13(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    inner = F.struct(F.concat_ws(" ", F.lit("<b>Push</b>"), "event_type").alias("headline"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("https://www.push.example/"), F.col("event_id").cast("string"))).alias("link"))
    return feeds.parse(rows.select("event_id", F.to_json(F.struct(inner.alias("payload"))).alias("body")), "push").select("event_id", "title", "url", "domain")


@query("a14_edits", "SELECT event_id, 'Wikipedia edit: Bank of ' || event_type AS title, 'https://en.wikipedia.org/wiki/Bank_of_' || event_type AS url FROM events WHERE user_id % 2 = 0 AND user_id % 3 <> 0")
def a14(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.when(F.col("user_id") % 3 == 0, F.lit("Garden")).otherwise(F.concat_ws(" ", F.lit("Bank of"), "event_type")).alias("title"), F.when(F.col("user_id") % 2 == 0, "enwiki").otherwise("dewiki").alias("wiki")))
    return feeds.parse_edits(rows.select("event_id", body.alias("body")), ["bank", "market"]).select("event_id", "title", "url")


@query("a17_feed_catalog", "WITH u AS (SELECT n_name AS name, 'u' || n_regionkey AS url, 0 AS part, n_nationkey AS o FROM nation UNION ALL SELECT r_name AS name, 'r' || r_regionkey AS url, 1 AS part, r_regionkey AS o FROM region), a AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY part, url) AS rn FROM u), b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY part, name) AS r2 FROM a WHERE rn = 1) SELECT name, url FROM b WHERE r2 = 1")
def a17(spark, sf_dir):
    one = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("u"), F.col("n_regionkey").cast("string")).alias("url"))
    two = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("url"))
    return lookup.first_wins([one, two], ["name", "url"])


@query("a17_catalog_admission", """WITH f AS (SELECT c_custkey AS pos, 'n' || CAST(c_custkey * 7919 % 401 AS VARCHAR) AS name, 'u' || CAST((c_custkey * 104729 + c_nationkey) % 397 AS VARCHAR) AS url FROM customer),
r AS (SELECT list_reduce(list({'names': [name], 'urls': [url]} ORDER BY pos), lambda a, b: CASE WHEN list_has_any(a.names, b.names) OR list_has_any(a.urls, b.urls) THEN a ELSE {'names': list_concat(a.names, b.names), 'urls': list_concat(a.urls, b.urls)} END) AS c FROM f)
SELECT unnest(c.names) AS name, unnest(c.urls) AS url FROM r""")
def a17_admission(spark, sf_dir):
    """Customers as feeds: a feed is taken if neither its name nor its URL is that of one taken before it."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(key.alias("pos"), F.concat(F.lit("n"), (key * 7919 % 401).cast("string")).alias("name"), F.concat(F.lit("u"), ((key * 104729 + F.col("c_nationkey")) % 397).cast("string")).alias("url"))
    return lookup.admitted(rows, "pos", ["name", "url"]).select("name", "url")


@query("a20_quotes", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 189.98 WHEN c_custkey % 3 = 1 THEN 370.6 END AS DOUBLE) AS last FROM customer", "last")
def a20(spark, sf_dir):
    from tidewire.plans.evaluate import QUOTES

    quotes = spark.createDataFrame(QUOTES, "symbol string, last double, prev_close double, error_code string")
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.upper(F.trim(F.when(F.col("c_custkey") % 3 == 0, " aapl ").when(F.col("c_custkey") % 3 == 1, "msft").otherwise("none"))).alias("symbol"))
    return asked.join(F.broadcast(quotes), "symbol", "left").select("c_custkey", "last")


@query("a21_chart_features")
def a21(spark, sf_dir):
    """Returns and yearly volatility of 21 closes, from array functions."""
    closes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("closes"))
    return chart_features(closes.filter(F.size("closes") >= 21)).select("o_custkey", F.round("ret_1d", 6).alias("ret_1d"), F.round("ret_5d", 6).alias("ret_5d"), F.round("vol", 6).alias("vol"))


def chart_features(rows: DataFrame) -> DataFrame:
    """Add ret_1d, ret_5d and the yearly volatility of the last 21 closes."""
    c = F.slice("closes", -21, 21)
    logs = F.zip_with(F.slice(c, 1, 20), F.slice(c, 2, 20), lambda a, b: F.log(b / a))
    mean = F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / 20
    var = F.aggregate(F.transform(logs, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / 19
    ret = lambda k: F.try_divide(c[20] - c[20 - k], c[20 - k])
    return rows.withColumns({"ret_1d": ret(1), "ret_5d": ret(5), "vol": F.sqrt(var) * F.sqrt(F.lit(252.0))})


@query("b1_upsert", f"{R} SELECT capture_id, CASE WHEN is_finance_relevant THEN 'new' ELSE domain END AS domain FROM records")
def b1(spark, sf_dir):
    rows = events_as_records(spark, sf_dir)
    keep = ["capture_id", "domain", "created_at"]
    path = _folder(spark, "upsert")
    sinks.overwrite_buckets(rows.select(*keep), path, ["capture_id"], buckets=8)
    sinks.overwrite_buckets(lookup.relevant_only(rows).withColumn("domain", F.lit("new")).select(*keep), path, ["capture_id"], buckets=8)
    return spark.read.parquet(path).select("capture_id", "domain")


@query("b3_parquet_rotation", f"{R} SELECT count(*) AS n, count(DISTINCT capture_id) AS ids FROM records")
def b3(spark, sf_dir):
    path = _folder(spark, "rotation")
    events_as_records(spark, sf_dir).write.option("maxRecordsPerFile", 5000).parquet(path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("capture_id").alias("ids"))


@query("b5_error_rows", f"{R} SELECT capture_id, 'bad' AS error, substr(title, 1, 10) AS payload_excerpt FROM records ORDER BY CAST(capture_id AS BIGINT) DESC LIMIT 20")
def b5(spark, sf_dir):
    rows = events_as_records(spark, sf_dir).withColumn("id", F.col("capture_id").cast("long"))
    return sinks.error_rows(sinks.newest_per_table(rows, 20), "title", "bad", 10)


@query("b9_archive", f"{R}, t AS (SELECT capture_id FROM records ORDER BY us DESC, capture_id DESC LIMIT 150) SELECT capture_id, title FROM records WHERE capture_id NOT IN (SELECT capture_id FROM t) AND NOT is_finance_relevant ORDER BY us, capture_id LIMIT 2000")
def b9(spark, sf_dir):
    rows = events_as_records(spark, sf_dir)
    done = lookup.relevant_only(rows)
    path = _folder(spark, "archive")
    sinks.write_archive(sinks.to_archive(rows, done), path)
    return spark.read.option("header", "true").option("escape", '"').csv(path).select("capture_id", "title")


@query("b10_csv_projection", f"{R} SELECT capture_id, domain, printf('%.3f', finance_relevance_score) AS score, CASE WHEN is_finance_relevant THEN '1' ELSE '0' END AS is_finance_relevant, array_to_string(asset_classes, ', ') AS asset_classes, coalesce(sentiment_label, '') AS sentiment_label FROM records")
def b10(spark, sf_dir):
    return sinks.csv_projection(events_as_records(spark, sf_dir)).select("capture_id", "domain", "score", "is_finance_relevant", "asset_classes", "sentiment_label")


@query("b11_export", f"{R} SELECT capture_id, array_to_string(asset_classes, ';') AS asset_classes, array_to_string(candidate_symbols, ';') AS candidate_symbols FROM records WHERE list_contains(asset_classes, 'fx') AND finance_relevance_score >= 0.5")
def b11(spark, sf_dir):
    rows = lookup.at_least(lookup.with_label(events_as_records(spark, sf_dir), "asset_classes", "fx"), 0.5)
    return sinks.export_csv_columns(rows).select("capture_id", "asset_classes", "candidate_symbols")


@query("b12_reviews_flat", f"{R} SELECT capture_id, is_finance_relevant AS payload_is_finance_relevant, array_to_string(asset_classes, ';') AS payload_asset_classes, CAST(CAST(capture_id AS BIGINT) % 900 AS INTEGER) AS input_tokens FROM records")
def b12(spark, sf_dir):
    from tidewire.queries.relational import reviews

    flat = sinks.flatten_reviews(reviews(spark, sf_dir).filter("reviewer_id = 'stub'"))
    return flat.select("capture_id", "payload_is_finance_relevant", "payload_asset_classes", "input_tokens")


@query("b13_json_snapshot")
def b13(spark, sf_dir):
    from tidewire.plans.mix import dispersion

    return sinks.as_json(dispersion(events_as_records(spark, sf_dir)).select("scope", "mentions"))


@query("b15_webhook_filter", f"{R} SELECT capture_id FROM records WHERE finance_relevance_score >= 0.7 AND list_has_any(asset_classes, ['crypto', 'macro'])")
def b15(spark, sf_dir):
    return sinks.wanted_by_hook(events_as_records(spark, sf_dir), 0.7, asset_classes=["crypto", "macro"]).select("capture_id")
