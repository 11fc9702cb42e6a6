"""Queries for the smaller sources, scalar functions and the extension surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text as tx
from tidewire.functions.register import register
from tidewire.functions.time import floor_to
from tidewire.plans import enrich as en
from tidewire.plans import evaluate, mix
from tidewire.queries.ingest import CAPS, _folder, sample_captures
from tidewire.queries.registry import query, table
from tidewire.sources import captures as cap
from tidewire.sources import feeds, sse
from tidewire.sources.records import RECORDS_SQL, events_as_records, timed

R = f"WITH {RECORDS_SQL}"


@query("a4_replay_limit", "SELECT 100 AS n")
def a4(spark, sf_dir):
    path = _folder(spark, "replay")
    cap.write_captures(sample_captures(spark, sf_dir), path)
    return cap.read_captures(spark, path, 100).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("a12_mirror_feed", "SELECT event_id, 'M ' || event_id AS title, 'https://x.com/u/status/' || event_id AS url, 'x.com' AS domain FROM events")
def a12(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    i = F.col("event_id").cast("string")
    body = F.concat(F.lit("<rss><channel><item><title>M "), i, F.lit("</title><link>https://nitter.example/u/status/"), i, F.lit("#m</link><description>d</description></item></channel></rss>"))
    return feeds.parse(rows.select("event_id", body.alias("body")), "twitter").select("event_id", "title", "url", "domain")


@query("a15_sse_frames", "SELECT user_id, 'one ' || event_type || chr(10) || 'two' AS data FROM events")
def a15(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    text = F.concat(F.lit(": hello\n\ndata: one "), F.col("event_type"), F.lit("\r\ndata:two\n\ndata: cut off"))
    return rows.select("user_id", F.explode(sse.frames(text)).alias("data"))


@query("a18_lookup", f"{R} SELECT capture_id, title FROM records WHERE capture_id = '42'")
def a18(spark, sf_dir):
    return events_as_records(spark, sf_dir).filter("capture_id = '42'").select("capture_id", "title")


@query("a22_tone_timeline", "SELECT user_id, d AS date, CAST(user_id % 7 - 3 AS DOUBLE) AS value FROM (SELECT DISTINCT user_id FROM events) AS e CROSS JOIN (SELECT unnest(['20240101T000000Z', '20240102T000000Z']) AS d) AS x", "value")
def a22(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    point = lambda d: F.struct(F.lit(d).alias("date"), (F.col("user_id") % 7 - 3).alias("value"))
    bodies = users.select("user_id", F.to_json(F.struct(F.array(F.struct(F.array(point("20240101T000000Z"), point("20240102T000000Z")).alias("data"))).alias("timeline"))).alias("body"))
    points = F.from_json("body", "timeline array<struct<data:array<struct<date:string,value:double>>>>")["timeline"][0]["data"]
    return bodies.select("user_id", F.inline(points))


@query("b8_holdings", "SELECT c_custkey AS id, upper(c_mktsegment) AS symbol, c_acctbal AS weight FROM customer WHERE c_acctbal > 0 AND c_custkey % 10 <> 0", "weight")
def b8(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.upper("c_mktsegment").alias("symbol"), F.col("c_acctbal").alias("weight"))
    return rows.join(rows.filter("id % 10 = 0").select("id"), "id", "left_anti")


@query("i1_keywords", f"{CAPS} SELECT capture_id, regexp_matches(lower(text), '(^|[^a-z0-9])rates([^a-z0-9]|$)') AS rates, contains(lower(text), '$') AS dollar FROM caps")
def i1(spark, sf_dir):
    low = F.lower("text")
    return sample_captures(spark, sf_dir).select("capture_id", tx.has_keyword(low, "rates").alias("rates"), tx.has_keyword(low, "$").alias("dollar"))


@query("i3_cashtags", "SELECT event_id, CAST(length(regexp_replace('x $' || upper(event_type) || ' $AB', '[^$]', '', 'g')) AS INTEGER) AS tags FROM events WHERE event_type <> 'purchase'")
def i3(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type <> 'purchase'")
    return rows.select("event_id", F.size(tx.cashtags(F.concat(F.lit("x $"), F.upper("event_type"), F.lit(" $AB")))).alias("tags"))


@query("i12_buckets", f"{R} SELECT capture_id, CAST(us // 1000000 - (us // 1000000) % 2700 AS BIGINT) AS bucket, CAST(1000 + ((us // 1000000 - 1000) // 2700) * 2700 AS BIGINT) AS anchored FROM records")
def i12(spark, sf_dir):
    s = F.floor(F.col("us") / 1_000_000)
    return timed(events_as_records(spark, sf_dir)).select("capture_id", floor_to(s, 2700).alias("bucket"), floor_to(s, 2700, 1000).alias("anchored"))


@query("i16_math", "SELECT event_id, 1 / (1 + exp(1 - value / 100)) AS sigmoid, least(1.0, log10(value + 1) / 2) AS depth, greatest(-1.0, least(1.0, value / 50 - 2)) AS clamped FROM events", "sigmoid depth clamped")
def i16(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", (1 / (1 + F.exp(1 - v / 100))).alias("sigmoid"), F.least(F.lit(1.0), F.log10(v + 1) / 2).alias("depth"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / 50 - 2)).alias("clamped"))


@query("i18_safe_float", "SELECT event_id, CASE WHEN user_id % 5 IN (0, 1, 2) THEN 0.0 ELSE value END AS x FROM events", "x")
def i18(spark, sf_dir):
    u = F.col("user_id") % 5
    raw = F.when(u == 0, F.lit(float("nan"))).when(u == 1, F.lit(float("inf"))).when(u == 2, F.lit(None).cast("double")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", mix.safe(raw).alias("x"))


@query("i20_capture_id", f"{CAPS} SELECT capture_id, 'c-' || substr(sha256('https://site.example/' || capture_id || chr(10) || text), 1, 32) AS id FROM caps")
def i20(spark, sf_dir):
    return sample_captures(spark, sf_dir).select("capture_id", en.capture_id(F.col("url"), F.col("text")).alias("id"))


@query("i22_cosine", "SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "score")
def i22(spark, sf_dir):
    from tidewire.functions.sets import cosine

    a = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", cosine(F.col("embedding"), F.col("other")).alias("score"))


@query("i24_json_lists", f"{R} SELECT capture_id, len(asset_classes) AS n FROM records")
def i24(spark, sf_dir):
    back = F.from_json(F.to_json("asset_classes"), "array<string>")
    return events_as_records(spark, sf_dir).select("capture_id", F.size(back).cast("long").alias("n"))


@query("i30_narratives", f"{R} SELECT capture_id, concat(array_to_string(asset_classes, '/'), ' | ', array_to_string(impact_reason_codes, '/'), ' | sentiment=', coalesce(sentiment_label, 'unknown')) AS reason_text FROM records")
def i30(spark, sf_dir):
    return events_as_records(spark, sf_dir).select("capture_id", F.concat(F.array_join("asset_classes", "/"), F.lit(" | "), F.array_join("impact_reason_codes", "/"), F.lit(" | sentiment="), F.coalesce("sentiment_label", F.lit("unknown"))).alias("reason_text"))


@query("d17_holdings_by_text", f"{R} SELECT 'SYM3' AS term, count(*) AS n FROM records WHERE list_contains(candidate_symbols, 'SYM3') OR regexp_matches(lower(title), '(^|[^a-z0-9_])sym3([^a-z0-9_]|$)')")
def d17(spark, sf_dir):
    terms = spark.createDataFrame([("SYM3",), ("sym3",)], "term string")
    return evaluate.mentions(events_as_records(spark, sf_dir), terms.limit(1)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("d23_alias_lookup", "SELECT 'oil' AS term, kind, label, count(*) AS n FROM events CROSS JOIN (VALUES ('asset', 'commodities'), ('reason', 'energy')) AS t(kind, label) WHERE user_id % 3 = 0 GROUP BY kind, label")
def d23(spark, sf_dir):
    """What the words of events are aliases of, and how often each is said."""
    from tidewire.taxonomy import aliases

    said = F.when(F.col("user_id") % 3 == 0, " OIL").when(F.col("user_id") % 3 == 1, "oily").otherwise(F.col("event_type"))
    words = table(spark, sf_dir, "events").select(F.lower(F.trim(said)).alias("term"))
    # The taxonomy is a fixed table.
    return words.join(F.broadcast(aliases(spark)), "term").groupBy("term", "kind", "label").agg(F.count(F.lit(1)).alias("n"))


@query("l7_sliding_windows", f"{R}, w AS (SELECT (us // 1000000 - (us // 1000000) % 900) - 900 * i AS start FROM records CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i) AS x) SELECT CAST(start AS BIGINT) AS start, count(*) AS n FROM w GROUP BY start")
def l7(spark, sf_dir):
    rows = timed(events_as_records(spark, sf_dir)).select(F.timestamp_micros("us").alias("at"))
    return rows.groupBy(F.window("at", "60 minutes", "15 minutes")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("window.start").alias("start"), "n")


@query("m7_sql_functions", f"{R} SELECT capture_id, len(list_intersect(asset_classes, ['rates', 'fx'])) / CAST(len(list_distinct(list_concat(asset_classes, ['rates', 'fx']))) AS DOUBLE) AS j, CASE WHEN finance_relevance_score * 5 >= 4 THEN 'high' WHEN finance_relevance_score * 5 >= 3 THEN 'medium' ELSE 'low' END AS s FROM records", "j")
def m7(spark, sf_dir):
    register(spark)
    rows = events_as_records(spark, sf_dir)
    return rows.selectExpr("capture_id", "tw_jaccard(asset_classes, array('rates', 'fx')) AS j", "tw_severity(finance_relevance_score * 5) AS s")


@query("m1_feed_table_function", "SELECT event_id, 'U ' || event_id AS title FROM events")
def m1(spark, sf_dir):
    register(spark)
    i = F.col("event_id").cast("string")
    body = F.concat(F.lit("<rss><item><title>U "), i, F.lit("</title><link>https://u.example/"), i, F.lit("</link></item></rss>"))
    bodies = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return spark.sql("SELECT b.event_id, f.title FROM {b} AS b, LATERAL tw_feed_items(b.body) AS f", b=bodies)


@query("j7_misspelt_names", """SELECT event_id, CASE user_id % 6 WHEN 0 THEN ['MSFT'] WHEN 1 THEN ['GS'] WHEN 2 THEN ['NFLX'] WHEN 3 THEN ['AMZN'] WHEN 4 THEN ['AAPL', 'QCOM'] ELSE CAST([] AS VARCHAR[]) END AS symbols FROM events""")
def j7_names(spark, sf_dir):
    """Event titles that name companies with a letter too few or too many, whole, and inside a longer word."""
    titles = ["Microsft", "Goldmann Sachs", "Netflx", "Amazon", "Qualcom and Apple", "Amazonian"]
    said = F.array(*map(F.lit, titles))[(F.col("user_id") % 6).cast("int")]
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(said, F.lit(" saw one more "), "event_type").alias("title"), F.lit("").alias("clean_text"))
    return en.with_symbols(rows).select("event_id", F.col("candidate_symbols").alias("symbols"))
