"""Queries for filters, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import text as tx
from tidewire.functions.sets import cosine, jaccard
from tidewire.operators import aggregate, lookup
from tidewire.plans import evaluate
from tidewire.queries.registry import query, table
from tidewire.sources.records import RECORDS_SQL, events_as_records

R = f"WITH {RECORDS_SQL}"
AS_OF = 1_706_659_200_000_000
DAY = 86_400_000_000
SUMMARY = "capture_id, title, domain, finance_relevance_score"


def rec(spark, sf_dir):
    return events_as_records(spark, sf_dir)


@query("c1_relevant_only", f"{R} SELECT {SUMMARY} FROM records WHERE is_finance_relevant", "finance_relevance_score")
def c1(spark, sf_dir):
    return lookup.relevant_only(rec(spark, sf_dir)).select(*SUMMARY.split(", "))


@query("c2_label_membership", f"{R} SELECT capture_id FROM records WHERE list_contains(asset_classes, 'rates')")
def c2(spark, sf_dir):
    return lookup.with_label(rec(spark, sf_dir), "asset_classes", "rates").select("capture_id")


@query("c3_min_score", f"{R} SELECT capture_id, finance_relevance_score FROM records WHERE coalesce(finance_relevance_score, 0) >= 0.8", "finance_relevance_score")
def c3(spark, sf_dir):
    return lookup.at_least(rec(spark, sf_dir), 0.8).select("capture_id", "finance_relevance_score")


@query("c4_search", f"{R} SELECT capture_id, title, domain FROM records WHERE contains(lower(title), 'sym1') OR contains(lower(domain), 'sym1') OR len(list_filter(candidate_symbols, lambda s: contains(lower(s), 'sym1'))) > 0")
def c4(spark, sf_dir):
    return lookup.search(rec(spark, sf_dir), "Sym1").select("capture_id", "title", "domain")


@query("c4_part_search", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'a') AND p_size >= 40")
def c4_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.contains(F.lower("p_name"), F.lit("a")) & (F.col("p_size") >= 40)).select("p_partkey", "p_name", "p_brand")


@query("c5_summary", f"{R} SELECT capture_id, title, domain, is_finance_relevant, finance_relevance_score, sentiment_label, sentiment_score, len(candidate_symbols) AS symbols FROM records", "finance_relevance_score sentiment_score")
def c5(spark, sf_dir):
    return lookup.summary(rec(spark, sf_dir)).select("capture_id", "title", "domain", "is_finance_relevant", "finance_relevance_score", "sentiment_label", "sentiment_score", F.size("candidate_symbols").cast("long").alias("symbols"))


@query("c6_redaction", f"{R} SELECT capture_id, CAST(NULL AS VARCHAR) AS diagnostic_multimodal_result FROM records")
def c6(spark, sf_dir):
    return lookup.redact(rec(spark, sf_dir).withColumn("diagnostic_multimodal_result", F.lit("{}")), True).select("capture_id", "diagnostic_multimodal_result")


@query("c7_since_newest", f"{R} SELECT capture_id, us FROM records WHERE us >= (SELECT max(us) FROM records) - 86400000000")
def c7(spark, sf_dir):
    return lookup.since_newest(rec(spark, sf_dir), 86_400).select("capture_id", "us")


@query("c8_wall_clock_window", f"{R} SELECT capture_id, us FROM records WHERE us BETWEEN {AS_OF} - 7 * {DAY} AND {AS_OF} + {DAY}")
def c8(spark, sf_dir):
    return lookup.between(rec(spark, sf_dir), AS_OF, 7).select("capture_id", "us")


@query("c9_age_window", f"{R} SELECT capture_id FROM records WHERE us >= {AS_OF} - 3600 * 36 * 1000000::BIGINT")
def c9(spark, sf_dir):
    return lookup.not_older(rec(spark, sf_dir), AS_OF, 3600 * 36).select("capture_id")


@query("c10_staleness", f"{R} SELECT count(*) AS n FROM records WHERE us >= {AS_OF} - 14 * {DAY}")
def c10(spark, sf_dir):
    return lookup.not_older(rec(spark, sf_dir), AS_OF, 14 * 86_400).agg(F.count(F.lit(1)).alias("n"))


@query("c11_any_of", f"{R} SELECT capture_id FROM records WHERE list_has_any(asset_classes, ['fx', 'rates']) AND list_has_any(candidate_symbols, ['SYM1', 'SYM2', 'SYM3'])")
def c11(spark, sf_dir):
    return lookup.any_of(rec(spark, sf_dir), asset_classes=["fx", "rates"], candidate_symbols=["SYM1", "SYM2", "SYM3"]).select("capture_id")


@query("c12_hash_sample", f"{R} SELECT capture_id FROM records WHERE CAST('0x' || substr(sha256(capture_id), 1, 8) AS BIGINT) % 10000 < 1000")
def c12(spark, sf_dir):
    return rec(spark, sf_dir).filter(tx.sampled(F.col("capture_id"), 0.1)).select("capture_id")


LADDER = [("regulator", ["src1.example", "src2.example"]), ("crypto", ["src3.example"])]


@query("c13_category", f"{R} SELECT capture_id, CASE WHEN domain IN ('src1.example', 'src2.example') THEN 'regulator' WHEN domain = 'src3.example' THEN 'crypto' ELSE 'wire' END AS category FROM records")
def c13(spark, sf_dir):
    return rec(spark, sf_dir).select("capture_id", lookup.category(F.col("domain"), LADDER, "wire").alias("category"))


@query("c14_drill_down", f"{R} SELECT capture_id FROM records WHERE list_contains(asset_classes, 'credit') AND list_contains(impact_reason_codes, 'energy') ORDER BY us DESC, length(capture_id) DESC, capture_id DESC LIMIT 50")
def c14(spark, sf_dir):
    rows = lookup.with_label(lookup.with_label(rec(spark, sf_dir), "asset_classes", "credit"), "impact_reason_codes", "energy")
    return lookup.newest(rows, 50).select("capture_id")


@query("c15_sanitizers", "SELECT c_custkey, CASE WHEN regexp_full_match(c_name, '[A-Za-z0-9#_.-]{1,50}') THEN c_name END AS tag, regexp_full_match(c_mktsegment, '[A-Z.]{1,8}') AS ticker FROM customer")
def c15(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(name.rlike(r"^[A-Za-z0-9#_.\-]{1,50}$"), name).alias("tag"), tx.equity_shaped(F.col("c_mktsegment")).alias("ticker"))


@query("d1_by_label", f"{R} SELECT capture_id, title FROM records WHERE list_contains(candidate_symbols, 'SYM7') ORDER BY us DESC, length(capture_id) DESC, capture_id DESC LIMIT 100")
def d1(spark, sf_dir):
    rows = rec(spark, sf_dir)
    return lookup.by_label(rows, lookup.label_index(rows), "symbol", "SYM7", 100).select("capture_id", "title")


@query("b2_label_index", f"{R} SELECT capture_id, kind, value FROM (SELECT capture_id, 'asset_class' AS kind, unnest(asset_classes) AS value FROM records UNION ALL SELECT capture_id, 'reason_code' AS kind, unnest(impact_reason_codes) AS value FROM records UNION ALL SELECT capture_id, 'symbol' AS kind, unnest(candidate_symbols) AS value FROM records) AS u")
def b2(spark, sf_dir):
    return lookup.label_index(rec(spark, sf_dir))


def tags(spark, sf_dir):
    rows = rec(spark, sf_dir)
    return rows.select("capture_id", F.concat(F.lit("t"), (F.col("capture_id").cast("long") % 7).cast("string")).alias("tag"), "created_at")


TAGS = "tags AS (SELECT capture_id, 't' || CAST(CAST(capture_id AS BIGINT) % 7 AS VARCHAR) AS tag FROM records)"


@query("d2_by_tag", f"{R}, {TAGS} SELECT r.capture_id, r.domain, t.tag FROM records r JOIN tags t ON r.capture_id = t.capture_id WHERE t.tag = 't3'")
def d2(spark, sf_dir):
    return rec(spark, sf_dir).join(tags(spark, sf_dir).filter("tag = 't3'").select("capture_id", "tag"), "capture_id").select("capture_id", "domain", "tag")


@query("e4_tag_counts", f"{R}, {TAGS} SELECT tag, count(*) AS n FROM tags GROUP BY tag ORDER BY n DESC, tag LIMIT 5")
def e4(spark, sf_dir):
    return lookup.tag_counts(tags(spark, sf_dir), 5)


@query("b7_tags_add_remove", f"{R}, {TAGS}, more AS (SELECT capture_id, 'x.y' AS tag FROM records WHERE k % 11 = 0 UNION SELECT capture_id, tag FROM tags WHERE tag = 't1'), al AS (SELECT * FROM tags UNION SELECT * FROM more) SELECT capture_id, tag FROM al WHERE tag <> 't2'")
def b7(spark, sf_dir):
    rows, old = rec(spark, sf_dir), tags(spark, sf_dir)
    k = F.regexp_extract("title", r"k(\d+)$", 1).cast("long")
    more = rows.filter(k % 11 == 0).select("capture_id", F.lit(" x.y ").alias("tag"), "created_at").unionByName(old.filter("tag = 't1'"))
    bad = rows.select("capture_id", F.lit("not a tag!").alias("tag"), "created_at")
    return lookup.remove_tags(lookup.add_tags(old, more.unionByName(bad)), old.filter("tag = 't2'")).select("capture_id", "tag")


def reviews(spark, sf_dir):
    """Two reviewers of every record: the second one shifts scores and labels."""
    rows = rec(spark, sf_dir)
    n = F.col("capture_id").cast("long")
    who = rows.withColumn("reviewer_id", F.explode(F.array(F.lit("stub"), F.lit("model"))))
    second = F.col("reviewer_id") == "model"
    score = F.col("finance_relevance_score")
    return who.select(
        "capture_id", "reviewer_id",
        F.struct(
            F.when(second, score >= 0.5).otherwise(F.col("is_finance_relevant")).alias("is_finance_relevant"), F.when(second, score * 0.9).otherwise(score).alias("finance_relevance_score"),
            F.when(second, F.slice("asset_classes", 1, 1)).otherwise(F.col("asset_classes")).alias("asset_classes"), F.when(second & (n % 2 == 0), F.array().cast("array<string>")).otherwise(F.col("impact_reason_codes")).alias("impact_reason_codes"),
            F.col("candidate_symbols").alias("candidate_symbols"), F.when(second & (n % 4 == 0), "neutral").otherwise(F.col("sentiment_label")).alias("sentiment_label"), F.col("sentiment_score").alias("sentiment_score"),
        ).alias("payload"),
        (n % 900).cast("int").alias("input_tokens"), (n % 90).cast("int").alias("output_tokens"), ((n % 50) / 1000.0).alias("usd_cost"), F.when(n % 17 == 0, "timeout").alias("error_code"), "created_at",
    )


REVIEWS = """rv AS (SELECT *, CAST(capture_id AS BIGINT) AS n FROM records),
pr AS (SELECT capture_id, n, finance_relevance_score AS predicted, finance_relevance_score * 0.9 AS truth, is_finance_relevant AS ra, finance_relevance_score >= 0.5 AS rb, asset_classes AS aa, asset_classes[1:1] AS ab,
  impact_reason_codes AS ia, CASE WHEN n % 2 = 0 THEN [] ELSE impact_reason_codes END AS ib, sentiment_label AS sa, CASE WHEN n % 4 = 0 THEN 'neutral' ELSE sentiment_label END AS sb FROM rv),
cal AS (SELECT capture_id, predicted, truth, truth - predicted AS delta FROM pr WHERE n % 17 <> 0)"""


@query("d3_review_pairs", f"{R}, {REVIEWS} SELECT capture_id, predicted, truth FROM pr", "predicted truth")
def d3(spark, sf_dir):
    pairs = evaluate.review_pairs(reviews(spark, sf_dir), "stub", "model")
    return pairs.select("capture_id", F.col("a.payload.finance_relevance_score").alias("predicted"), F.col("b.payload.finance_relevance_score").alias("truth"))


@query("d4_pairs_left_records", f"{R}, {REVIEWS} SELECT pr.capture_id, r.domain FROM pr LEFT JOIN (SELECT * FROM records WHERE is_finance_relevant) AS r ON pr.capture_id = r.capture_id")
def d4(spark, sf_dir):
    pairs = evaluate.review_pairs(reviews(spark, sf_dir), "stub", "model").select("capture_id")
    return pairs.join(lookup.relevant_only(rec(spark, sf_dir)).select("capture_id", "domain"), "capture_id", "left")


@query("k21_calibration_bins", f"{R}, {REVIEWS} SELECT CAST(CASE WHEN predicted >= 0.8 THEN 4 WHEN predicted >= 0.6 THEN 3 WHEN predicted >= 0.4 THEN 2 WHEN predicted >= 0.2 THEN 1 ELSE 0 END AS INTEGER) AS bin, count(*) AS n, avg(predicted) AS avg_predicted, avg(truth) AS avg_truth, avg(truth) - avg(predicted) AS gap FROM cal GROUP BY 1", "avg_predicted avg_truth gap")
def k21(spark, sf_dir):
    return evaluate.calibration_bins(evaluate.calibration_rows(evaluate.review_pairs(reviews(spark, sf_dir), "stub", "model")))


@query("k21_calibration_summary", f"{R}, {REVIEWS} SELECT count(*) AS n, avg(abs(delta)) AS mae, avg(delta) AS signed, max(abs(delta)) AS worst FROM cal", "mae signed worst")
def k21_summary(spark, sf_dir):
    return evaluate.calibration_summary(evaluate.calibration_rows(evaluate.review_pairs(reviews(spark, sf_dir), "stub", "model")))


@query("k22_agreement", f"""{R}, {REVIEWS}, o AS (SELECT capture_id, ra = rb AS relevance_match, abs(predicted - truth) AS score_delta, CAST(CASE WHEN len(aa) = 2 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS asset_jaccard, CAST(CASE WHEN len(ib) = 0 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS reason_jaccard,
  CAST(1.0 AS DOUBLE) AS symbol_jaccard, coalesce(sa = sb, false) AS sentiment_match FROM pr)
SELECT *, (CASE WHEN relevance_match THEN 1 ELSE 0 END + 1 - least(1.0, score_delta) + asset_jaccard + reason_jaccard + symbol_jaccard + CASE WHEN sentiment_match THEN 1 ELSE 0 END) / 6 AS overall FROM o""", "score_delta asset_jaccard reason_jaccard symbol_jaccard overall")
def k22(spark, sf_dir):
    return evaluate.agreement(evaluate.review_pairs(reviews(spark, sf_dir), "stub", "model"))


@query("e2_spend", f"{R}, {REVIEWS}, w AS (SELECT unnest(['stub', 'model']) AS reviewer_id) SELECT reviewer_id, coalesce(sum(CAST((n % 50) / 1000.0 AS DOUBLE)), 0.0) AS usd, CAST(sum(n % 900) AS BIGINT) AS input_tokens, CAST(sum(n % 90) AS BIGINT) AS output_tokens, count(*) AS n, count(*) FILTER (n % 17 = 0) AS errors FROM rv CROSS JOIN w GROUP BY reviewer_id", "usd")
def e2(spark, sf_dir):
    return aggregate.spend(reviews(spark, sf_dir))


@query("e5_spend_by_day", f"{R}, {REVIEWS} SELECT strftime(published_ts, '%Y-%m-%d') AS day, sum(2 * CAST((n % 50) / 1000.0 AS DOUBLE)) AS usd, 2 * count(*) AS n FROM rv GROUP BY 1", "usd")
def e5(spark, sf_dir):
    return aggregate.spend_by_day(reviews(spark, sf_dir))


@query("e1_counts", f"{R} SELECT count(*) AS total, count(*) FILTER (is_finance_relevant) AS relevant, count(DISTINCT domain) AS domains FROM records")
def e1(spark, sf_dir):
    return aggregate.totals(rec(spark, sf_dir))


FACETS = """SELECT facet, value, count(*) AS n FROM (SELECT 'asset_class' AS facet, unnest(asset_classes) AS value FROM {t} UNION ALL SELECT 'reason_code' AS facet, unnest(impact_reason_codes) AS value FROM {t} UNION ALL SELECT 'symbol' AS facet, unnest(candidate_symbols) AS value FROM {t}
UNION ALL SELECT 'sentiment' AS facet, sentiment_label AS value FROM {t} UNION ALL SELECT 'domain' AS facet, domain AS value FROM {t}) AS u WHERE value IS NOT NULL GROUP BY facet, value"""


@query("e6_facets", f"{R} {FACETS.format(t='records')}")
def e6(spark, sf_dir):
    return aggregate.facets(rec(spark, sf_dir))


@query("e7_relevant_sentiment", f"{R} SELECT sentiment_label, count(*) AS n, avg(finance_relevance_score) AS mean_score FROM records WHERE is_finance_relevant GROUP BY sentiment_label", "mean_score")
def e7(spark, sf_dir):
    return lookup.relevant_only(rec(spark, sf_dir)).groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n"), F.avg("finance_relevance_score").alias("mean_score"))


@query("e7_overview", f"""{R}, c AS (SELECT grouping(facet, value) AS id, facet AS distribution, value, sum(n)::BIGINT AS n FROM ({FACETS.format(t='records WHERE is_finance_relevant')}) AS f GROUP BY GROUPING SETS ((facet, value), (facet), ()))
SELECT CASE id WHEN 0 THEN 'value' WHEN 1 THEN 'distribution' ELSE 'all' END AS level, distribution, value, n FROM c""")
def e7_all(spark, sf_dir):
    return aggregate.overview(rec(spark, sf_dir))


@query("e8_timeline", f"{R} SELECT CAST(us // 1000000 - (us // 1000000) % 900 AS BIGINT) AS bucket, count(*) AS n, count(*) FILTER (is_finance_relevant) AS relevant FROM records GROUP BY 1")
def e8(spark, sf_dir):
    return aggregate.timeline(rec(spark, sf_dir), 15)


@query("e9_trends", f"{R}, c AS (SELECT CAST((us // 3600000000) % 24 AS INTEGER) AS hour, unnest(asset_classes) AS asset FROM records), g AS (SELECT hour, asset, count(*) AS n FROM c GROUP BY hour, asset) SELECT h.hour, a.asset, coalesce(g.n, 0) AS n FROM (SELECT DISTINCT hour FROM g) AS h CROSS JOIN (SELECT DISTINCT asset FROM g) AS a LEFT JOIN g ON g.hour = h.hour AND g.asset = a.asset")
def e9(spark, sf_dir):
    return aggregate.trends(rec(spark, sf_dir))


@query("e10_matrix", f"{R} SELECT asset, reason, count(*) AS n FROM (SELECT asset, unnest(rs) AS reason FROM (SELECT unnest(asset_classes) AS asset, impact_reason_codes AS rs FROM records) AS x) AS y GROUP BY asset, reason")
def e10(spark, sf_dir):
    return aggregate.matrix(rec(spark, sf_dir))


@query("e11_top_symbols", f"{R} SELECT value, count(*) AS n FROM (SELECT unnest(candidate_symbols) AS value FROM records WHERE is_finance_relevant) AS u GROUP BY value ORDER BY n DESC, value LIMIT 10")
def e11(spark, sf_dir):
    return aggregate.top_values(rec(spark, sf_dir), "candidate_symbols", 10)


@query("e12_symbol_detail", f"{R}, own AS (SELECT * FROM records WHERE list_contains(candidate_symbols, 'SYM7')) SELECT * FROM ({FACETS.format(t='own')}) AS f WHERE facet IN ('reason_code', 'sentiment')")
def e12(spark, sf_dir):
    return aggregate.symbol_detail(rec(spark, sf_dir), "SYM7")


@query("e13_daily_sentiment", f"""{R}, c AS (SELECT us // {DAY} AS day, count(*) FILTER (sentiment_label = 'positive') AS positive, count(*) FILTER (sentiment_label = 'neutral') AS neutral, count(*) FILTER (sentiment_label = 'negative') AS negative FROM records WHERE list_contains(candidate_symbols, 'SYM7') GROUP BY 1),
s AS (SELECT unnest(range({AS_OF // DAY} - 13, {AS_OF // DAY} + 1)) AS day) SELECT CAST(s.day AS BIGINT) AS day, coalesce(positive, 0) AS positive, coalesce(neutral, 0) AS neutral, coalesce(negative, 0) AS negative FROM s LEFT JOIN c ON s.day = c.day""")
def e13(spark, sf_dir):
    return aggregate.daily_sentiment(rec(spark, sf_dir), "SYM7", 14, AS_OF // DAY)


@query("e14_compare", f"{R} SELECT domain, count(*) AS n, avg(CASE WHEN is_finance_relevant THEN 1.0 ELSE 0.0 END) AS relevant_rate, avg(finance_relevance_score) AS mean_score, avg(sentiment_score) AS mean_sentiment FROM records GROUP BY domain", "relevant_rate mean_score mean_sentiment")
def e14(spark, sf_dir):
    return aggregate.compare(rec(spark, sf_dir), "domain")


NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query("e15_table_sizes", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in NAMES))
def e15(spark, sf_dir):
    return aggregate.table_sizes({n: table(spark, sf_dir, n) for n in NAMES})


@query("e16_feed_health", "SELECT user_id % 20 AS feed, count(*) AS fetches, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type <> 'error') / CAST(count(*) AS DOUBLE) AS success_rate FROM events GROUP BY 1", "success_rate")
def e16(spark, sf_dir):
    bad = F.count_if(F.col("event_type") == "error")
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("feed")).agg(F.count(F.lit(1)).alias("fetches"), bad.alias("failures"), ((F.count(F.lit(1)) - bad) / F.count(F.lit(1))).alias("success_rate"))


@query("e17_sources_by_category", f"{R} SELECT CASE WHEN domain IN ('src1.example', 'src2.example') THEN 'regulator' WHEN domain = 'src3.example' THEN 'crypto' ELSE 'wire' END AS category, count(DISTINCT domain) AS sources, count(*) AS n FROM records GROUP BY 1")
def e17(spark, sf_dir):
    return rec(spark, sf_dir).groupBy(lookup.category(F.col("domain"), LADDER, "wire").alias("category")).agg(F.count_distinct("domain").alias("sources"), F.count(F.lit(1)).alias("n"))


@query("e18_failures_by_signal", "SELECT event_type AS signal, count(*) AS failures FROM events WHERE value > 100 GROUP BY event_type")
def e18(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value > 100").groupBy(F.col("event_type").alias("signal")).agg(F.count(F.lit(1)).alias("failures"))


@query("e19_distinct_counts", f"{R}, x AS (SELECT domain, us // {DAY} AS day, unnest(candidate_symbols) AS s FROM records) SELECT domain, count(DISTINCT day) AS days, count(DISTINCT s) AS symbols FROM x GROUP BY domain")
def e19(spark, sf_dir):
    rows = lookup.between(rec(spark, sf_dir), AS_OF, 20_000, 20_000)
    return rows.select("domain", F.floor(F.col("us") / DAY).alias("day"), F.explode("candidate_symbols").alias("s")).groupBy("domain").agg(F.count_distinct("day").alias("days"), F.count_distinct("s").alias("symbols"))


@query("e20_distribution", "SELECT event_type, avg(value) AS mean, min(value) AS min, max(value) AS max, stddev_samp(value) AS std, median(value) AS median FROM events GROUP BY event_type", "mean min max std median")
def e20(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("std"), F.median(v).alias("median"))


@query("e21_first_samples", f"{R}, x AS (SELECT domain, capture_id, row_number() OVER (PARTITION BY domain ORDER BY us, length(capture_id), capture_id) AS rn FROM records) SELECT domain, rn, capture_id FROM x WHERE rn <= 3")
def e21(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("domain").orderBy("created_at", F.length("capture_id"), "capture_id"))
    return rec(spark, sf_dir).withColumn("rn", rank).filter("rn <= 3").select("domain", F.col("rn").cast("long").alias("rn"), "capture_id")


@query("e22_upper_median", "SELECT event_type, value AS upper_median FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) AS x WHERE rn = n // 2 + 1", "upper_median")
def e22(spark, sf_dir):
    return aggregate.upper_median(table(spark, sf_dir, "events").select("event_type", "value"), "value", "event_type")


@query("k26_awareness_window", "SELECT user_id % 20 AS feed, 60.0 + value AS window_s FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id % 20 ORDER BY value) AS rn, count(*) OVER (PARTITION BY user_id % 20) AS n FROM events WHERE value BETWEEN 0 AND 14400) AS x WHERE rn = n // 2 + 1", "window_s")
def k26(spark, sf_dir):
    lags = table(spark, sf_dir, "events").filter(F.col("value").between(0, 14_400)).select((F.col("user_id") % 20).alias("feed"), "value")
    return aggregate.upper_median(lags, "value", "feed").select("feed", (60.0 + F.col("upper_median")).alias("window_s"))


@query("f5_deltas", "SELECT conv_id, turn, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS delta, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations")
def f5(spark, sf_dir):
    own = Window.partitionBy("conv_id").orderBy("turn")
    size = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (size - F.lag(size).over(own)).alias("delta"), F.lead("role").over(own).alias("next_role"))


@query("f6_halves", "SELECT user_id, avg(value) FILTER (i < n // 2) AS early, avg(value) FILTER (i >= n // 2) AS late FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) AS x GROUP BY user_id", "early late")
def f6(spark, sf_dir):
    own = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").withColumns({"i": F.row_number().over(own.orderBy("ts", "event_id")) - 1, "n": F.count(F.lit(1)).over(own)})
    late = F.col("i") >= F.floor(F.col("n") / 2)
    return rows.groupBy("user_id").agg(F.avg(F.when(~late, F.col("value"))).alias("early"), F.avg(F.when(late, F.col("value"))).alias("late"))


@query("f7_first_per_key", "SELECT user_id, arg_min(event_id, event_id) AS first_event, min(ts) = min(ts) AS has FROM events GROUP BY user_id")
def f7(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", "event_id").alias("first_event"), (F.min("ts") == F.min("ts")).alias("has"))


@query("f13_top_per_group", "SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) AS x WHERE rn <= 5", "l_extendedprice")
def f13(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").withColumn("rn", rank).filter("rn <= 5").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("g1_newest", f"{R} SELECT capture_id FROM records ORDER BY us DESC, length(capture_id) DESC, capture_id DESC LIMIT 200")
def g1(spark, sf_dir):
    return lookup.newest(rec(spark, sf_dir), 200).select("capture_id")


@query("g2_top_recent", f"{R}, n AS (SELECT * FROM records ORDER BY us DESC, length(capture_id) DESC, capture_id DESC LIMIT 200) SELECT capture_id, finance_relevance_score FROM n WHERE finance_relevance_score >= 0.5 ORDER BY finance_relevance_score DESC, length(capture_id), capture_id LIMIT 10", "finance_relevance_score")
def g2(spark, sf_dir):
    return lookup.top_recent(rec(spark, sf_dir)).select("capture_id", "finance_relevance_score")


@query("g6_nearest_vectors", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS score FROM embeddings CROSS JOIN q ORDER BY score DESC, vec_id LIMIT 10", "score")
def g6(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.filter("vec_id = 0").select(F.col("embedding").alias("_q"))
    return vectors.crossJoin(F.broadcast(one)).select("vec_id", cosine(F.col("embedding"), F.col("_q")).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("h1_first_wins", "SELECT name, src FROM (SELECT name, src, row_number() OVER (PARTITION BY name ORDER BY src) AS rn FROM (SELECT n_name AS name, 0 AS src FROM nation UNION ALL SELECT r_name AS name, 1 AS src FROM region UNION ALL SELECT n_name AS name, 2 AS src FROM nation) AS u) AS x WHERE rn = 1")
def h1(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    parts = [nation.withColumn("src", F.lit(0)), table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit(1).alias("src")), nation.withColumn("src", F.lit(2))]
    return lookup.first_wins(parts, ["name"])


@query("h2_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
def h2(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_size").distinct()


@query("h3_row_sets", f"{R} SELECT capture_id, len(list_intersect(asset_classes, ['rates', 'fx', 'macro'])) AS common, len(list_distinct(list_concat(asset_classes, ['rates', 'fx', 'macro']))) AS either FROM records")
def h3(spark, sf_dir):
    three = F.array(F.lit("rates"), F.lit("fx"), F.lit("macro"))
    return rec(spark, sf_dir).select("capture_id", F.size(F.array_intersect("asset_classes", three)).cast("long").alias("common"), F.size(F.array_union("asset_classes", three)).cast("long").alias("either"))


@query("h5_set_operations", "SELECT op, count(*) AS n FROM (SELECT 'intersect' AS op, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier) AS a UNION ALL SELECT 'except' AS op, k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier) AS b UNION ALL SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier) AS c) AS u GROUP BY op")
def h5(spark, sf_dir):
    c, s, n = (table(spark, sf_dir, t).select(F.col(k).cast("int").alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    named = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return named(c.intersect(s), "intersect").union(named(n.subtract(s), "except")).union(named(c.union(s).distinct(), "union")).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("d20_not_newest", f"{R}, n AS (SELECT capture_id FROM records ORDER BY us DESC, capture_id DESC LIMIT 150) SELECT count(*) AS n FROM records WHERE capture_id NOT IN (SELECT capture_id FROM n)")
def d20(spark, sf_dir):
    rows = rec(spark, sf_dir)
    top = rows.orderBy(F.desc("created_at"), F.desc("capture_id")).limit(150).select("capture_id")
    return rows.join(top, "capture_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query("d12_symbol_pairs", f"{R} SELECT capture_id, least(candidate_symbols[1], candidate_symbols[2]) AS a, greatest(candidate_symbols[1], candidate_symbols[2]) AS b FROM records WHERE len(candidate_symbols) = 2")
def d12(spark, sf_dir):
    s = F.array_sort("candidate_symbols")
    return rec(spark, sf_dir).filter(F.size("candidate_symbols") == 2).select("capture_id", s[0].alias("a"), s[1].alias("b"))


@query("d25_label_sets", f"{R}, {REVIEWS}, x AS (SELECT DISTINCT capture_id, unnest(list_concat(aa, ab)) AS label, aa, ab FROM pr) SELECT label, count(*) FILTER (list_contains(aa, label) AND list_contains(ab, label)) AS tp, count(*) FILTER (NOT list_contains(aa, label)) AS fp, count(*) FILTER (NOT list_contains(ab, label)) AS fn FROM x GROUP BY label")
def d25(spark, sf_dir):
    pairs = evaluate.review_pairs(reviews(spark, sf_dir), "stub", "model").select(F.col("a.payload.asset_classes").alias("e"), F.col("b.payload.asset_classes").alias("p"))
    return evaluate.label_quality(evaluate.label_sets(pairs, "e", "p")).select("label", "tp", "fp", "fn")


@query("k23_label_quality", """WITH x AS (SELECT l.toxic = 1 AS e, d.n_chars > 2000 AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id), c AS (SELECT count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn FROM x),
r AS (SELECT 'toxic' AS label, tp, fp, fn, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall FROM c) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM r""", "precision recall f1")
def k23(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.label_quality(rows.select(F.lit("toxic").alias("label"), (F.col("toxic") == 1).alias("expected"), (F.col("n_chars") > 2000).alias("predicted")))


@query("i15_jaccard", f"{R} SELECT capture_id, len(list_intersect(asset_classes, ['rates', 'fx'])) / CAST(len(list_distinct(list_concat(asset_classes, ['rates', 'fx']))) AS DOUBLE) AS j FROM records", "j")
def i15(spark, sf_dir):
    return rec(spark, sf_dir).select("capture_id", jaccard(F.col("asset_classes"), F.array(F.lit("rates"), F.lit("fx"))).alias("j"))


@query("i19_cluster_id", f"{R}, c AS (SELECT strftime(published_ts, '%Y%m%d%H') || '|' || asset_classes[1] AS cluster, string_agg(capture_id, '|' ORDER BY capture_id) AS ids FROM records GROUP BY 1) SELECT cluster, sha1(ids) AS cluster_id FROM c")
def i19(spark, sf_dir):
    from tidewire.queries.signals import windows_as_clusters

    return windows_as_clusters(spark, sf_dir).select(F.col("cluster_id").alias("cluster"), tx.cluster_id(F.col("capture_ids")).alias("cluster_id"))


@query("i9_domains", r"SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1), '^www\.', '') AS domain FROM pages")
def i9(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.domain_of(F.col("url")).alias("domain"))


@query("i6_canonical_url", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) AS s, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS pa, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT page_id, s, h, pa, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|gclid|fbclid|mc_|_ga|ref_src)')) AS q FROM p)
SELECT page_id, lower(s) || '://' || regexp_replace(lower(h), '^www\.', '') || regexp_replace(pa, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM k""")
def i6(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


@query("i4_tokens", "SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS n FROM documents")
def i4(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)).cast("long").alias("n"))


GUARD = "SELECT doc_id, sha256(CASE WHEN substr(text, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || text ELSE text END) AS cell_sha256 FROM documents"


@query("i26_csv_guard", GUARD)
@query("i26_csv_guard_whole", GUARD)
def i26(spark, sf_dir):
    """The guard over whole texts; the cells are too wide to compare but by hash."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.csv_safe(F.col("text")).cast("binary"), 256).alias("cell_sha256"))


@query("i27_token_cost", f"{R} SELECT capture_id, ((k % 900) * 0.27 + (k % 90) * 1.1) / 1000000.0 AS usd FROM records", "usd")
def i27(spark, sf_dir):
    k = F.regexp_extract("title", r"k(\d+)$", 1).cast("long")
    return rec(spark, sf_dir).select("capture_id", (((k % 900) * 0.27 + (k % 90) * 1.1) / 1000000.0).cast("double").alias("usd"))


@query("q1_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus", "sum_qty revenue avg_disc")
def q1(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("q2_revenue_by_nation", "SELECT n_name, count(*) AS orders, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "total")
def q2(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
