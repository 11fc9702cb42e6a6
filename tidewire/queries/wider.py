"""Queries for models, uploads, fuzzy scores and whole-column forms of the small functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import fuzzy
from tidewire.functions import text as tx
from tidewire.operators import aggregate, lookup
from tidewire.plans import mix, models, stories
from tidewire.queries.ingest import _folder
from tidewire.queries.registry import query, table
from tidewire.queries.signals import R
from tidewire.sources import golden, uploads
from tidewire.sources.records import events_as_records


@query("f7_leader_per_outlet", f"{R}, x AS (SELECT domain, capture_id, us, row_number() OVER (PARTITION BY domain ORDER BY us, length(capture_id), capture_id) AS k FROM records) SELECT domain, capture_id AS first_id, us AS first_us FROM x WHERE k = 1")
def f7_leader(spark, sf_dir):
    return lookup.first_per_key(events_as_records(spark, sf_dir), "domain").select("domain", F.col("capture_id").alias("first_id"), F.col("us").alias("first_us"))


@query("g6_nearest_to_one", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 1) SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS score FROM embeddings CROSS JOIN q ORDER BY score DESC, vec_id LIMIT 20", "score")
def g6_one(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.filter("vec_id = 1").select("embedding").first()
    return lookup.nearest_vectors(vectors, one[0], 20, "vec_id", "embedding")


@query("i4_title_tokens", f"{R} SELECT capture_id, array_to_string(list_filter(regexp_extract_all(lower(title), '[a-z0-9'']+'), lambda w: NOT list_contains(['the', 'a', 'an', 'of', 'in', 'on', 'to', 'for', 'is', 'are', 'was', 'were', 'and', 'or', 'but'], w)), ' ') AS tokens FROM records")
def i4_titles(spark, sf_dir):
    return events_as_records(spark, sf_dir).select("capture_id", F.array_join(tx.title_tokens(F.col("title"), stories.TITLE_STOPWORDS), " ").alias("tokens"))


@query("c15_safe_tags", "SELECT c_custkey, CASE WHEN regexp_full_match(trim(c_name), '[a-zA-Z0-9_.-]{1,50}') THEN trim(c_name) END AS name_tag, CASE WHEN regexp_full_match(trim(c_mktsegment), '[a-zA-Z0-9_.-]{1,50}') THEN trim(c_mktsegment) END AS segment_tag FROM customer")
def c15_tags(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tx.safe_tag(F.col("c_name")).alias("name_tag"), tx.safe_tag(F.col("c_mktsegment")).alias("segment_tag"))


@query("d12_all_symbol_pairs", f"""{R}, s AS (SELECT unnest(candidate_symbols) AS a, candidate_symbols AS all_s FROM records), p AS (SELECT a, unnest(all_s) AS b FROM s)
SELECT a, b, count(*) AS weight FROM p WHERE a < b GROUP BY a, b""")
def d12_all(spark, sf_dir):
    return mix.co_occurrence_edges(events_as_records(spark, sf_dir), least=1, samples=False)


@query("i3_tickers", r"""WITH t AS (SELECT event_id, 'x $' || upper(event_type) || ' and $ABC, (NYSE: K' || CAST(user_id % 7 AS VARCHAR) || ') (NASDAQ:QQQ) (BRK.B) $toolow' AS text FROM events)
SELECT event_id, array_to_string(regexp_extract_all(text, '\$([A-Z]{1,6})\b', 1), ',') AS cashtags, 'QQQ,BRK.B' AS tickers FROM t""")
def i3_tickers(spark, sf_dir):
    text = F.concat(F.lit("x $"), F.upper("event_type"), F.lit(" and $ABC, (NYSE: K"), (F.col("user_id") % 7).cast("string"), F.lit(") (NASDAQ:QQQ) (BRK.B) $toolow"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(tx.cashtags(text), ",").alias("cashtags"), F.array_join(tx.paren_tickers(text), ",").alias("tickers"))


@query("d22_existence_probe", f"{R} SELECT capture_id FROM records WHERE CAST(capture_id AS BIGINT) % 3 <> 0")
def d22(spark, sf_dir):
    rows = events_as_records(spark, sf_dir)
    return lookup.not_known(rows, rows.filter(F.col("capture_id").cast("long") % 3 == 0)).select("capture_id")


@query("e16_feed_status", """SELECT user_id % 20 AS feed, count(*) AS fetches, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'view') AS empty, 1 - count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE) AS success_rate,
CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'failing' WHEN arg_max(event_type, event_id) = 'view' THEN 'idle' ELSE 'healthy' END AS status FROM events GROUP BY 1""", "success_rate")
def e16_status(spark, sf_dir):
    """Events as fetches: an error is a failure, a view found nothing."""
    rows = table(spark, sf_dir, "events")
    fetches = rows.select((F.col("user_id") % 20).alias("feed"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type").isin("error", "view"), 0).otherwise(1).alias("items"))
    return aggregate.feed_rollup(fetches)


@query("e18_failure_ring", "SELECT event_type AS signal, count(*) AS kept, min(event_id) AS oldest FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) AS x WHERE k <= 50 GROUP BY event_type")
def e18_ring(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("signal"), F.col("event_id").alias("seq"))
    return aggregate.last_of_each(rows, "signal", "seq", 50).groupBy("signal").agg(F.count(F.lit(1)).alias("kept"), F.min("seq").alias("oldest"))


@query("a19_golden", "SELECT CAST(doc_id AS VARCHAR) AS capture_id, lang = 'en' AS expected_finance_relevant FROM documents WHERE doc_id % 4 <> 0 AND text IS NOT NULL AND lang IS NOT NULL")
def a19(spark, sf_dir):
    """Documents written as golden items, a quarter of them broken or incomplete, read back without the bad ones."""
    path = _folder(spark, "golden")
    docs = table(spark, sf_dir, "documents")
    item = F.to_json(F.struct(F.col("doc_id").cast("string").alias("capture_id"), F.col("lang").alias("title"), "text", (F.col("lang") == "en").alias("expected_finance_relevant")))
    line = F.when(F.col("doc_id") % 8 == 0, "{broken").when(F.col("doc_id") % 4 == 0, '{"capture_id": "x", "title": "t"}').otherwise(item)
    docs.select(line.alias("value")).write.text(path)
    return golden.read_golden(spark, path, strict=False).select("capture_id", "expected_finance_relevant")


@query("a16_uploads", "SELECT page_id, html IS NOT NULL AND html <> '' AS taken FROM pages")
def a16(spark, sf_dir):
    """Every page as an uploaded file; titles and texts are compared with plain ones in the tests."""
    files = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return uploads.extracted(files).select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("page_id"), F.col("error").isNull().alias("taken"))


@query("m4_models", f"{R} SELECT capture_id, CASE WHEN title LIKE 'error%' THEN 'negative' ELSE 'neutral' END AS mood, 'stub/1' AS mood_version FROM records")
def m4(spark, sf_dir):
    """A sentiment model whose factory fails, so that its stub takes over."""

    class Stub:
        version = "stub/1"

        def predict(self, texts):
            return ["negative" if t.startswith("error") else "neutral" for t in texts]

    def broken():
        raise OSError("no weights here")

    rows = events_as_records(spark, sf_dir).select("capture_id", "title")
    return models.with_model(rows, broken, "title", "mood", T.StringType(), Stub).drop("title")


@query("m5_reviews", f"{R} SELECT capture_id, 'echo' AS reviewer_id, CASE WHEN is_finance_relevant THEN 'True' ELSE 'False' END AS relevant, sentiment_label AS label FROM records")
def m5(spark, sf_dir):
    rows = models.reviews(events_as_records(spark, sf_dir))
    return rows.select("capture_id", "reviewer_id", F.col("payload")["is_finance_relevant"].alias("relevant"), F.try_element_at("payload", F.lit("sentiment_label")).alias("label"))


@query("j5_reranked", f"""{R} SELECT capture_id, array_to_string(CASE WHEN len(candidate_symbols) = 2 AND s1 <> split_part(title, ' ', 2) AND s2 = split_part(title, ' ', 2) THEN [s2, s1] ELSE candidate_symbols END, ',') AS symbols
FROM (SELECT *, candidate_symbols[1] AS s1, candidate_symbols[2] AS s2 FROM (SELECT capture_id, title, list_reverse(candidate_symbols) AS candidate_symbols FROM records) AS y) AS x""")
def j5(spark, sf_dir):
    """Symbols turned round, then ranked by the title, which names one of them."""
    rows = events_as_records(spark, sf_dir).select("capture_id", "title", F.reverse("candidate_symbols").alias("candidate_symbols"))
    return models.reranked(rows).select("capture_id", F.array_join("candidate_symbols", ",").alias("symbols"))


@query("i23_fuzzy")
def i23(spark, sf_dir):
    """Compared with the scores' definitions in the tests."""
    rows = events_as_records(spark, sf_dir).withColumn("symbol", F.get("candidate_symbols", 0))
    return rows.select("capture_id", fuzzy.partial_ratio_of(F.col("title"), F.col("symbol")).alias("partial"), fuzzy.token_set_ratio_of(F.col("title"), F.col("symbol")).alias("token_set"))


@query("c4_cluster_search")
def c4_clusters(spark, sf_dir):
    return lookup.search_clusters(stories.cluster_records(events_as_records(spark, sf_dir), domains=2), "sym1").select("cluster_id", "size")
