"""Queries for streaming operators (run to the end over files) and for the dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.plans import dashboard
from tidewire.queries.ingest import CAPS, _folder, sample_captures
from tidewire.queries.registry import query, table
from tidewire.sources import captures as cap
from tidewire.sources import sse
from tidewire.sources.records import RECORDS_SQL, events_as_records
from tidewire.streaming import pipeline as st

R = f"WITH {RECORDS_SQL}"


def _drained(stream, spark):
    """All rows of an append stream, through a table in the shared folder."""
    path, checkpoint = _folder(spark, "stream-out"), _folder(spark, "stream-state")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _event_stream(spark, sf_dir):
    """The event table as a stream; the source wants a folder, so its one file is named by a pattern."""
    static = table(spark, sf_dir, "events")
    folder, name = f"{sf_dir}/events.parquet".rsplit("/", 1)
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


@query("l5_tumbling_counts")
def l5(spark, sf_dir):
    """Windows that the watermark has closed; the batch timeline e8 is compared with SQL."""
    return _drained(st.tumbling_counts(_event_stream(spark, sf_dir).select("at"), "at", 60), spark)


@query("l6_session_islands")
def l6(spark, sf_dir):
    return _drained(st.session_islands(_event_stream(spark, sf_dir).select("at", "event_type"), "at", "event_type", "10 minutes"), spark)


@query("l1_one_per_url", "SELECT count(DISTINCT user_id % 40) AS n FROM events")
def l1(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).select(F.concat(F.lit("http://www.a.example/"), (F.col("user_id") % 40).cast("string"), F.lit("?utm_x="), F.col("event_id").cast("string")).alias("url"), F.col("at").alias("observed_ts"))
    return _drained(st.one_per_url(rows, within="60 days"), spark).agg(F.count(F.lit(1)).alias("n"))


@query("l2_first_titles")
def l2(spark, sf_dir):
    """Batch twin of the stateful operator; the tests compare both with a plain model."""
    rows = sample_captures(spark, sf_dir).withColumn("observed_ts", F.col("published_ts"))
    return st.first_titles_batch(rows).select("capture_id")


@query("l3_stream_upsert", f"{CAPS} SELECT count(DISTINCT capture_id) AS n FROM caps")
def l3(spark, sf_dir):
    source, path = _folder(spark, "stream-in"), _folder(spark, "stream-table")
    cap.write_captures(sample_captures(spark, sf_dir), source)
    for _ in range(2):  # the second pass, with a new checkpoint, reads everything again and changes nothing
        st.upsert_records(cap.stream_captures(spark, source), path, _folder(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("l9_feed_health", """WITH f AS (SELECT user_id % 20 AS feed, event_id AS seq, event_type <> 'error' AS ok, CASE WHEN event_type IN ('purchase', 'view') THEN 1 ELSE 0 END AS items FROM events),
l AS (SELECT feed, max(seq) FILTER (ok) AS o, max(seq) FILTER (items > 0) AS u FROM f GROUP BY feed)
SELECT f.feed, count(*) FILTER (o IS NULL OR seq > o) AS failures, count(*) FILTER (ok AND (u IS NULL OR seq > u)) AS empties FROM f JOIN l ON f.feed = l.feed GROUP BY f.feed""")
def l9(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("feed"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type").isin("purchase", "view"), 1).otherwise(0).alias("items"))
    return st.feed_health(rows).select("feed", "failures", "empties")


@query("k24_dashboard")
def k24(spark, sf_dir):
    return dashboard.snapshot(events_as_records(spark, sf_dir))


@query("k25_live_read")
def k25(spark, sf_dir):
    return dashboard.live_read(events_as_records(spark, sf_dir))


@query("a15_sse_stream", "SELECT 'click ' || CAST(event_id AS VARCHAR) || chr(10) || coalesce(props, '') AS data FROM events WHERE event_type = 'click' UNION ALL SELECT event_type || ' ' || CAST(event_id AS VARCHAR) FROM events WHERE event_type <> 'click'")
def a15_stream(spark, sf_dir):
    """The event table written as a push stream's bytes (comments, other fields, two kinds of line ends), and read back by the stream source."""
    folder = _folder(spark, "sse")
    rows = table(spark, sf_dir, "events")
    head = F.concat(F.lit("data: "), "event_type", F.lit(" "), F.col("event_id").cast("string"))
    click = F.concat(F.lit(": beat\r\nid: 7\r\n"), head, F.lit("\r\ndata:"), F.coalesce("props", F.lit("")), F.lit("\r\n\r"))
    rows.select(F.when(F.col("event_type") == "click", click).otherwise(F.concat(F.lit("event: x\n"), head, F.lit("\n"))).alias("value")).write.text(folder)
    return _drained(sse.event_stream(spark, folder), spark).select("data")
