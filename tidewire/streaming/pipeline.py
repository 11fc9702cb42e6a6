"""Structured Streaming: ingest, deduplication, near-duplicate titles, tumbling counts, idempotent upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.functions.text import canonical_url, normal_title
from tidewire.plans.enrich import enrich
from tidewire.session import scratch_removed
from tidewire.sources.captures import RAW, failures, is_valid
from tidewire.sources.sinks import overwrite_buckets

WATERMARK = "1 hour"


def fresh(captures: DataFrame, days: int = 14) -> DataFrame:
    """Captures that aren't stale now; those without a date stay."""
    return captures.filter(F.col("published_ts").isNull() | (F.col("published_ts") >= F.current_timestamp() - F.make_dt_interval(days=F.lit(days))))


def one_per_url(captures: DataFrame, time: str = "observed_ts", within: str = WATERMARK) -> DataFrame:
    """The first capture of each canonical URL within the watermark."""
    keyed = captures.withColumn("canonical_url", canonical_url(F.coalesce("url", F.lit(""))))
    return keyed.withWatermark(time, within).dropDuplicatesWithinWatermark(["canonical_url"])


def first_titles(captures: DataFrame, time: str = "observed_ts", window_s: int = 21_600) -> DataFrame:
    """Drop captures whose normal title was first seen at most ``window_s`` before; titles too short to compare pass.

    State for a title is the time of its first sighting.  It is not moved by
    later ones, and it goes when the window is over.
    """
    keyed = captures.withColumn("_key", normal_title(F.col("title"))).withColumn("_key", F.when(F.col("_key") == "", F.concat(F.lit("\0"), F.col("capture_id"))).otherwise(F.col("_key")))
    schema = captures.schema

    def admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values([time, "capture_id"], kind="stable")
        first = state.get[0] if state.exists else None
        kept = []
        for at, us in zip(rows.index, rows[time].astype("int64"), strict=True):
            us = int(us) // 1000 if rows[time].dtype.name.startswith("datetime64[ns") else int(us)
            kept.append(first is None or not 0 <= us - first <= window_s * 1_000_000)
            first = us if kept[-1] else first
        state.update((first,))
        state.setTimeoutTimestamp(max(first // 1000 + window_s * 1000, state.getCurrentWatermarkMs() + 1))
        out = rows[kept]
        if len(out):
            yield out[[f.name for f in schema]]

    marked = keyed.withWatermark(time, WATERMARK)
    return marked.groupBy("_key").applyInPandasWithState(admit, schema, "first long", "append", GroupStateTimeout.EventTimeTimeout)


def first_titles_batch(captures: DataFrame, time: str = "observed_ts", window_s: int = 21_600) -> DataFrame:
    """The batch twin of ``first_titles``: a title's sightings in time order, each kept if the last kept one is out of its window.

    A sighting within the window of the one before it may still be kept, so the
    times of a title are read in order; only the last kept one is remembered.
    """
    rows = captures.select("capture_id", normal_title(F.col("title")).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for batch in batches:
            kept = []
            for key, us in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != at:
                    at, last = key, None
                take = last is None or us is None or us - last > window_s * 1_000_000
                last = us if take and us is not None else last
                kept.append(take)
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(pa.array(kept, pa.bool_()))], names=["capture_id"])

    ordered = rows.filter("key <> ''").repartition("key").sortWithinPartitions("key", "us", "capture_id").select("key", "us", "capture_id")
    folded = ordered.mapInArrow(fold, captures.select("capture_id").schema)
    short = rows.filter("key = ''").select("capture_id")
    return captures.join(folded.unionByName(short), "capture_id", "left_semi")


def tumbling_counts(captures: DataFrame, time: str, minutes: int, late: str = WATERMARK) -> DataFrame:
    """Captures of each window, as it closes."""
    return captures.withWatermark(time, late).groupBy(F.window(time, f"{minutes} minutes")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("window.start").alias("bucket"), "n")


def session_islands(captures: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = WATERMARK) -> DataFrame:
    """Runs of captures of one key without a longer gap, as each ends."""
    return captures.withWatermark(time, late).groupBy(by, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n")).select(by, F.unix_seconds("session_window.start").alias("start"), "n")


def upsert_records(captures: DataFrame, path: str, checkpoint: str, available_now: bool = True, errors: str | None = None) -> StreamingQuery:
    """Enrich each micro-batch and upsert it; a batch that runs again changes nothing.

    Lines that aren't captures, and captures without an id or text, go to the
    folder ``errors``, if there is one, by batch, with the reason and the line
    itself, and the others go on; otherwise they are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        if errors is not None:
            failures(batch).write.mode("overwrite").parquet(f"{errors}/batch={number}")
        # The batch's session is a copy that the stream alone has: what a step has shuffled goes with the step.
        batch.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        with scratch_removed(batch.sparkSession):
            records = enrich(batch.filter(is_valid()).drop(RAW), settled=True)
            overwrite_buckets(records.withColumn("created_at", F.coalesce("published_ts", F.lit("1970-01-01").cast("timestamp"))), path, ["capture_id"])

    writer = captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def next_cooldown(failures: int) -> int:
    """Seconds that a source rests after so many failures in a row."""
    ladder = [60, 300, 900, 1800, 3600]
    return 0 if failures < 5 else ladder[min(failures - 5, len(ladder) - 1)]


def cadence(empties: int) -> int:
    """A source with so many empty fetches in a row is asked every so many cycles."""
    return 1 if empties <= 2 else 3 if empties <= 5 else 6 if empties <= 10 else 12


def feed_health(fetches: DataFrame) -> DataFrame:
    """(feed, failures, empties, cooldown_s, cadence): the runs of failures and of empty fetches that end at each feed's newest fetch.

    ``fetches`` holds feed, seq, ok, items.  A run is what follows the newest
    success, or the newest fetch with items, so two maxima give it.
    """
    last = fetches.groupBy("feed").agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("ok_seq"), F.max(F.when(F.col("items") > 0, F.col("seq"))).alias("full_seq"))
    runs = fetches.join(last, "feed").groupBy("feed").agg(
        F.count_if(F.col("ok_seq").isNull() | (F.col("seq") > F.col("ok_seq"))).alias("failures"),
        F.count_if(F.col("ok") & (F.col("full_seq").isNull() | (F.col("seq") > F.col("full_seq")))).alias("empties"),
    )
    rest, slow = F.lit(next_cooldown(10**6)), F.lit(cadence(10**6))
    for n in range(9, -1, -1):
        rest = F.when(F.col("failures") <= n, next_cooldown(n)).otherwise(rest)
    for n in range(11, -1, -1):
        slow = F.when(F.col("empties") <= n, cadence(n)).otherwise(slow)
    return runs.withColumns({"cooldown_s": rest, "cadence": F.when(F.col("empties") > 10, 12).otherwise(slow)})
