"""Captures from line-delimited JSON: batch scan, replay and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from tidewire.schemas import CAPTURE

#: Finalized files, plain or compressed; a writer's temporary names don't fit.
NAMES = "*.{jsonl,json,jsonl.gz,json.gz}"
#: The column of a line that doesn't parse.
RAW = "_raw_line"
NEEDED = ("capture_id", "doc_id", "text")


def is_valid() -> Column:
    """True for captures that parsed and have their ids and text."""
    good = F.lit(True)
    for c in NEEDED:
        good = good & F.col(c).isNotNull()
    return good


def failures(rows: DataFrame, most: int = 4000) -> DataFrame:
    """(capture_id, error, payload_excerpt) of the captures that can't be used: why, and the start of the line or text itself."""
    raw = F.col(RAW) if RAW in rows.columns else F.lit(None).cast("string")
    missing = F.concat(F.lit("without "), F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in NEEDED)))
    bad = rows.filter(~is_valid())
    payload = F.coalesce(raw, F.col("text"), F.to_json(F.struct(*(c for c in rows.columns if c != RAW))))
    return bad.select("capture_id", F.when(raw.isNotNull(), F.lit("not a capture in JSON")).otherwise(missing).alias("error"), F.substring(payload, 1, most).alias("payload_excerpt"))


def _valid(rows: DataFrame) -> DataFrame:
    return rows.filter(is_valid())


def read_captures(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Finalized JSON-lines files under ``path``; rows that don't parse, or lack an id or text, are left out."""
    reader = spark.read.schema(CAPTURE).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", NAMES)
    rows = _valid(reader.json(path))
    return rows if limit is None else rows.limit(limit)


def stream_captures(spark: SparkSession, path: str, files_per_batch: int = 100, keep_invalid: bool = False) -> DataFrame:
    """The same as a stream; the checkpoint remembers what has been read.

    With ``keep_invalid`` rows that don't parse or lack an id or text come too;
    RAW holds the whole line of those that don't parse.
    """
    schema = f"{CAPTURE}, {RAW} string" if keep_invalid else CAPTURE
    reader: DataStreamReader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", NAMES).option("columnNameOfCorruptRecord", RAW)
    rows = reader.option("maxFilesPerTrigger", files_per_batch).json(path)
    return rows if keep_invalid else _valid(rows)


def write_captures(captures: DataFrame, path: str, files: int = 8) -> None:
    """One folder for each day of observation, with ``files`` compressed files at most, so that a busy day is several tasks' work."""
    day = F.coalesce(*(c for c in ("observed_ts", "published_ts") if c in captures.columns))
    parts = captures.withColumns({"y": F.date_format(day, "yyyy"), "m": F.date_format(day, "MM"), "d": F.date_format(day, "dd")})
    parts.repartition("y", "m", "d", F.pmod(F.xxhash64("capture_id"), F.lit(files))).write.mode("append").partitionBy("y", "m", "d").option("compression", "gzip").json(path)
