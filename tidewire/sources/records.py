"""Records made from the event table: a deterministic stand-in for enriched news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.time import epoch_us, event_time
from tidewire.taxonomy import ASSETS, REASONS


def _name(values: list[str], index: Column) -> Column:
    return F.array(*map(F.lit, values))[index.cast("int")]


def _one_or_two(first: Column, second: Column, both: Column) -> Column:
    return F.when(both, F.array_distinct(F.array(first, second))).otherwise(F.array(first))


def events_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as records; every column is an expression of one event, so filters reach the scan."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    events = events.withColumn("k", k)
    user, k = F.col("user_id"), F.col("k")
    symbol = lambda x: F.concat(F.lit("SYM"), F.pmod(x, F.lit(30)).cast("string"))
    score = F.least(F.lit(1.0), F.col("value") / 150.0)
    return events.select(
        F.col("event_id").cast("string").alias("capture_id"),
        F.concat(F.lit("d"), (F.col("event_id") % 997).cast("string")).alias("doc_id"),
        F.concat_ws(" ", "event_type", symbol(user), F.concat(F.lit("k"), k.cast("string"))).alias("title"),
        F.col("ts").alias("published_ts"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("src"), (user % 20).cast("string"), F.lit(".example")).alias("domain"),
        (score >= 0.35).alias("is_finance_relevant"),
        score.alias("finance_relevance_score"),
        _one_or_two(_name(ASSETS, user % 8), _name(ASSETS, k % 8), k % 3 == 0).alias("asset_classes"),
        _one_or_two(_name(REASONS, k % 20), _name(REASONS, user % 20), k % 5 == 0).alias("impact_reason_codes"),
        _one_or_two(symbol(user), symbol(k), k % 2 == 0).alias("candidate_symbols"),
        F.when(F.col("event_type").isin("purchase", "signup"), "positive").when(F.col("event_type") == "error", "negative").when(F.col("event_type") == "view", "neutral").alias("sentiment_label"),
        ((k % 100) / 100.0).alias("sentiment_score"),
    )


def timed(records: DataFrame) -> DataFrame:
    """Add ``us``, the event time in microseconds (published, else created); rows without one are dropped."""
    return records.withColumn("us", epoch_us(event_time(F.col("published_ts"), F.col("created_at")))).filter("us is not null")


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The same records for DuckDB, as common table expressions.
RECORDS_SQL = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
rec0 AS (SELECT *, {_sql_list(ASSETS)}[(user_id % 8) + 1] AS a1, {_sql_list(ASSETS)}[(k % 8) + 1] AS a2,
  {_sql_list(REASONS)}[(k % 20) + 1] AS r1, {_sql_list(REASONS)}[(user_id % 20) + 1] AS r2,
  'SYM' || CAST(user_id % 30 AS VARCHAR) AS s1, 'SYM' || CAST(k % 30 AS VARCHAR) AS s2,
  least(1.0::DOUBLE, value / 150.0) AS score FROM ev),
records AS (SELECT CAST(event_id AS VARCHAR) AS capture_id, 'd' || CAST(event_id % 997 AS VARCHAR) AS doc_id,
  event_type || ' ' || s1 || ' k' || CAST(k AS VARCHAR) AS title, ts AS published_ts, epoch_us(ts) AS us,
  'src' || CAST(user_id % 20 AS VARCHAR) || '.example' AS domain, score >= 0.35 AS is_finance_relevant, score AS finance_relevance_score,
  CASE WHEN k % 3 = 0 AND a1 <> a2 THEN [a1, a2] ELSE [a1] END AS asset_classes,
  CASE WHEN k % 5 = 0 AND r1 <> r2 THEN [r1, r2] ELSE [r1] END AS impact_reason_codes,
  CASE WHEN k % 2 = 0 AND s1 <> s2 THEN [s1, s2] ELSE [s1] END AS candidate_symbols,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' WHEN event_type = 'view' THEN 'neutral' END AS sentiment_label,
  CAST((k % 100) / 100.0 AS DOUBLE) AS sentiment_score, user_id, k, event_type FROM rec0)"""
