"""The golden set: captures with the verdict that is expected of them, as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "capture_id string, title string, text string, domain string, source_type string, expected_finance_relevant boolean, "
    "expected_asset_classes array<string>, expected_reason_codes array<string>, expected_symbols array<string>, expected_sentiment string"
)
# The fields that every item must have.
REQUIRED = ("capture_id", "title", "text", "expected_finance_relevant")


def _problem() -> Column:
    lacks = [F.when(F.col(f"item.{c}").isNull(), F.lit(f"no {c}")) for c in REQUIRED]
    return F.when(F.col("item").isNull() | F.col("item._bad").isNotNull(), "invalid json").otherwise(F.coalesce(*lacks))


def read_golden(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Items of the files under ``path``.  An item that is no JSON or lacks a required field stops a strict read, else it is left out.

    Blank lines are nothing.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    item = F.from_json("value", SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = lines.select(item.alias("item"), "value").withColumn("problem", _problem())
    if strict:
        told = F.raise_error(F.concat(F.lit("golden item: "), F.col("problem"), F.lit(": "), F.substring("value", 1, 80)))
        rows = rows.filter(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(told.cast("boolean")))
    else:
        rows = rows.filter("problem is null")
    return rows.select("item.*").drop("_bad")
