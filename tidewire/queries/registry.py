"""Named queries: a Spark callable and, where SQL can say it, the same query for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, floats: str = ""):
    """Register a query; its columns ``floats`` are rounded on both sides, as sums differ in their last bits."""
    names = floats.split()

    def register(make: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = make(spark, sf_dir)
            return out.withColumns({c: F.round(F.col(c), DIGITS) + F.lit(0.0) for c in names}) if names else out

        run.__doc__ = make.__doc__
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            if names:
                replaced = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in names)
                body = f"SELECT * REPLACE ({replaced}) FROM ({body}) AS unrounded"
            SQL[name] = body
        return make

    return register
