"""Functions for SQL text: temporary SQL functions, which Catalyst inlines, and a table function for feed bodies."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidewire.sources.feeds import _feed_items

FUNCTIONS = {
    "tw_jaccard": ("(a array<string>, b array<string>) RETURNS double", "coalesce(try_divide(size(array_intersect(a, b)), size(array_union(a, b))), 0.0)"),
    "tw_bucket": ("(s bigint, size bigint) RETURNS bigint", "s - pmod(s, size)"),
    "tw_severity": ("(z double) RETURNS string", "CASE WHEN abs(z) >= 4 THEN 'high' WHEN abs(z) >= 3 THEN 'medium' ELSE 'low' END"),
    "tw_csv_safe": ("(x string) RETURNS string", "CASE WHEN substr(x, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN concat(chr(39), x) ELSE x END"),
    "tw_sampled": ("(k string, per_10k int) RETURNS boolean", "CAST(conv(substr(sha2(k, 256), 1, 8), 16, 10) AS bigint) % 10000 < per_10k"),
}


@udtf(returnType="title string, text string, link string, source_url string, date string")
class FeedItems:
    """The items of an RSS or Atom body."""

    def eval(self, body: str) -> Iterator[tuple]:
        for item in _feed_items(body or ""):
            if item[0] and item[1] and item[2]:
                yield item


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; gives their names."""
    for name, (signature, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {signature} RETURN {body}")
    spark.udtf.register("tw_feed_items", FeedItems)
    return [*FUNCTIONS, "tw_feed_items"]
