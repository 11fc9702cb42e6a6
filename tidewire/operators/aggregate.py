"""Facets, timelines, matrices and roll-ups over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.time import floor_to
from tidewire.operators.lookup import label_index
from tidewire.sources.records import timed


def facets(records: DataFrame) -> DataFrame:
    """(facet, value, n): counts of every label list, sentiment and domain, in one pass and one shuffle."""
    named = lambda f: lambda v: F.struct(F.lit(f).alias("facet"), v.alias("value"))
    lists = [F.transform(c, named(f)) for f, c in (("asset_class", "asset_classes"), ("reason_code", "impact_reason_codes"), ("symbol", "candidate_symbols"))]
    singles = [F.array(F.struct(F.lit(f).alias("facet"), F.col(c).alias("value"))) for f, c in (("sentiment", "sentiment_label"), ("domain", "domain"))]
    rows = records.select(F.explode(F.concat(*lists, *singles)).alias("x")).select("x.facet", "x.value").filter("value is not null")
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def totals(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_finance_relevant").alias("relevant"), F.count_distinct("domain").alias("domains"))


def timeline(records: DataFrame, minutes: int) -> DataFrame:
    """Records and relevant records of each epoch-aligned bucket that has any."""
    bucket = floor_to(F.floor(F.col("us") / 1_000_000), minutes * 60)
    return timed(records).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_finance_relevant").alias("relevant"))


def trends(records: DataFrame) -> DataFrame:
    """Hour of the day (UTC) by asset class, zero-filled over the hours that occur."""
    rows = timed(records).select(F.pmod(F.floor(F.col("us") / 3_600_000_000), F.lit(24)).cast("int").alias("hour"), F.explode("asset_classes").alias("asset"))
    counts = rows.groupBy("hour", "asset").agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("hour").distinct().crossJoin(F.broadcast(counts.select("asset").distinct()))
    return grid.join(counts, ["hour", "asset"], "left").na.fill(0, ["n"])


def matrix(records: DataFrame) -> DataFrame:
    """Asset class by reason code, every mention counted."""
    rows = records.select(F.explode("asset_classes").alias("asset"), "impact_reason_codes").select("asset", F.explode("impact_reason_codes").alias("reason"))
    return rows.groupBy("asset", "reason").agg(F.count(F.lit(1)).alias("n"))


def top_values(records: DataFrame, column: str, top: int) -> DataFrame:
    """The most frequent values of a list column among relevant records; ties by name."""
    rows = records.filter("is_finance_relevant").select(F.explode(column).alias("value"))
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)


def symbol_detail(records: DataFrame, symbol: str) -> DataFrame:
    """(facet, value, n): reasons and sentiments of one symbol's records."""
    own = records.filter(F.array_contains("candidate_symbols", symbol))
    return facets(own).filter(F.col("facet").isin("reason_code", "sentiment"))


def daily_sentiment(records: DataFrame, symbol: str, days: int, as_of_day: int) -> DataFrame:
    """Records of one symbol by sentiment on each of the last days, zero-filled; days are numbered from 1970-01-01."""
    spark = records.sparkSession
    hits = label_index(records).filter((F.col("kind") == "symbol") & (F.col("value") == symbol)).select("capture_id")
    rows = timed(records).withColumn("day", F.floor(F.col("us") / 86_400_000_000)).filter(F.col("day").between(as_of_day - days + 1, as_of_day))
    label = F.col("sentiment_label")
    counts = rows.join(hits, "capture_id", "left_semi").groupBy("day").agg(*(F.count_if(label == x).alias(x) for x in ("positive", "neutral", "negative")))
    spine = spark.range(as_of_day - days + 1, as_of_day + 1).withColumnRenamed("id", "day")
    return spine.join(F.broadcast(counts), "day", "left").na.fill(0)


def compare(records: DataFrame, by: str) -> DataFrame:
    """Rates and means of each group."""
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_finance_relevant").cast("double")).alias("relevant_rate"), F.avg("finance_relevance_score").alias("mean_score"), F.avg("sentiment_score").alias("mean_sentiment"))


def spend(reviews: DataFrame) -> DataFrame:
    """Cost, tokens, rows and errors of each reviewer."""
    return reviews.groupBy("reviewer_id").agg(
        F.coalesce(F.sum("usd_cost"), F.lit(0.0)).alias("usd"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.count(F.lit(1)).alias("n"), F.count("error_code").alias("errors"),
    )


def spend_by_day(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.coalesce(F.sum("usd_cost"), F.lit(0.0)).alias("usd"), F.count(F.lit(1)).alias("n"))


def upper_median(rows: DataFrame, value: str, by: str) -> DataFrame:
    """The upper of the two middle values of each group, from counts of its distinct values: a hot group's rows are counted in part before the shuffle."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(by)
    upto = F.sum("_n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).withColumn("_middle", F.floor(F.sum("_n").over(own) / 2))
    return placed.filter((F.col("_upto") > F.col("_middle")) & (F.col("_upto") - F.col("_n") <= F.col("_middle"))).select(by, F.col(value).alias("upper_median"))


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table, in one query."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def feed_rollup(fetches: DataFrame) -> DataFrame:
    """Per feed of (feed, seq, ok, items): fetches, failures, empty ones, the rate of success, and a status from the newest fetch."""
    ok, items = F.col("ok"), F.col("items")
    newest = F.max_by(F.when(~ok, "failing").when(items == 0, "idle").otherwise("healthy"), "seq")
    bad = F.count_if(~ok)
    return fetches.groupBy("feed").agg(F.count(F.lit(1)).alias("fetches"), bad.alias("failures"), F.count_if(ok & (items == 0)).alias("empty"), (1 - bad / F.count(F.lit(1))).alias("success_rate"), newest.alias("status"))


def last_of_each(rows: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """The ``keep`` last rows of each key; every task keeps its own last ones before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= keep).drop("_r")


def overview(records: DataFrame) -> DataFrame:
    """(level, distribution, value, n) over the relevant records: five distributions, each one's total, and that of all, in one pass.

    level is ``value``, ``distribution`` (value is null) or ``all`` (both are).
    """
    lists = {"asset_class": "asset_classes", "reason_code": "impact_reason_codes", "symbol": "candidate_symbols"}
    single = {"sentiment": "sentiment_label", "domain": "domain"}
    none = F.array().cast("array<string>")

    def each(distribution: str, values: str) -> Column:
        return F.transform(F.coalesce(values, none), lambda v: F.struct(F.lit(distribution).alias("distribution"), v.alias("value")))

    marks = [each(*x) for x in lists.items()]
    marks += [F.array(F.struct(F.lit(d).alias("distribution"), F.col(c).alias("value"))) for d, c in single.items()]
    rows = records.filter("is_finance_relevant").select(F.inline(F.concat(*marks))).filter("value is not null")
    d, v = F.col("distribution"), F.col("value")
    counted = rows.groupingSets([[d, v], [d], []], d, v).agg(F.grouping_id().alias("id"), F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("id") == 0, "value").when(F.col("id") == 1, "distribution").otherwise("all")
    return counted.select(level.alias("level"), "distribution", "value", "n")
