"""Writes: idempotent upserts, archives, exports and error rows."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.text import csv_safe
from tidewire.session import materialize, scratch_removed


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str = "created_at") -> DataFrame:
    """``old`` with the rows of ``new``: of a key the newest row stays, one of ``new`` on ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new")))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    return both.withColumn("_r", rank).filter("_r = 1").drop("_r", "_new")


def _digest(rows: DataFrame) -> Column:
    """SHA-256 of a row's columns: what two rows with equal keys are compared by."""
    exact = {f"{kind}Format": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" + zone for kind, zone in (("timestamp", "XXX"), ("timestampNTZ", ""))}
    return F.unhex(F.sha2(F.to_json(F.struct(*rows.columns), exact), 256))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as error:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None


#: Files of a bucket from which it is written as one again.
MANY_FILES = 16


def overwrite_buckets(new: DataFrame, path: str, keys: list[str], order: str = "created_at", buckets: int = 64) -> None:
    """Upsert into a table partitioned by a hash of its keys; of a key the newest row stays, one of ``new`` on ties.

    Rows of keys that the table lacks are added to their buckets.  Only buckets
    in which a row is replaced by another one (or that have come to many files)
    are read whole and rewritten, so a batch that runs again writes nothing.
    What is compared are keys, and digests of the rows of buckets that hold a
    key of ``new``; both steps may run again after a failure.
    """
    spark = new.sparkSession
    with scratch_removed(spark):
        # Evaluated once, and apart from the files that are about to be replaced.
        fresh = materialize(new.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "upsert")
        stored = _stored(spark, path)
        rows, files = fresh.select("bucket", *keys, F.lit(1).alias("_new")), Counter()
        if stored is not None:
            files.update(int(x) for f in stored.inputFiles() for x in re.findall(r"/bucket=(\d+)/", f))
            old = stored.join(F.broadcast(fresh.select("bucket").distinct()), "bucket", "left_semi").select(*fresh.columns)
            rows = rows.unionByName(old.select("bucket", *keys, F.lit(0).alias("_new")))
        seen = rows.groupBy("bucket", *keys).agg(F.sum("_new").alias("n"), F.count_if(F.col("_new") == 0).alias("held")).filter("n > 0")
        # One row for each bucket.
        told = seen.groupBy("bucket").agg(F.count_if(F.col("held") == 0).alias("added"), F.count_if(F.col("held") > 0).alias("met"), F.count_if(F.col("n") > 1).alias("doubled")).collect()
        if any(r["doubled"] for r in told):
            rank = F.row_number().over(Window.partitionBy("bucket", *keys).orderBy(F.desc(order), F.desc("_digest")))
            fresh = fresh.withColumn("_digest", _digest(fresh)).withColumn("_r", rank).filter("_r = 1").drop("_digest", "_r")
        met = [r["bucket"] for r in told if r["met"]]
        added = [r["bucket"] for r in told if r["added"]]
        whole = {b for b in added if files[b] >= MANY_FILES}
        if met:
            of = F.col("bucket").isin(met)
            lines = lambda rows, name: rows.filter(of).select("bucket", *keys, F.struct(F.col(order).alias("at"), _digest(rows).alias("digest")).alias(name))
            pairs = lines(fresh, "new").unionByName(lines(old, "old"), allowMissingColumns=True).groupBy("bucket", *keys).agg(F.max("new").alias("new"), F.max("old").alias("old"))
            later = F.col("old.at").isNull() | F.coalesce(F.col("new.at") >= F.col("old.at"), F.lit(False))
            replaced = pairs.filter(F.col("new").isNotNull() & F.col("old").isNotNull() & later & (F.col("new.digest") != F.col("old.digest")))
            whole |= {r["bucket"] for r in replaced.select("bucket").distinct().collect()}
        rest = [b for b in added if b not in whole]
        if rest:
            more = fresh.filter(F.col("bucket").isin(rest))
            if set(rest) & set(met):
                held = old.filter(F.col("bucket").isin(rest)).select(*(F.col(c).alias(f"_held_{c}") for c in ("bucket", *keys)))
                more = more.join(held, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_held_{c}")) for c in ("bucket", *keys))), "left_anti")
            more.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
        if whole:
            of = F.col("bucket").isin(*whole)
            # Rows are held apart from the files that are about to be replaced.
            merged = materialize(upserted(old.filter(of), fresh.filter(of), keys, order), "upsert")
            merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def newest_per_table(rows: DataFrame, keep: int, order: str = "id") -> DataFrame:
    """The ``keep`` newest rows, by a limit and not a sort of all."""
    return rows.orderBy(F.desc(order)).limit(keep)


def to_archive(records: DataFrame, archived: DataFrame, cap: int = 150, most: int = 2000) -> DataFrame:
    """Records past the ``cap`` newest that the archive lacks, the oldest ``most`` of them."""
    newest = records.orderBy(F.desc("created_at"), F.desc("capture_id")).limit(cap).select("capture_id")
    rest = records.join(newest, "capture_id", "left_anti").join(archived.select("capture_id"), "capture_id", "left_anti")
    return rest.orderBy("created_at", "capture_id").limit(most)


def csv_projection(records: DataFrame) -> DataFrame:
    """The 17 flat columns of the archive, safe for spreadsheets."""
    have = set(records.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    joined = lambda c: F.coalesce(F.array_join(c, ", "), F.lit("")) if c in have else F.lit("")
    number = lambda c: F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("")) if c in have else F.lit("")
    flag = lambda c: F.when(F.col(c), "1").otherwise("0") if c in have else F.lit("0")
    one_line = lambda x: F.translate(x, "\n\r", "  ")
    evidence = F.transform(F.slice("evidence_sentences", 1, 3), lambda s: F.substring(F.trim(s), 1, 240)) if "evidence_sentences" in have else F.array().cast("array<string>")
    parts = F.filter(F.concat(F.array(F.trim(text("reason_text"))), F.coalesce(evidence, F.array().cast("array<string>"))), lambda s: s != "")
    return records.select(
        text("created_at").alias("ingested_at"), text("published_ts").alias("published_at"), csv_safe(text("domain")).alias("domain"), csv_safe(one_line(text("title"))).alias("title"),
        csv_safe(text("url")).alias("url"), number("finance_relevance_score").alias("score"), flag("is_finance_relevant").alias("is_finance_relevant"),
        csv_safe(joined("asset_classes")).alias("asset_classes"), csv_safe(joined("impact_reason_codes")).alias("reason_codes"), csv_safe(joined("candidate_symbols")).alias("symbols"),
        csv_safe(text("sentiment_label")).alias("sentiment_label"), number("sentiment_score").alias("sentiment_score"), csv_safe(F.substring(one_line(F.array_join(parts, " // ")), 1, 2000)).alias("reasoning"),
        csv_safe(text("language")).alias("language"), csv_safe(text("processing_mode")).alias("processing_mode"), flag("diagnostic_multimodal_enabled").alias("diagnostic_enabled"), text("capture_id").alias("capture_id"),
    )


def write_archive(rows: DataFrame, path: str) -> None:
    csv_projection(rows).write.mode("append").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def error_rows(bad: DataFrame, payload: str, error: str, most: int = 4000) -> DataFrame:
    """Rows for the table of failures, with the start of what failed."""
    return bad.select("capture_id", F.lit(error).alias("error"), F.substring(payload, 1, most).alias("payload_excerpt"))


def export_csv_columns(records: DataFrame) -> DataFrame:
    """The flat export: lists joined by semicolons."""
    lists = {c for c, kind in records.dtypes if kind == "array<string>"}
    return records.select(*(F.array_join(c, ";").alias(c) if c in lists else F.col(c) for c in records.columns))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def flatten_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with the payload's fields beside the others, lists joined."""
    payload = [f.name for f in reviews.schema["payload"].dataType.fields]
    out = reviews.select(*(c for c in reviews.columns if c != "payload"), *(F.col(f"payload.{f}").alias(f"payload_{f}") for f in payload))
    return export_csv_columns(out)


def wanted_by_hook(records: DataFrame, floor: float, **lists: list[str]) -> DataFrame:
    """What a webhook is sent: enough score, and one of the values in each list that asks for some."""
    from tidewire.operators.lookup import any_of, at_least

    return any_of(at_least(records, floor), **lists)
