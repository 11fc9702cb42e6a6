"""Filters, lookups, tags, search and top-k over records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import safe_tag
from tidewire.functions.time import epoch_us, event_time
from tidewire.schemas import LABEL_LISTS
from tidewire.session import materialize

SUMMARY = ["capture_id", "title", "domain", "published_ts", "is_finance_relevant", "finance_relevance_score", "asset_classes", "impact_reason_codes", "candidate_symbols", "sentiment_label", "sentiment_score"]


def label_index(records: DataFrame) -> DataFrame:
    """(capture_id, kind, value): one row for each distinct label of a record; one pass over the records."""
    kinds = [F.struct(F.lit(kind).alias("kind"), F.array_distinct(c).alias("vals")) for kind, c in LABEL_LISTS.items() if c in records.columns]
    return records.select("capture_id", F.inline(F.array(*kinds))).select("capture_id", "kind", F.explode("vals").alias("value"))


def relevant_only(records: DataFrame) -> DataFrame:
    return records.filter("is_finance_relevant")


def with_label(records: DataFrame, column: str, value: str) -> DataFrame:
    return records.filter(F.array_contains(column, value))


def any_of(records: DataFrame, **lists: list[str]) -> DataFrame:
    """Records that hold one of the values in every given list column; an empty list asks nothing."""
    for column, values in lists.items():
        if values:
            records = records.filter(F.arrays_overlap(column, F.array(*map(F.lit, values))))
    return records


def at_least(records: DataFrame, score: float) -> DataFrame:
    return records.filter(F.coalesce("finance_relevance_score", F.lit(0.0)) >= score)


def search(records: DataFrame, text: str) -> DataFrame:
    """Records whose title, domain or a symbol holds the text, whatever its case."""
    low = F.lit(text.lower())
    symbols = F.exists("candidate_symbols", lambda s: F.contains(F.lower(s), low))
    return records.filter(F.contains(F.lower(F.coalesce("title", F.lit(""))), low) | F.contains(F.lower(F.coalesce("domain", F.lit(""))), low) | F.coalesce(symbols, F.lit(False)))


def search_clusters(clusters: DataFrame, text: str) -> DataFrame:
    """Event clusters whose id, a symbol, a reason or an outlet holds the text, whatever its case."""
    low = F.lit(text.lower())
    hit = F.contains(F.lower("cluster_id"), low)
    for c in ("symbols", "reasons", "domains"):
        hit = hit | F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), low)), F.lit(False))
    return clusters.filter(hit)


def not_known(captures: DataFrame, records: DataFrame, key: str = "capture_id") -> DataFrame:
    """Captures that aren't records yet; of ``records`` only the key is read."""
    return captures.join(records.select(key), key, "left_anti")


def summary(records: DataFrame) -> DataFrame:
    """The compact projection, which the scan reads alone; with a preview of the evidence where there is any."""
    out = [c for c in SUMMARY if c in records.columns]
    more = [F.substring(F.array_join("evidence_sentences", " "), 1, 240).alias("evidence_preview")] if "evidence_sentences" in records.columns else []
    return records.select(*out, *more)


def redact(records: DataFrame, safe_mode: bool) -> DataFrame:
    if not safe_mode or "diagnostic_multimodal_result" not in records.columns:
        return records
    return records.withColumn("diagnostic_multimodal_result", F.lit(None).cast(records.schema["diagnostic_multimodal_result"].dataType))


def event_us() -> Column:
    return epoch_us(event_time(F.col("published_ts"), F.col("created_at")))


def since_newest(records: DataFrame, window_s: int) -> DataFrame:
    """Records of the window that ends with the newest one."""
    rows = records.withColumn("us", event_us())
    top = rows.agg((F.max("us") - window_s * 1_000_000).alias("lo"))
    return rows.join(F.broadcast(top), F.col("us") >= F.col("lo")).drop("lo")


def between(records: DataFrame, as_of_us: int, days: int, ahead_days: int = 1) -> DataFrame:
    day = 86_400_000_000
    return records.withColumn("us", event_us()).filter(F.col("us").between(as_of_us - days * day, as_of_us + ahead_days * day))


def not_older(records: DataFrame, as_of_us: int, age_s: int) -> DataFrame:
    """Records of at most that age; those of the future stay."""
    return records.withColumn("us", event_us()).filter(F.col("us") >= as_of_us - age_s * 1_000_000)


def newest(records: DataFrame, n: int) -> DataFrame:
    """The ``n`` records that came last: a top-k, not a sort."""
    return records.orderBy(F.desc("created_at"), F.desc(F.length("capture_id")), F.desc("capture_id")).limit(n)


def first_per_key(records: DataFrame, key: str) -> DataFrame:
    """The earliest record of each key, by event time, then id: one row per key from each task, never a key's rows together."""
    rows = records.withColumn("us", event_us()).filter("us is not null")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("us", F.length("capture_id"), "capture_id"))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")


def top_recent(records: DataFrame, among: int = 200, score: float = 0.5, n: int = 10) -> DataFrame:
    """The best of the ``among`` newest: the first limit comes before the filter."""
    return at_least(newest(records, among), score).orderBy(F.desc("finance_relevance_score"), F.length("capture_id"), "capture_id").limit(n)


def by_label(records: DataFrame, labels: DataFrame, kind: str, value: str, n: int) -> DataFrame:
    """The newest ``n`` records of a label, through the index."""
    hits = labels.filter((F.col("kind") == kind) & (F.col("value") == value)).select("capture_id")
    return newest(records.join(hits, "capture_id", "left_semi"), n)


def add_tags(tags: DataFrame, more: DataFrame) -> DataFrame:
    """Valid new tags join the old; a pair stays as it was first."""
    good = more.withColumn("tag", safe_tag(F.col("tag"))).filter("tag is not null")
    rank = F.row_number().over(Window.partitionBy("capture_id", "tag").orderBy("created_at"))
    return tags.unionByName(good.select(*tags.columns)).withColumn("_r", rank).filter("_r = 1").drop("_r")


def remove_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone, ["capture_id", "tag"], "left_anti")


def tag_counts(tags: DataFrame, top: int) -> DataFrame:
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(top)


def nearest_vectors(vectors: DataFrame, query: list[float], k: int, id: str, vector: str) -> DataFrame:
    """The ``k`` vectors of greatest cosine with one query vector: each task keeps its own best."""
    from tidewire.functions.sets import cosine

    score = cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))
    return vectors.select(id, score.alias("score")).orderBy(F.desc("score"), id).limit(k)


def category(domain: Column, ladder: list[tuple[str, list[str]]], default: str = "other") -> Column:
    """The first category with a domain that this one is or ends in, on a dot."""
    out, d = F.lit(default), F.lower(domain)
    for name, domains in reversed(ladder):
        hit = F.lit(False)
        for x in domains:
            hit = hit | (d == x) | F.endswith(d, F.lit("." + x))
        out = F.when(hit, name).otherwise(out)
    return out


def first_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the parts in order; of rows equal in any one of the keys the first stays, key after key."""
    spread = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = spread[0]
    for p in spread[1:]:
        out = out.unionByName(p)
    for key in keys:
        rank = F.row_number().over(Window.partitionBy(key).orderBy("_part", *(k for k in keys if k != key)))
        out = out.withColumn("_r", rank).filter("_r = 1").drop("_r")
    return out.drop("_part")


def admitted(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """The rows that a catalog takes in ``order`` (a column of distinct values): each that shares no key's value with one taken before it.

    A row that isn't taken stands in nobody's way.  In each round the undecided
    rows that come first in all of their groups are taken, and those that share
    a value with one just taken are refused; what is left goes on, until nothing
    is.  A null value is shared with nobody.  Rounds are as many as the longest
    run of rows that wait for each other.
    """
    left, taken = materialize(rows, "catalog-rows"), []
    while not left.isEmpty():
        first = left
        for k in keys:
            heads = left.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_first_{k}"))
            first = first.join(heads, k, "left")
        ahead = [F.col(f"_first_{k}").isNull() | (F.col(f"_first_{k}") == F.col(order)) for k in keys]
        new = materialize(first.filter(reduce(lambda a, b: a & b, ahead)).select(*rows.columns), "catalog-taken")
        taken.append(new)
        rest = left.join(new.select(order), order, "left_anti")
        for k in keys:
            rest = rest.join(new.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti")
        left = materialize(rest.select(*rows.columns), "catalog-rows")
    return reduce(DataFrame.unionByName, taken, rows.limit(0))
