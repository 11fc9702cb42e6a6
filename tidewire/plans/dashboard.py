"""The dashboard: several signals over one corpus, each on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.plans import bursts, mix, stories
from tidewire.session import materialize
from tidewire.sources.records import timed

Signal = Callable[[DataFrame], DataFrame]


def ordered_clusters(records: DataFrame, top: int | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """Event clusters of two outlets or more, the earliest first; ``clusters`` are those of ``records`` where they are known."""
    rows = (stories.cluster_records(records, domains=2) if clusters is None else clusters).orderBy(F.asc_nulls_last("first_us"), "cluster_id")
    return rows.limit(top) if top else rows


#: Of rows that say their own place in a signal's order.
RANK, NUMBER = "_rank", "_number"


def ranked_clusters(clusters: DataFrame, top: int) -> DataFrame:
    """``ordered_clusters`` of a table with ``NUMBER`` for each, with ``RANK``: what is put in order are times and ids, never rows with all their members."""
    order = [F.asc_nulls_last("first_us"), "cluster_id", NUMBER]
    first = clusters.select("first_us", "cluster_id", NUMBER).orderBy(*order).limit(top)
    first = first.select(NUMBER, F.row_number().over(Window.orderBy(*order)).alias(RANK))
    return clusters.join(F.broadcast(first), NUMBER).drop(NUMBER)


def leaderboard(records: DataFrame) -> DataFrame:
    """Scorecards of the thirty days up to the newest record, best first."""
    newest = timed(records).agg(F.max("us")).first()[0]
    return stories.source_scorecards(records, newest or 0).orderBy(F.desc(F.round("composite", 9)), "domain")


def leaders(records: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Who leads the event clusters, strongest first."""
    clusters = stories.cluster_records(records, domains=2) if clusters is None else clusters
    scores = stories.lead_lag_scores(stories.lead_lag_events(clusters, records))
    return scores.orderBy(F.desc(F.round("composite", 9)), F.desc("led"), "domain")


#: Each signal as the dashboard shows it: in order, and cut where its list can grow with the records.
SIGNALS: dict[str, Signal] = {
    "clusters": lambda r: ordered_clusters(r, 50),
    "leaderboard": leaderboard,
    "novelty": lambda r: stories.novelty(r, 200).orderBy(F.length("capture_id"), "capture_id").limit(100),
    "lead_lag": leaders,
    "regime_shifts": lambda r: mix.regime_shifts(r).filter("shift").orderBy("bucket"),
    "momentum": lambda r: mix.sentiment_momentum(r, top=25),
    "co_occurrence": mix.top_cells,
    "volume_anomalies": lambda r: bursts.volume_anomalies(r).orderBy("bucket"),
    "sentiment_shocks": lambda r: bursts.sentiment_shocks(r).orderBy("bucket"),
    "symbol_bursts": lambda r: bursts.symbol_bursts(r, top=25),
    "spillover": lambda r: bursts.spillover(r).orderBy(F.desc(F.round("score", 9)), F.desc("co"), "source", "target"),
    "velocity": bursts.news_velocity,
}


def sharing_clusters(signals: dict[str, Signal]) -> dict[str, Signal]:
    """The signals with those of event clusters over one table of them, which is made when the first one asks."""
    known: list[DataFrame] = []

    def clusters(records: DataFrame) -> DataFrame:
        if not known:
            known.append(materialize(stories.cluster_records(records, domains=2).withColumn(NUMBER, F.monotonically_increasing_id()), "dashboard-clusters"))
        return known[0]

    return signals | {"clusters": lambda r: ranked_clusters(clusters(r), 50), "lead_lag": lambda r: leaders(r, clusters(r))}


def snapshot(records: DataFrame, signals: dict[str, Signal] | None = None) -> DataFrame:
    """(signal, rank, item, error): the items of every signal in its order, as JSON, over the same cached corpus.

    A signal that fails has one row that says so, and the others go on; one
    without items has one row of rank 0.  The lists are the signals' reports,
    a few dozen items each, but an item can be long (all ids of a cluster), so
    they are written, and the driver has none of them.
    """
    spark = records.sparkSession
    signals = signals or sharing_clusters(SIGNALS)
    corpus = records.persist(StorageLevel.MEMORY_AND_DISK)
    out, schema = None, "signal string, rank int, item string, error string"
    try:
        for name, signal in signals.items():
            try:
                items = signal(corpus)
                item = F.to_json(F.struct(*(c for c in items.columns if c != RANK))).alias("item")
                if RANK in items.columns:
                    items = items.select(item, F.col(RANK).cast("int").alias("rank"))
                else:
                    order = Window.orderBy("_at")
                    items = items.select(item, F.monotonically_increasing_id().alias("_at")).withColumn("rank", F.row_number().over(order).cast("int"))
                rows = materialize(items.select(F.lit(name).alias("signal"), "rank", "item", F.lit(None).cast("string").alias("error")), "dashboard-items")
                if rows.isEmpty():
                    rows = spark.createDataFrame([(name, 0, None, None)], schema)
            except Exception as error:  # a signal's own failure is part of the report
                rows = spark.createDataFrame([(name, 0, None, type(error).__name__)], schema)
            out = rows if out is None else out.unionByName(rows)
    finally:
        corpus.unpersist()
    return spark.createDataFrame([], schema) if out is None else out


def counts(snapshot: DataFrame) -> DataFrame:
    """(signal, rows, error) of a snapshot."""
    return snapshot.groupBy("signal").agg(F.count_if(F.col("rank") > 0).alias("rows"), F.max("error").alias("error"))


def live_context(records: DataFrame) -> DataFrame:
    """One row: the digest that the live read is written from, the strongest few of each signal."""
    def best(rows: DataFrame, order: list, fields: list, top: int, out: str) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(*order))
        first = rows.orderBy(*order).limit(top).withColumn("rank", rank)
        items = F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("item"))))
        return first.agg(F.transform(items, lambda x: x["item"]).alias(out))

    clusters = materialize(stories.cluster_records(records, domains=2), "live-clusters")
    few = lambda c, n: F.slice(c, 1, n).alias(c)
    parts = [
        clusters.agg(F.count(F.lit(1)).alias("clusters")),
        mix.regime_shifts(records).agg(F.count_if("shift").alias("regime_shifts")),
        bursts.volume_anomalies(records).agg(F.count(F.lit(1)).alias("volume_anomalies")),
        bursts.sentiment_shocks(records).agg(F.count(F.lit(1)).alias("sentiment_shocks")),
        best(bursts.symbol_bursts(records, samples=False), [F.desc(F.round("z", 9)), "symbol", "bucket"], ["symbol", "observed", "z"], 3, "bursts"),
        best(bursts.spillover(records), [F.desc(F.round("score", 9)), F.desc("co"), "source", "target"], ["source", "target", "score"], 3, "spillovers"),
        best(mix.sentiment_momentum(records), [F.desc(F.abs(F.round("momentum", 9))), "symbol"], ["symbol", "momentum", "direction"], 5, "tickers"),
        best(clusters, [F.asc_nulls_last("first_us"), "cluster_id"], ["size", "coherence", few("symbols", 3), few("reasons", 2), few("domains", 3)], 3, "top_clusters"),
        best(leaderboard(records), [F.desc(F.round("composite", 9)), "domain"], ["domain"], 1, "sources"),
    ]
    out = records.agg(F.count(F.lit(1)).alias("records"))
    for part in parts:  # one row each
        out = out.crossJoin(F.broadcast(part))
    return out.select("*", F.get("sources", 0)["domain"].alias("top_source")).drop("sources")


def has_signal(context: Column) -> Column:
    """Whether a digest (its columns as one struct) says anything at all."""
    counted = [context[c] > 0 for c in ("records", "clusters", "regime_shifts", "volume_anomalies", "sentiment_shocks")]
    listed = [F.size(context[c]) > 0 for c in ("bursts", "spillovers", "tickers", "top_clusters")]
    out = context["top_source"].isNotNull()
    for x in (*counted, *listed):
        out = out | F.coalesce(x, F.lit(False))
    return out


def live_read(records: DataFrame) -> DataFrame:
    """The short digest: the strongest of four signals, as (section, rank, text)."""
    parts = [
        (bursts.volume_anomalies(records), F.desc(F.abs("z")), F.format_string("%d records, %s", "observed", "severity"), "volume", 3),
        (mix.regime_shifts(records).filter("shift"), F.desc("kl"), F.format_string("divergence %.2f", "kl"), "regime", 3),
        (mix.sentiment_momentum(records), F.desc(F.abs("momentum")), F.concat_ws(" ", "symbol", "direction"), "momentum", 5),
        (bursts.spillover(records), F.desc("score"), F.concat_ws(" to ", "source", "target"), "spillover", 3),
    ]
    out = None
    for rows, order, text, section, top in parts:
        best = rows.withColumn("text", text).orderBy(order, "text").limit(top)
        ranked = best.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(order, "text")).alias("rank"), "text")
        out = ranked if out is None else out.union(ranked)
    return out
