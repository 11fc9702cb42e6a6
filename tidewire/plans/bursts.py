"""Signals over time buckets: anomalies, velocity, spillover and symbol correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.time import floor_to, minute_anchor
from tidewire.plans.mix import first_samples
from tidewire.session import materialize
from tidewire.sources.records import timed

MINUTE = 60_000_000


def severity(z: Column) -> Column:
    return F.when(F.abs(z) >= 4, "high").when(F.abs(z) >= 3, "medium").otherwise("low")


def anchored(records: DataFrame, minutes: int) -> DataFrame:
    """Timed records with ``bucket`` (seconds): counted from the first record's floored minute.

    The anchor is a one-row aggregate, joined by broadcast.
    """
    rows = timed(records)
    anchor = rows.agg(minute_anchor(F.min("us"), minutes).alias("anchor"))
    placed = rows.crossJoin(F.broadcast(anchor))
    return placed.withColumn("bucket", (floor_to(F.col("us"), minutes * MINUTE, F.col("anchor")) / 1_000_000).cast("long")).drop("anchor")


def frame_std(values: Column) -> Column:
    """The sample deviation of an array, in its order, by the running update that SQL engines use; null for fewer than two.

    A z at its threshold to the last bit, as small counts give, depends on how the deviation was summed: Spark's own
    ``stddev_samp`` multiplies the two differences of an update another way.
    """
    def more(s: Column, x: Column) -> Column:
        n = s["n"] + F.lit(1.0)
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (x - mean) * (x - s["mean"])).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(values, start, more, lambda s: F.when(s["n"] > 1, F.sqrt(s["m2"] / F.when(s["n"] > 1, s["n"] - 1))))


def rolling_z(rows: DataFrame, value: str, window: int, least: int = 3, by: list[str] | None = None) -> DataFrame:
    """Add mean, std and z of ``value`` against the ``window`` buckets before it; null with fewer than ``least``, z 0 for a flat past.

    Rows are buckets, so the window holds time / bucket size rows per key, not records.
    """
    frame = Window.partitionBy(*(by or [])).orderBy("bucket").rowsBetween(-window, -1)
    enough = F.count(value).over(frame) >= least
    std = frame_std(F.collect_list(value).over(frame))
    rows = rows.withColumn("mean", F.when(enough, F.avg(value).over(frame))).withColumn("std", F.when(enough, F.coalesce(std, F.lit(0.0))))
    flat = F.col("std") <= 1e-12
    return rows.withColumn("z", F.when(F.col("mean").isNotNull(), F.when(flat, 0.0).otherwise((F.col(value) - F.col("mean")) / F.when(~flat, F.col("std")))))


def volume_anomalies(records: DataFrame, minutes: int = 30, window: int = 12, threshold: float = 2.0) -> DataFrame:
    """Buckets whose number of records is far from that of the buckets before it, either way."""
    counts = anchored(records, minutes).groupBy("bucket").agg(F.count(F.lit(1)).cast("double").alias("observed"))
    found = rolling_z(counts, "observed", window).filter(F.abs("z") >= threshold)
    return found.select("bucket", F.col("observed").cast("long").alias("observed"), "mean", "std", "z", severity(F.col("z")).alias("severity"))


def net_sentiment() -> Column:
    """(positive - negative) / labelled of the group; null without labels."""
    label = F.col("sentiment_label")
    return F.try_divide(F.count_if(label == "positive") - F.count_if(label == "negative"), F.count_if(label.isin("positive", "neutral", "negative")))


def sentiment_shocks(records: DataFrame, minutes: int = 30, window: int = 12, threshold: float = 2.0, level: float = 0.20) -> DataFrame:
    """Buckets whose net sentiment is far from that of the labelled buckets before it."""
    nets = anchored(records, minutes).groupBy("bucket").agg(net_sentiment().alias("net")).filter("net is not null")
    found = rolling_z(nets, "net", window).filter(F.abs("z") >= threshold)
    direction = F.when((F.col("z") > 0) & (F.col("net") > level), "bullish_shock").when((F.col("z") < 0) & (F.col("net") < -level), "bearish_shock").otherwise("neutral")
    return found.select("bucket", "net", "mean", "std", "z", direction.alias("direction"))


def symbol_bursts(records: DataFrame, minutes: int = 30, window: int = 12, threshold: float = 2.0, top: int | None = None, samples: bool = True) -> DataFrame:
    """Symbols named far more often in a bucket than in the ``window`` non-empty buckets before it, with three of the records; with ``top`` the strongest, in order.

    A symbol's silent buckets count as zero.  They aren't made: the mean over
    the window is the sum of the symbol's own counts in it over the number of
    buckets in it, found by the buckets' ordinal numbers.
    """
    rows = anchored(records, minutes)
    symbols = F.array_distinct(F.filter(F.transform("candidate_symbols", lambda s: F.trim(s)), lambda s: s != ""))
    # Records pass once; a bucket without symbols still counts.
    counted = materialize(rows.select("bucket", F.explode_outer(symbols).alias("symbol")).groupBy("symbol", "bucket").agg(F.count(F.lit(1)).alias("observed")), "burst-counts")
    ordinals = counted.select("bucket").distinct().withColumn("i", F.row_number().over(Window.orderBy("bucket")) - 1)
    named = rows.select("bucket", "capture_id", "us", F.explode(symbols).alias("symbol"))
    counts = counted.filter("symbol is not null").join(ordinals, "bucket")
    frame = Window.partitionBy("symbol").orderBy("i").rangeBetween(-window, -1)
    n = F.least(F.col("i"), F.lit(window))
    mean = F.coalesce(F.sum("observed").over(frame), F.lit(0)) / n
    found = counts.filter("i >= 0").withColumn("mean", F.when(F.col("i") >= 3, mean))
    found = found.withColumn("z", (F.col("observed") - F.col("mean")) / F.sqrt(F.greatest(F.lit(1.0), F.col("mean"))))
    found = found.filter((F.col("observed") >= 2) & (F.col("z") >= threshold)).select("symbol", "bucket", "observed", "mean", "z")
    order = [F.desc(F.round("z", 9)), "symbol", "bucket"]
    found = found.orderBy(*order).limit(top) if top else found
    if not samples:
        return found
    own = named.join(found.select("symbol", "bucket"), ["symbol", "bucket"], "left_semi")
    out = found.join(first_samples(own, ["symbol", "bucket"], ["us", "capture_id"], "capture_id", "samples"), ["symbol", "bucket"], "left")
    return out.orderBy(*order) if top else out


def news_velocity(records: DataFrame, bucket_minutes: int = 5, window_minutes: int = 60) -> DataFrame:
    """One row: the latest rate, its exponential averages, median, deviation, z and regime over the window before the newest record."""
    size = bucket_minutes * 60
    rows = timed(records).select(F.floor(F.col("us") / 1_000_000).alias("s"), "us")
    # One number, so that the window is a plain filter.
    top = rows.agg(F.max("us")).first()[0]
    newest = records.sparkSession.createDataFrame([(top,)], "top long")
    span = newest.select(
        F.col("top").alias("top"),
        floor_to(F.floor((F.col("top") - window_minutes * MINUTE) / 1_000_000), size).alias("lo"),
        floor_to(F.floor(F.col("top") / 1_000_000), size).alias("hi"),
    ).filter("top is not null")
    recent = rows.filter(F.lit(False) if top is None else F.col("us") >= top - window_minutes * MINUTE)
    counts = recent.groupBy(floor_to(F.col("s"), size).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spine = span.select(F.explode(F.sequence("lo", "hi", F.lit(size).cast("long"))).alias("bucket"))
    series = spine.join(counts, "bucket", "left").select("bucket", (F.coalesce("n", F.lit(0)) / bucket_minutes).alias("rate"))
    order = Window.orderBy("bucket")
    series = series.withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))

    def ema(a: float) -> Column:
        weight = F.when(F.col("i") == 1, F.pow(F.lit(1 - a), F.col("n") - 1)).otherwise(a * F.pow(F.lit(1 - a), F.col("n") - F.col("i")))
        return F.sum(weight * F.col("rate"))

    out = series.groupBy().agg(
        F.max_by("rate", "bucket").alias("rate"), ema(0.3).alias("ema_fast"), ema(0.05).alias("ema_slow"),
        F.percentile("rate", 0.5).alias("median"), F.coalesce(F.stddev_samp("rate"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("buckets"),
    ).filter("buckets > 0")
    z = F.when(F.col("std") <= 1e-12, 0.0).otherwise((F.col("rate") - F.col("median")) / F.when(F.col("std") > 1e-12, F.col("std")))
    out = out.withColumn("z", z)
    return out.withColumn("regime", F.when(F.col("z") >= 2, "burst").when(F.col("z") >= 1, "active").when(F.col("z") <= -1, "quiet").otherwise("calm"))


def asset_grid(records: DataFrame, minutes: int = 30) -> DataFrame:
    """(asset, bucket, observed) on the dense grid of buckets between the first and last record with assets.

    The grid has keys x buckets rows, whatever the number of records.
    """
    size = minutes * 60
    rows = timed(records).filter(F.size("asset_classes") > 0).select(floor_to(F.floor(F.col("us") / 1_000_000), size).alias("bucket"), F.explode(F.array_distinct("asset_classes")).alias("asset"))
    # Records pass once.
    counts = materialize(rows.groupBy("asset", "bucket").agg(F.count(F.lit(1)).alias("observed")), "asset-counts")
    ends = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).filter("lo is not null")
    # Each asset class spreads its own buckets: only the two ends are sent round.
    grid = counts.select("asset").distinct().crossJoin(F.broadcast(ends)).select("asset", F.explode(F.sequence("lo", "hi", F.lit(size).cast("long"))).alias("bucket"))
    return grid.join(counts, ["asset", "bucket"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)).cast("double"))


def surges(records: DataFrame, minutes: int = 30, threshold: float = 1.5, window: int = 8) -> DataFrame:
    grid = rolling_z(asset_grid(records, minutes), "observed", window, by=["asset"])
    i = F.row_number().over(Window.partitionBy("asset").orderBy("bucket")) - 1
    return grid.withColumn("i", i).withColumn("buckets", F.count(F.lit(1)).over(Window.partitionBy("asset"))).withColumn("surge", F.coalesce(F.col("z") >= threshold, F.lit(False)))


def spillover(records: DataFrame, minutes: int = 30, lag: int = 1, threshold: float = 1.5, least: int = 2) -> DataFrame:
    """Edges from an asset class to one that surges ``lag`` buckets after it more often than it does anyway."""
    rows = surges(records, minutes, threshold)
    eligible = rows.filter((F.col("i") >= F.least(F.lit(3), F.col("buckets"))) & (F.col("i") < F.col("buckets") - lag))
    source = eligible.filter("surge").select(F.col("asset").alias("source"), "i")
    ahead = rows.filter("surge").select(F.col("asset").alias("target"), (F.col("i") - lag).alias("i"))
    spans = eligible.groupBy("asset").agg(F.count(F.lit(1)).alias("eligible"), F.count_if("surge").alias("surges"))
    base = ahead.join(rows.select("asset", "buckets").distinct().withColumnRenamed("asset", "target"), "target")
    base = base.filter((F.col("i") >= F.least(F.lit(3), F.col("buckets"))) & (F.col("i") < F.col("buckets") - lag)).groupBy("target").agg(F.count(F.lit(1)).alias("target_surges"))
    both = source.join(ahead, "i").groupBy("source", "target").agg(F.count(F.lit(1)).alias("co"))
    scored = (
        both.join(spans.select(F.col("asset").alias("source"), "eligible", F.col("surges").alias("source_surges")), "source")
        .join(base, "target")
        .withColumn("score", F.greatest(F.lit(-1.0), F.col("co") / F.col("source_surges") - F.col("target_surges") / F.col("eligible")))
    )
    return scored.filter((F.col("score") > 0) & (F.col("co") >= least)).select("source", "target", "co", "source_surges", "target_surges", "eligible", "score")


def spillover_loops(records: DataFrame, minutes: int = 30, lag: int = 1, threshold: float = 1.5, pivots: int = 3) -> DataFrame:
    """How often each asset class surges again ``lag`` buckets after its own surge, with the first buckets where it did; every class, strongest first."""
    rows = surges(records, minutes, threshold)
    after = rows.filter("surge").select("asset", (F.col("i") - lag).alias("i"), F.lit(True).alias("again"))
    eligible = rows.filter((F.col("i") >= F.least(F.lit(3), F.col("buckets"))) & (F.col("i") < F.col("buckets") - lag)).join(after, ["asset", "i"], "left")
    again, surge = F.coalesce("again", F.lit(False)), F.col("surge")
    out = eligible.groupBy("asset").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(surge).alias("sources"), F.count_if(again).alias("targets"), F.count_if(surge & again).alias("co"))
    own = first_samples(eligible.filter(surge & again), ["asset"], ["bucket"], "bucket", "pivots", pivots)
    score = F.greatest(F.lit(-1.0), F.coalesce(F.try_divide(F.col("co"), F.col("sources")), F.lit(0.0)) - F.col("targets") / F.col("eligible"))
    out = out.join(own, "asset", "left").select("asset", "co", (F.col("sources") - F.col("co")).alias("source_only"), (F.col("targets") - F.col("co")).alias("target_only"), score.alias("score"), F.coalesce("pivots", F.array().cast("array<long>")).alias("pivots"))
    return out.orderBy(F.desc(F.round("score", 9)), F.desc("co"), "asset")


def _correlation_sums(records: DataFrame, minutes: int, least: int, cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sums of each eligible symbol, products of the pairs that share a bucket, and one row with the number of buckets."""
    size = minutes * 60
    symbols = F.array_distinct(F.filter(F.transform("candidate_symbols", lambda s: F.trim(s)), lambda s: s != ""))
    rows = timed(records).select(floor_to(F.floor(F.col("us") / 1_000_000), size).alias("bucket"), F.explode(symbols).alias("symbol"))
    counts = rows.groupBy("symbol", "bucket").agg(F.count(F.lit(1)).cast("double").alias("x"))
    ends = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"), F.count_distinct("bucket").alias("filled")).filter("filled >= 2")
    ends = ends.select(F.greatest("lo", F.col("hi") - (cap - 1) * size).alias("lo"), "hi").withColumn("n", ((F.col("hi") - F.col("lo")) / size + 1).cast("double"))
    totals = counts.groupBy("symbol").agg(F.sum("x").alias("total")).filter(F.col("total") >= least)
    inside = counts.join(F.broadcast(ends), F.col("bucket") >= F.col("lo")).select("symbol", "bucket", "x")
    sums = totals.join(inside.groupBy("symbol").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx")), "symbol", "left").na.fill(0.0, ["sx", "sxx"])
    kept = inside.join(totals.select("symbol"), "symbol", "left_semi")
    shared = kept.alias("p").join(kept.alias("q"), (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.symbol") < F.col("q.symbol")))
    products = shared.groupBy(F.col("p.symbol").alias("a"), F.col("q.symbol").alias("b")).agg(F.sum(F.col("p.x") * F.col("q.x")).alias("sxy"))
    return sums, products, ends.select("n")


def _sides(sums: DataFrame) -> tuple[DataFrame, DataFrame]:
    left, right = (sums.select(*(F.col(c).alias(f"{c}_{side}") for c in sums.columns)) for side in "ab")
    return left.withColumnRenamed("symbol_a", "a"), right.withColumnRenamed("symbol_b", "b")


def _correlated(pairs: DataFrame) -> DataFrame:
    n = F.col("n")
    spread = lambda s: n * F.col(f"sxx_{s}") - F.col(f"sx_{s}") * F.col(f"sx_{s}")
    r = F.try_divide(n * F.coalesce("sxy", F.lit(0.0)) - F.col("sx_a") * F.col("sx_b"), F.sqrt(F.greatest(spread("a") * spread("b"), F.lit(0.0))))
    return pairs.select("a", "b", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0)))).alias("r"), (F.col("total_a") + F.col("total_b")).cast("long").alias("mentions"))


def symbol_correlation(records: DataFrame, minutes: int = 60, least: int = 3, cap: int = 20_000) -> DataFrame:
    """Pearson correlation of the mention counts of every pair of symbols over the dense grid of buckets.

    From sums: a pair that never shares a bucket needs no row for it, so work
    grows with the mentions, not with the grid.  Only the last ``cap`` buckets
    count.  Pairs are of symbols with ``least`` mentions or more.
    """
    sums, products, n = _correlation_sums(records, minutes, least, cap)
    left, right = _sides(sums)
    # All pairs of symbols are the result itself: one row for each.
    pairs = left.join(right, F.col("a") < F.col("b"))
    return _correlated(pairs.join(products, ["a", "b"], "left").crossJoin(F.broadcast(n)))


def top_correlations(records: DataFrame, minutes: int = 60, least: int = 3, cap: int = 20_000, top: int = 30) -> DataFrame:
    """The ``top`` pairs of ``symbol_correlation`` by strength, then mentions, without making all pairs.

    A pair without a shared bucket has r = -f(a) f(b), where f is a symbol's
    mean over its deviation, so both lists to search are the one of symbols by
    falling f (then mentions and name).  No such pair is beaten by one further
    down either list; so a symbol has to be paired with its first ``top``
    partners that it shares no bucket with, which lie among the next ``top`` and
    as many more as it shares buckets with; and only symbols before the place
    where ``top`` pairs have been passed have to be paired at all.  What is
    paired thus grows with the pairs that share a bucket.
    """
    sums, products, n = _correlation_sums(records, minutes, least, cap)
    sums, products = materialize(sums, "correlation-sums"), materialize(products, "correlation-products")
    order = [F.desc(F.abs(F.round("r", 9))), F.desc("mentions"), "a", "b"]
    left, right = _sides(sums)
    sharing = _correlated(products.join(left, "a").join(right, "b").crossJoin(F.broadcast(n))).orderBy(*order).limit(top)
    f = F.coalesce(F.try_divide(F.col("sx"), F.sqrt(F.greatest(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0)))), F.lit(0.0))
    partners = products.select(F.explode(F.array("a", "b")).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("partners"))
    reach = top + 1 + (partners.agg(F.max("partners")).first()[0] or 0)
    listed = sums.crossJoin(F.broadcast(n)).withColumn("f", f).drop("n").join(partners, "symbol", "left").na.fill(0, ["partners"])
    falling = [F.desc("f"), F.desc("total"), "symbol"]
    # Only the head of the list is put in order: no symbol is paired with one beyond.
    head = materialize(listed.orderBy(*falling).limit(reach).withColumn("rank", F.row_number().over(Window.orderBy(*falling))).drop("f"), "correlation-head")
    rank = head.select("symbol", "rank")
    both = products.select("a", "b").join(rank.toDF("a", "i"), "a").join(rank.toDF("b", "j"), "b")
    shared_before = both.groupBy(F.greatest("i", "j").alias("rank")).agg(F.count(F.lit(1)).alias("shared"))
    passed = F.sum(F.col("rank") - 1 - F.coalesce("shared", F.lit(0))).over(Window.orderBy("rank"))
    last = rank.join(shared_before, "rank", "left").withColumn("passed", passed).filter(F.col("passed") >= top).agg(F.min("rank").alias("last"))
    # One row.
    first = head.crossJoin(F.broadcast(last)).filter(F.col("rank") <= F.coalesce("last", "rank")).drop("last")
    first = first.withColumn("upto", F.least(F.col("rank") + top + F.col("partners"), F.lit(reach))).filter("rank < upto")
    pairs = first.select(*(F.col(c).alias(f"{c}_a") for c in sums.columns), F.explode(F.sequence(F.col("rank") + 1, "upto")).alias("rank"))
    pairs = pairs.join(head.select("rank", *(F.col(c).alias(f"{c}_b") for c in sums.columns)), "rank")
    pairs = pairs.withColumns({"a": F.least("symbol_a", "symbol_b"), "b": F.greatest("symbol_a", "symbol_b"), "sxy": F.lit(0.0)}).join(products.select("a", "b"), ["a", "b"], "left_anti")
    return sharing.unionByName(_correlated(pairs.crossJoin(F.broadcast(n)))).orderBy(*order).limit(top)
