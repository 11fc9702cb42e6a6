"""Signals over labels and sentiment: regimes, momentum, co-occurrence, dispersion, intensity, sessions, persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.time import SESSIONS, floor_to, session_name
from tidewire.session import materialize
from tidewire.sources.records import timed

EPSILON = 1e-3


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def first_samples(rows: DataFrame, keys: list[str], order: list, value: str, out: str, k: int = 3) -> DataFrame:
    """(keys, ``out``): the first ``k`` values of each key by ``order``.

    Every task keeps its own first ``k`` before the shuffle, so no key's rows are gathered.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = rows.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", value))), lambda x: x[value]).alias(out))


def upper_symbols() -> Column:
    return F.array_distinct(F.filter(F.transform("candidate_symbols", lambda s: F.upper(F.trim(s))), lambda s: s != ""))


def label_shares(records: DataFrame, minutes: int = 60) -> DataFrame:
    """(bucket, kind, key, share): each record spreads one unit over its labels; shares of a kind sum to 1 in a bucket."""
    size = minutes * 60
    rows = timed(records).withColumn("bucket", floor_to(F.floor(F.col("us") / 1_000_000), size))
    kinds = F.array(F.struct(F.lit("asset").alias("kind"), F.col("asset_classes").alias("keys")), F.struct(F.lit("reason").alias("kind"), F.col("impact_reason_codes").alias("keys")))
    spread = rows.select("bucket", F.inline(kinds)).filter(F.size("keys") > 0)
    mass = spread.select("bucket", "kind", F.explode("keys").alias("key"), (1.0 / F.size("keys")).alias("w")).groupBy("bucket", "kind", "key").agg(F.sum("w").alias("w"))
    return mass.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("bucket", "kind"))).drop("w")


def regime_shifts(records: DataFrame, minutes: int = 60, threshold: float = 0.40, least: int = 3) -> DataFrame:
    """Each non-empty bucket's divergence of its label mix from the bucket before it, and whether that is a shift."""
    size = minutes * 60
    # Records pass once for them.
    shares = materialize(label_shares(records, minutes), "label-shares")
    rows = timed(records).withColumn("bucket", floor_to(F.floor(F.col("us") / 1_000_000), size))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("finance_relevance_score").alias("mean_relevance"))
    order = Window.orderBy("bucket")
    steps = counts.withColumn("before", F.lag("bucket").over(order)).withColumn("n_before", F.lag("n").over(order))
    links = steps.filter("before is not null").select("bucket", "before")
    now = shares.join(links, "bucket").select("bucket", "kind", "key", F.col("share").alias("p"))
    past = shares.withColumnRenamed("bucket", "before").join(links, "before").select("bucket", "kind", "key", F.col("share").alias("q"))
    both = now.join(past, ["bucket", "kind", "key"], "full_outer").select("bucket", F.coalesce("p", F.lit(EPSILON)).alias("p"), F.coalesce("q", F.lit(EPSILON)).alias("q"))
    # KL of the renormalised sides, from sums: sum p ln(p / q) / P + ln(Q / P).
    kl = both.groupBy("bucket").agg((F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))) / F.sum("p") + F.log(F.sum("q") / F.sum("p"))).alias("kl"))
    out = steps.join(kl, "bucket", "left")
    shift = (F.col("kl") > threshold) & (F.col("n") >= least) & (F.col("n_before") >= least)
    return out.select("bucket", "n", "mean_relevance", "kl", F.coalesce(shift, F.lit(False)).alias("shift"))


def top_labels(records: DataFrame, minutes: int = 60, top: int = 6) -> DataFrame:
    """The ``top`` labels of each kind in each bucket by share, then name."""
    rank = F.row_number().over(Window.partitionBy("bucket", "kind").orderBy(F.desc(F.round("share", 9)), "key"))
    return label_shares(records, minutes).withColumn("rank", rank).filter(F.col("rank") <= top)


def momentum_cells(records: DataFrame, minutes: int = 240) -> DataFrame:
    """Counts, net sentiment and mean score of each symbol in each of its own buckets, which the first record with symbols anchors."""
    rows = timed(records).withColumn("symbols", upper_symbols()).filter(F.size("symbols") > 0)
    anchor = rows.agg(F.min("us").alias("anchor"))
    size = minutes * 60
    rows = rows.crossJoin(F.broadcast(anchor)).withColumn("slot", F.floor(F.floor((F.col("us") - F.col("anchor")) / 1_000_000) / size))
    named = rows.select("slot", "anchor", F.explode("symbols").alias("symbol"), "sentiment_label", "sentiment_score")
    label = F.col("sentiment_label")
    cells = named.groupBy("symbol", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(label == "positive").alias("pos"), F.count_if(label == "negative").alias("neg"), F.count_if(label.isin("positive", "neutral", "negative")).alias("labelled"),
        F.avg("sentiment_score").alias("mean_score"), (F.max("anchor") + F.col("slot") * size * 1_000_000).alias("start_us"),
    )
    return cells.withColumn("net", ratio((F.col("pos") - F.col("neg")).cast("double"), F.col("labelled")))


def sentiment_momentum(records: DataFrame, minutes: int = 240, least: int = 4, top: int | None = None) -> DataFrame:
    """Each symbol's net sentiment in the later half of its buckets against the earlier half; with ``top`` the strongest, in order."""
    cells = momentum_cells(records, minutes)
    own = Window.partitionBy("symbol")
    cells = cells.withColumn("i", F.row_number().over(own.orderBy("slot")) - 1).withColumn("b", F.count(F.lit(1)).over(own))
    late = F.col("i") >= F.floor(F.col("b") / 2)
    tail = F.col("i") >= F.col("b") - F.greatest(F.lit(1), F.ceil(F.col("b") * 0.25))
    out = cells.groupBy("symbol").agg(
        F.sum("n").alias("mentions"), F.max("b").alias("buckets"),
        ratio((F.sum("pos") - F.sum("neg")).cast("double"), F.sum("labelled")).alias("overall_net"),
        F.avg(F.when(~late, F.col("net"))).alias("early"), F.avg(F.when(late, F.col("net"))).alias("late"),
        F.avg(F.when(~tail, F.col("net"))).alias("head"), F.avg(F.when(tail, F.col("net"))).alias("tail"),
        F.min_by("net", "i").alias("first"), F.max_by("net", "i").alias("last"),
    ).filter(F.col("mentions") >= least)
    single = F.col("buckets") == 1
    e, x = F.col("early"), F.col("late")
    direction = (
        F.when(single, "stable").when((e > 0.20) & (x < -0.20), "flipping_negative").when((e < -0.20) & (x > 0.20), "flipping_positive")
        .when((x - e > 0.30) & (x > 0.20), "strengthening_positive").when((x - e < -0.30) & (x < -0.20), "strengthening_negative").otherwise("stable")
    )
    flip = ~single & (F.abs("head") > 1e-9) & (F.abs("tail") > 1e-9) & ((F.col("head") > 0) != (F.col("tail") > 0))
    out = out.select(
        "symbol", "mentions", "buckets", "overall_net",
        F.when(single, 0.0).otherwise(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), x - e))).alias("momentum"),
        F.when(single, 0.0).otherwise(F.try_divide(F.col("last") - F.col("first"), F.col("buckets") - 1)).alias("velocity"),
        direction.alias("direction"), F.coalesce(flip, F.lit(False)).alias("flip"),
    )
    return out.orderBy(F.desc(F.abs(F.round("momentum", 9))), "symbol").limit(top) if top else out


def co_occurrence_cells(records: DataFrame, least: int = 1) -> DataFrame:
    """Asset by reason: how often, the lift over the pairs' own margins, and mean relevance."""
    sets = records.select(F.explode(F.array_distinct("asset_classes")).alias("asset"), F.array_distinct("impact_reason_codes").alias("reasons"), "finance_relevance_score")
    pairs = sets.select("asset", F.explode("reasons").alias("reason"), "finance_relevance_score")
    cells = pairs.groupBy("asset", "reason").agg(F.count(F.lit(1)).alias("n"), F.avg("finance_relevance_score").alias("mean_relevance"))
    row, column, total = (F.sum("n").over(Window.partitionBy(*by)) for by in (["asset"], ["reason"], []))
    return cells.withColumn("lift", F.col("n") * total / (row * column)).filter(F.col("n") >= least)


def top_cells(records: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` cells by lift, then number."""
    return co_occurrence_cells(records).orderBy(F.desc(F.round("lift", 9)), F.desc("n"), "asset", "reason").limit(top)


def co_occurrence_edges(records: DataFrame, least: int = 2, top: int | None = None, samples: bool = True) -> DataFrame:
    """Pairs of symbols of one record, a before b, with three of the records; with ``top`` the heaviest, in order."""
    sets = records.withColumn("s", F.array_sort(upper_symbols())).filter(F.size("s") > 1)
    pairs = sets.select("capture_id", F.posexplode("s").alias("i", "a"), "s").select("capture_id", "a", F.explode(F.slice(F.col("s"), F.col("i") + 2, F.size("s"))).alias("b"))
    edges = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= least)
    order = [F.desc("weight"), "a", "b"]
    edges = edges.orderBy(*order).limit(top) if top else edges
    if not samples:
        return edges
    own = pairs.join(edges.select("a", "b"), ["a", "b"], "left_semi")
    # A repeated record counts once among the samples: its rows share a rank.
    rank = F.dense_rank().over(Window.partitionBy("a", "b").orderBy(F.length("capture_id"), "capture_id"))
    first = own.withColumn("_rank", rank).filter(F.col("_rank") <= 3).groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_set(F.struct("_rank", "capture_id"))), lambda x: x["capture_id"]).alias("samples"))
    out = edges.join(first, ["a", "b"], "left")
    return out.orderBy(*order) if top else out


def reason_concentration(records: DataFrame) -> DataFrame:
    """Herfindahl index of each asset class's reasons, and how many there are."""
    cells = co_occurrence_cells(records).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("asset")))
    return cells.groupBy("asset").agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.count(F.lit(1)).alias("reasons"))


def asset_concentration(records: DataFrame, top: int = 5) -> DataFrame:
    """Every asset class with its number of records, Herfindahl index and ``top`` reasons; 0 and none without reasons.  Most records first."""
    assets = records.select(F.explode(F.array_distinct("asset_classes")).alias("asset")).groupBy("asset").agg(F.count(F.lit(1)).alias("records"))
    shares = co_occurrence_cells(records).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("asset")))
    rank = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc(F.round("share", 9)), "reason"))
    first = shares.withColumn("rank", rank).groupBy("asset").agg(
        F.least(F.lit(1.0), F.sum(F.col("share") * F.col("share"))).alias("hhi"), F.count(F.lit(1)).alias("reasons"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "reason")))), lambda x: x["reason"]).alias("top_reasons"),
    )
    out = assets.join(first, "asset", "left").select("asset", "records", F.coalesce("reasons", F.lit(0)).alias("reasons"), F.coalesce("hhi", F.lit(0.0)).alias("hhi"), F.coalesce("top_reasons", F.array().cast("array<string>")).alias("top_reasons"))
    return out.orderBy(F.desc("records"), "asset")


def sentiment_shares(records: DataFrame, minutes: int = 60) -> DataFrame:
    """(bucket, label, share) of the labelled records of each bucket, all three labels for each."""
    rows = timed(records).withColumn("bucket", floor_to(F.floor(F.col("us") / 1_000_000), minutes * 60))
    labels = ("positive", "neutral", "negative")
    counts = rows.groupBy("bucket").agg(*(F.count_if(F.col("sentiment_label") == x).alias(x) for x in labels))
    total = sum((F.col(x) for x in labels), F.lit(0))
    return counts.select("bucket", F.inline(F.array(*(F.struct(F.lit(x).alias("label"), ratio(F.col(x).cast("double"), total).alias("share")) for x in labels))))


def dispersion(records: DataFrame, scope: str = "asset_classes") -> DataFrame:
    """Entropy of the sentiment labels of each value of a list column, and the dominant label."""
    label = F.col("sentiment_label")
    counts = records.select(F.explode(scope).alias("scope"), label).groupBy("scope").agg(
        F.count(F.lit(1)).alias("mentions"), *(F.count_if(label == x).alias(x) for x in ("positive", "neutral", "negative"))
    )
    total = F.col("positive") + F.col("neutral") + F.col("negative")
    part = lambda c: F.when(F.col(c) > 0, -(F.col(c) / total) * F.log2(F.col(c) / total)).otherwise(0.0)
    entropy = F.when(total > 0, part("positive") + part("neutral") + part("negative")).otherwise(0.0)
    top = F.greatest("positive", "neutral", "negative")
    tied = sum((F.when(F.col(c) == top, 1).otherwise(0) for c in ("positive", "neutral", "negative")), F.lit(0)) > 1
    dominant = F.when((total == 0) | tied, "tied").when(F.col("positive") == top, "positive").when(F.col("neutral") == top, "neutral").otherwise("negative")
    return counts.select("scope", "mentions", total.alias("sample_size"), entropy.alias("entropy"), (entropy / F.log2(F.lit(3.0))).alias("normalized"), dominant.alias("dominant"))


def safe(x: Column) -> Column:
    """A finite number, else 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def intensity(records: DataFrame, scope: str = "asset_classes") -> DataFrame:
    """Mean, greatest and share above a half of relevance times sentiment strength, for each value of a list column."""
    value = safe(F.col("finance_relevance_score")) * F.abs(safe(F.col("sentiment_score")))
    rows = records.select(F.explode(scope).alias("scope"), value.alias("x"))
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.max("x").alias("max"), F.count_if(F.col("x") > 0.5).alias("high"))


def most_intense(records: DataFrame, top: int = 5) -> DataFrame:
    value = safe(F.col("finance_relevance_score")) * F.abs(safe(F.col("sentiment_score")))
    return records.select("capture_id", value.alias("intensity")).orderBy(F.desc("intensity"), F.length("capture_id"), "capture_id").limit(top)


def by_session(records: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Records, mean relevance and relevant records of each market session; all sessions appear."""
    spark = records.sparkSession
    local = F.from_utc_timestamp(F.timestamp_micros("us"), zone)
    score = F.coalesce("finance_relevance_score", F.lit(0.0))
    counts = timed(records).withColumn("session", session_name(local)).groupBy("session").agg(F.count(F.lit(1)).alias("volume"), F.avg(score).alias("avg_score"), F.count_if(score >= 0.5).alias("relevant"))
    spine = spark.createDataFrame([(x,) for x in SESSIONS], "session string")
    return spine.join(F.broadcast(counts), "session", "left").select("session", F.coalesce("volume", F.lit(0)).alias("volume"), F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"), F.coalesce("relevant", F.lit(0)).alias("relevant"))


def arrival_heatmap(records: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Records of each weekday (Monday 0) and hour; all 168 cells appear."""
    local = F.from_utc_timestamp(F.timestamp_micros("us"), zone)
    counts = timed(records).groupBy((F.weekday(local) * 24 + F.hour(local)).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    cells = records.sparkSession.range(168).select(F.col("id").cast("int").alias("cell"))
    cell = F.col("cell")
    return cells.join(F.broadcast(counts), "cell", "left").select(F.floor(cell / 24).cast("int").alias("weekday"), (cell % 24).alias("hour"), F.coalesce("n", F.lit(0)).alias("n"))


def session_headline(records: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """One row: all records, and the sessions of highest mean relevance and of most records (of equal ones the first of the day)."""
    place = F.array_position(F.array(*map(F.lit, SESSIONS)), F.col("session"))
    rows = by_session(records, zone).withColumn("place", -place)
    filled = F.col("volume") > 0
    best = lambda x: F.max_by("session", F.when(filled, F.struct(x, "place")))
    return rows.agg(F.sum("volume").alias("total"), best("avg_score").alias("highest_score"), best("volume").alias("highest_volume"))


def heatmap_summary(records: DataFrame, zone: str = "America/New_York", peaks: int = 5) -> DataFrame:
    """One row: the greatest cell, all records, and the first ``peaks`` cells that reach the greatest, as weekday * 24 + hour."""
    cells = arrival_heatmap(records, zone).withColumn("cell", F.col("weekday") * 24 + F.col("hour"))
    out = cells.agg(F.max("n").alias("max"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cells"))
    top = F.filter("cells", lambda x: (x["n"] == F.col("max")) & (F.col("max") > 0))
    return out.select("max", "total", F.slice(F.transform(top, lambda x: x["cell"]), 1, peaks).alias("peaks"))


def persistence(records: DataFrame, days: int = 7, least: int = 3, top: int | None = None, samples: bool = True) -> DataFrame:
    """Share of the newest ``days`` days on which each asset class and first symbol had records, with three titles; with ``top`` the most persistent, in order."""
    rows = timed(records).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    newest = rows.agg(F.max("day").alias("top"))
    recent = rows.join(F.broadcast(newest), F.col("day") > F.col("top") - days)
    first = F.coalesce(F.get("candidate_symbols", 0), F.lit("—"))
    named = recent.select(F.explode("asset_classes").alias("asset"), first.alias("symbol"), "day", "us", "capture_id", F.substring("title", 1, 100).alias("title"))
    groups = named.groupBy("asset", "symbol").agg(F.count_distinct("day").alias("days"), F.count(F.lit(1)).alias("total"))
    groups = groups.filter(F.col("total") >= least).withColumn("ratio", F.col("days") / F.lit(days))
    order = [F.desc("ratio"), F.desc("total"), "asset", "symbol"]
    groups = groups.orderBy(*order).limit(top) if top else groups
    if not samples:
        return groups
    own = named.filter(F.coalesce("title", F.lit("")) != "").join(groups.select("asset", "symbol"), ["asset", "symbol"], "left_semi")
    titles = first_samples(own, ["asset", "symbol"], ["us", F.length("capture_id"), "capture_id"], "title", "titles")
    out = groups.join(titles, ["asset", "symbol"], "left")
    return out.orderBy(*order) if top else out
