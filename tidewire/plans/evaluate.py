"""Evaluation and lookups: market reaction, tone, coverage gaps, holdings, calibration, agreement, label quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.sets import jaccard
from tidewire.functions.time import epoch_us, event_time
from tidewire.plans.mix import ratio

# The symbol that stands for an asset class, and the quotes that ship with the engine.
ASSET_PROXY = {"equities": "SPY", "indices": "SPY", "rates": "TLT", "fx": "UUP", "credit": "LQD", "commodities": "DJP", "crypto": "BTC-USD", "macro": "SPY"}
DEFAULT_PROXY = "SPY"
QUOTES = [("AAPL", 189.98, 188.85, None), ("MSFT", 370.60, 369.14, None), ("BTCUSD", 44120.50, 43890.00, None)]


def primary_symbol() -> Column:
    """The first symbol that isn't blank, else the first asset class's proxy, else the default."""
    symbol = F.get(F.filter(F.transform("candidate_symbols", lambda s: F.upper(F.trim(s))), lambda s: s != ""), 0)
    pairs = F.create_map(*(F.lit(x) for pair in ASSET_PROXY.items() for x in pair))
    proxy = F.get(F.filter(F.transform("asset_classes", lambda a: F.try_element_at(pairs, F.lower(F.trim(a)))), lambda x: x.isNotNull()), 0)
    return F.coalesce(symbol, proxy, F.lit(DEFAULT_PROXY))


def market_reaction(records: DataFrame, quotes: DataFrame, horizons: tuple[str, ...] = ("intraday", "one_day"), benchmark: str = "SPY") -> DataFrame:
    """Each record's symbol and benchmark return in per cent at each horizon, from one snapshot of quotes (symbol, last, prev_close, error_code).

    An error or a missing price suppresses the symbol's leg.
    """
    move = lambda last, prev: F.when(prev != 0, F.try_divide(last - prev, prev) * 100)
    priced = quotes.select(F.upper("symbol").alias("symbol"), "last", move(F.col("last"), F.col("prev_close")).alias("pct"), "error_code")
    own = records.select("capture_id", primary_symbol().alias("symbol")).join(priced, "symbol", "left")
    error = F.coalesce("error_code", F.when(F.col("last").isNull(), F.lit("quote_unavailable")))
    base = priced.filter(F.col("symbol") == benchmark).agg(F.max("pct").alias("benchmark_pct"))
    rows = own.withColumn("error", error).withColumn("symbol_pct", F.when(F.col("error").isNull(), F.col("pct"))).crossJoin(F.broadcast(base))
    each = rows.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    return each.select("capture_id", "symbol", "horizon", "symbol_pct", "benchmark_pct", (F.col("symbol_pct") - F.col("benchmark_pct")).alias("excess_pct"), "error")


def tone_summary(points: DataFrame, by: str = "theme") -> DataFrame:
    """Summary of tone points (theme, date in seconds or null, value): level, range, trend, slope and state of each theme.

    Undated points count in mean, least and greatest; trend and slope are over
    the dated ones in time order.  Themes without any dated point use all
    points in the order of ``value``.
    """
    rows = points.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    own = Window.partitionBy(by)
    rows = rows.withColumn("dated", F.count("date").over(own)).withColumn("used", F.col("date").isNotNull() | (F.col("dated") == 0))
    order = own.orderBy(F.col("used").desc(), "date", "value")
    rows = rows.withColumn("i", F.row_number().over(order) - 1).withColumn("m", F.count_if("used").over(own))
    recent = F.greatest(F.lit(1), F.bround(F.col("m") * 0.4).cast("long"))
    late = F.col("i") >= F.col("m") - F.least(recent, F.col("m") - 1)
    value, used = F.col("value"), F.col("used")
    out = rows.groupBy(by).agg(
        F.max_by("value", F.when(used, F.col("i"))).alias("latest"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg(F.when(used & late, value)).alias("late"), F.avg(F.when(used & ~late, value)).alias("early"),
        F.sum(F.when(used, F.col("i") * value)).alias("sxy"), F.sum(F.when(used, value)).alias("sy"), F.max("m").alias("n_dated"), F.count(F.lit(1)).alias("n_points"),
    )
    m = F.col("n_dated").cast("double")
    slope = F.when(m >= 2, F.try_divide(F.col("sxy") - (m - 1) / 2 * F.col("sy"), m * (m * m - 1) / 12)).otherwise(0.0)
    trend = F.when(m >= 2, F.col("late") - F.col("early")).otherwise(0.0)
    out = out.withColumn("trend", trend).withColumn("slope", slope)
    state = F.when(F.col("trend") > 0.5, "improving").when(F.col("trend") < -0.5, "deteriorating").otherwise("stable")
    return out.select(by, "latest", "mean", "min", "max", "trend", "slope", state.alias("state"), "n_points", "n_dated")


def overall_tone(themes: DataFrame) -> DataFrame:
    """One row from ``tone_summary``: the mean of the themes' latest values, and the state of the mean trend of those with two dated points."""
    trend = F.coalesce(F.avg(F.when(F.col("n_dated") >= 2, F.col("trend"))), F.lit(0.0))
    out = themes.agg(F.round(F.avg("latest"), 4).alias("tone"), trend.alias("trend"), F.count(F.lit(1)).alias("themes"))
    return out.withColumn("state", F.when(F.col("trend") > 0.5, "improving").when(F.col("trend") < -0.5, "deteriorating").otherwise("stable"))


def word_pattern(term: Column) -> Column:
    """A pattern for the whole word ``term`` in lower-case text."""
    return F.concat(F.lit(r"(?<!\w)\Q"), F.lower(term), F.lit(r"\E(?!\w)"))


def mentions(records: DataFrame, terms: DataFrame, text: tuple[str, ...] = ("title",)) -> DataFrame:
    """Pairs of a term (``term``) and a record that names it: as a whole word in the text, or as a symbol.

    Terms are a short list by nature (a watch list, holdings), so they are broadcast to the records.
    """
    low = F.lower(F.concat_ws(" ", *text))
    rows = records.withColumn("_text", low).withColumn("_symbols", F.transform("candidate_symbols", lambda s: F.lower(F.trim(s))))
    unique = terms.filter("term is not null and trim(term) <> ''").withColumn("_low", F.lower(F.trim("term"))).dropDuplicates(["_low"])
    hit = F.array_contains("_symbols", F.col("_low")) | (F.contains("_text", F.col("_low")) & F.expr(r"regexp_like(_text, concat('(?<!\\w)\\Q', _low, '\\E(?!\\w)'))"))
    return rows.join(F.broadcast(unique), hit).drop("_text", "_symbols", "_low")


def coverage_gaps(records: DataFrame, terms: DataFrame, as_of_us: int, window_s: int = 86_400) -> DataFrame:
    """For each term: how many records of the window name it, the age of the newest in seconds, and whether it is a gap."""
    us = epoch_us(event_time(F.col("published_ts"), F.col("created_at")))
    recent = records.withColumn("us", us).filter(F.col("us") >= as_of_us - window_s * 1_000_000)
    found = mentions(recent, terms).groupBy("term").agg(F.count(F.lit(1)).alias("matches"), F.max("us").alias("newest"))
    unique = terms.withColumn("_low", F.lower(F.trim("term"))).dropDuplicates(["_low"]).select("term")
    out = unique.join(found, "term", "left")
    return out.select("term", F.coalesce("matches", F.lit(0)).alias("matches"), F.floor((F.lit(as_of_us) - F.col("newest")) / 1_000_000).alias("age_s"), F.col("newest").isNull().alias("gap"))


def portfolio(records: DataFrame, holdings: DataFrame, quotes: DataFrame, top: int = 3) -> DataFrame:
    """Each holding with its quote's change (a fraction), its number of records, the top ones by score, and the first one's sentiment."""
    terms = holdings.select(F.upper(F.trim("symbol")).alias("term")).distinct()
    found = mentions(records, terms)
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("finance_relevance_score"), F.length("capture_id"), "capture_id"))
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("mentions"))
    best = found.withColumn("r", rank).filter(F.col("r") <= top)
    best = best.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "capture_id"))), lambda x: x["capture_id"]).alias("top"), F.max(F.when(F.col("r") == 1, F.col("sentiment_label"))).alias("sentiment"))
    priced = quotes.select(F.upper("symbol").alias("term"), F.when(F.col("error_code").isNull() & (F.col("prev_close") != 0), F.try_divide(F.col("last") - F.col("prev_close"), F.col("prev_close"))).alias("change"))
    return terms.join(counts, "term", "left").join(best, "term", "left").join(priced, "term", "left").select(F.col("term").alias("symbol"), F.coalesce("mentions", F.lit(0)).alias("mentions"), "top", "sentiment", "change")


def review_pairs(reviews: DataFrame, a: str, b: str) -> DataFrame:
    """The two reviewers' rows of each capture that both reviewed, as structs ``a`` and ``b``."""
    one = lambda who, name: reviews.filter(F.col("reviewer_id") == who).select("capture_id", F.struct("*").alias(name))
    return one(a, "a").join(one(b, "b"), "capture_id")


def calibration_rows(pairs: DataFrame) -> DataFrame:
    """(capture_id, predicted, truth, delta) of pairs without errors and with finite scores."""
    p, t = F.col("a.payload.finance_relevance_score"), F.col("b.payload.finance_relevance_score")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = pairs.filter(F.col("a.error_code").isNull() & F.col("b.error_code").isNull() & fine(p) & fine(t))
    return good.select("capture_id", p.alias("predicted"), t.alias("truth"), (t - p).alias("delta"))


def calibration_bins(rows: DataFrame) -> DataFrame:
    """Five bins of the predicted score, the last closed: counts, means and their gap."""
    inside = rows.filter(F.col("predicted").between(0.0, 1.0))
    p = F.col("predicted")
    bin_ = F.when(p >= 0.8, 4).when(p >= 0.6, 3).when(p >= 0.4, 2).when(p >= 0.2, 1).otherwise(0)
    return inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("avg_predicted"), F.avg("truth").alias("avg_truth"), (F.avg("truth") - F.avg("predicted")).alias("gap"))


def calibration_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("delta")).alias("mae"), F.avg("delta").alias("signed"), F.max(F.abs("delta")).alias("worst"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Six bounded comparisons of two reviews and their mean; two empty lists agree."""
    a, b = (lambda c, s=s: F.col(f"{s}.payload.{c}") for s in "ab")
    same = lambda c: jaccard(F.coalesce(a(c), F.array()), F.coalesce(b(c), F.array()), 1.0)
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    relevant = F.coalesce(a("is_finance_relevant"), F.lit(False)) == F.coalesce(b("is_finance_relevant"), F.lit(False))
    delta = F.abs(F.coalesce(a("finance_relevance_score"), F.lit(0.0)) - F.coalesce(b("finance_relevance_score"), F.lit(0.0)))
    mood = F.coalesce(a("sentiment_label") == b("sentiment_label"), F.lit(False))
    out = pairs.select("capture_id", relevant.alias("relevance_match"), delta.alias("score_delta"), same("asset_classes").alias("asset_jaccard"), same("impact_reason_codes").alias("reason_jaccard"), same("candidate_symbols").alias("symbol_jaccard"), mood.alias("sentiment_match"))
    total = flag(F.col("relevance_match")) + 1 - F.least(F.lit(1.0), F.col("score_delta")) + F.col("asset_jaccard") + F.col("reason_jaccard") + F.col("symbol_jaccard") + flag(F.col("sentiment_match"))
    return out.withColumn("overall", total / 6)


def label_quality(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label from (label, expected, predicted) booleans; 0 over 0 is 0."""
    e, p = F.col("expected"), F.col("predicted")
    counts = rows.groupBy("label").agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def golden_summary(rows: DataFrame) -> DataFrame:
    """One row from (expected_symbols, predicted_symbols, expected_sentiment, predicted_sentiment): recall of symbols and accuracy of sentiment; 0 over 0 is 0."""
    found = F.size(F.array_intersect("expected_symbols", "predicted_symbols"))
    right = F.col("expected_sentiment") == F.col("predicted_sentiment")
    sums = rows.agg(
        F.sum(F.greatest(found, F.lit(0))).alias("found"), F.sum(F.greatest(F.size(F.array_distinct("expected_symbols")), F.lit(0))).alias("expected"),
        F.count_if(right).alias("right"), F.count("expected_sentiment").alias("judged"),
    )
    return sums.select(ratio(F.col("found").cast("double"), F.col("expected")).alias("symbol_recall"), ratio(F.col("right").cast("double"), F.col("judged")).alias("sentiment_accuracy"), "expected", "judged")


def label_sets(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """(label, expected, predicted) for every label in either list of each row."""
    each = rows.select(F.explode(F.array_union(expected, predicted)).alias("label"), expected, predicted)
    return each.select("label", F.array_contains(expected, F.col("label")).alias("expected"), F.array_contains(predicted, F.col("label")).alias("predicted"))
