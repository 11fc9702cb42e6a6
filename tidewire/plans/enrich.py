"""Captures to records: each stage adds columns to the capture, all of them built-in expressions but the embedding.

Only the label scores need a shuffle: the tokens that are aliases of a label
are summed per capture.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire import lexicon
from tidewire.functions.fuzzy import nearest_names
from tidewire.functions.text import cashtags, equity_shaped, matched, paren_tickers, sentences, strip, whole_word
from tidewire.session import materialize
from tidewire.taxonomy import DEFAULT_DOMAIN_PRIOR, DEFAULT_SOURCE_PRIOR, DOMAIN_PRIORS, HORIZONS, SOURCE_PRIORS, THRESHOLDS, aliases

# What each part adds to the relevance score.
SCORE_WEIGHTS = {"_a": 0.30, "_r": 0.30, "rule_score": 0.15, "domain_prior": 0.10, "source_prior": 0.05, "_mood": 0.05, "_density": 0.05}

TITLE_WEIGHT, BIGRAM_WEIGHT, BODY_CHARS, SCAN_CHARS = 3.0, 1.5, 3000, 800


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _prior(key: Column, table: dict[str, float], default: float) -> Column:
    """A short lookup as a literal CASE, so no join is needed."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def prefilter(captures: DataFrame) -> DataFrame:
    """Add matched, blocked, domain_prior, source_prior, rule_score and keep."""
    low = F.lower(F.concat(strip(_text("title")), F.lit("\n"), F.substring(strip(_text("text")), 1, SCAN_CHARS)))
    rows = captures.withColumn("_low", low)
    cash = F.when(_text("text").rlike(r"\$[A-Z]{1,6}\b"), F.array(F.lit("cashtag"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({
        "matched": F.concat(matched(F.col("_low"), lexicon.FINANCE_KEYWORDS), cash),
        "blocked": matched(F.col("_low"), lexicon.HARD_NEGATIVE_KEYWORDS),
        "domain_prior": _prior(F.lower(_text("domain")), DOMAIN_PRIORS, DEFAULT_DOMAIN_PRIOR),
        "source_prior": _prior(F.lower(_text("source_type")), SOURCE_PRIORS, DEFAULT_SOURCE_PRIOR),
    })
    signal = F.least(F.lit(1.0), F.size("matched") / 4.0)
    mixed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.45 * F.col("domain_prior") + 0.20 * F.col("source_prior") + 0.35 * signal))
    veto = (F.size("blocked") >= 2) & (F.size("matched") == 0) & (F.col("domain_prior") < 0.30)
    rule = F.when(veto, 0.05).when(F.length("_low") < 80, F.greatest(F.col("domain_prior"), F.lit(0.20))).otherwise(mixed)
    return rows.withColumns({"rule_score": rule, "keep": ~veto}).drop("_low")


def _tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([A-Za-z][A-Za-z0-9'+\-]+)"), 1)
    return F.filter(words, lambda w: ~w.isin(*lexicon.LABEL_STOPWORDS))


def _bigrams(words: str) -> Column:
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def label_scores(captures: DataFrame) -> DataFrame:
    """(capture_id, kind, label, score): labels whose one- or two-word aliases occur, by weighted counts through a sigmoid.

    Words of the title count three times as much, and those of the body only if the title lacks them.
    """
    rows = captures.select("capture_id", _tokens(_text("title")).alias("tw"), _tokens(F.substring(_text("text"), 1, BODY_CHARS)).alias("bw"))
    rows = rows.select("capture_id", "tw", "bw", _bigrams("tw").alias("tb"), _bigrams("bw").alias("bb"))
    weigh = lambda x, w: F.transform(x, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    fresh = lambda body, title: F.filter(body, lambda t: ~F.array_contains(title, t))
    parts = F.concat(weigh(F.col("tw"), TITLE_WEIGHT), weigh(fresh(F.col("bw"), F.col("tw")), 1.0), weigh(F.col("tb"), BIGRAM_WEIGHT * TITLE_WEIGHT), weigh(fresh(F.col("bb"), F.col("tb")), BIGRAM_WEIGHT))
    terms = rows.select("capture_id", F.explode(parts).alias("x")).select("capture_id", "x.term", "x.w")
    hits = terms.join(F.broadcast(aliases(captures.sparkSession)), "term")
    return hits.groupBy("capture_id", "kind", "label").agg((1 / (1 + F.exp(1 - F.sum("w")))).alias("score"))


def sentiment(captures: DataFrame) -> DataFrame:
    """Add sentiment_label and sentiment_score from the numbers of distinct positive and negative terms."""
    low = F.lower(F.concat(_text("title"), F.lit(" "), F.substring(_text("text"), 1, BODY_CHARS)))
    rows = captures.withColumn("_low", low)
    count = lambda terms: reduce(lambda a, b: a + b, [F.when(F.contains(F.col("_low"), F.lit(t)) & F.col("_low").rlike(whole_word(t)), 1).otherwise(0) for t in terms])
    rows = rows.withColumns({"_pos": count(lexicon.POSITIVE), "_neg": count(lexicon.NEGATIVE)})
    pos, neg = F.col("_pos"), F.col("_neg")
    label = F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")
    score = F.when(pos == neg, F.when(pos == 0, 0.5).otherwise(0.55)).otherwise(F.least(F.lit(1.0), 0.5 + 0.1 * F.abs(pos - neg)))
    return rows.withColumns({"sentiment_label": label, "sentiment_score": score}).drop("_low", "_pos", "_neg")


def _named(text: Column, words: tuple[str, ...], kind: str, any_case: bool) -> Column:
    """Structs (text, kind) of the listed names that occur as whole words, in the list's order."""
    low = F.lower(text)
    tests = []
    for w in words:
        cheap = F.contains(low, F.lit(w.lower())) if any_case else F.contains(text, F.lit(w))
        flag = "(?i)" if any_case else ""
        tests.append(F.when(cheap & text.rlike(rf"{flag}(?<!\w)\Q{w}\E(?!\w)"), F.struct(F.lit(w).alias("text"), F.lit(kind).alias("kind"))))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def _kinded(texts: Column, kind: str) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(kind).alias("kind")))


def with_entities(captures: DataFrame) -> DataFrame:
    """Add clean_text (no boilerplate), entity_hits (text, kind) in the order of detection, and candidate_entities."""
    rows = captures.withColumn("clean_text", F.array_join(sentences(F.col("text")), " "))
    rows = rows.withColumn("_all", F.concat(strip(_text("title")), F.lit("\n"), strip(F.col("clean_text"))))
    text = F.col("_all")
    real = lambda x: F.filter(x, lambda t: ~t.isin(*lexicon.NOT_TICKERS))
    bare = real(F.regexp_extract_all(text, F.lit(r"\(([A-Z]{2,6})\)"), 1))
    companies = [
        F.when(F.contains(F.lower(text), F.lit(a.lower())) & text.rlike(rf"(?i)(?<![A-Za-z0-9])\Q{a}\E(?![A-Za-z0-9])"), F.array(F.struct(F.lit(a).alias("text"), F.lit("company").alias("kind")), F.struct(F.lit(s).alias("text"), F.lit("ticker").alias("kind"))))
        for a, s in lexicon.SYMBOLS.items()
    ]
    hits = F.concat(
        _kinded(cashtags(text), "cashtag"), _kinded(bare, "ticker"), _named(text, lexicon.CURRENCIES, "currency", False), _named(text, lexicon.CENTRAL_BANKS, "central_bank", False),
        _named(text, lexicon.INDICES, "index", False), _named(text, lexicon.COMMODITIES, "commodity", True), _named(text, lexicon.CRYPTO, "crypto", True),
        F.flatten(F.filter(F.array(*companies), lambda x: x.isNotNull())),
    )
    rows = rows.withColumn("entity_hits", F.array_distinct(hits)).drop("_all")
    return rows.withColumn("candidate_entities", F.slice(F.array_distinct(F.transform("entity_hits", lambda h: h["text"])), 1, 12))


#: Fixed value: the partial ratio from which a name counts as misspelt.
FUZZY_LEAST = 92.0


def with_symbols(captures: DataFrame) -> DataFrame:
    """Add candidate_symbols: cashtags, tickers in parentheses, exact names, and near misses of names in short texts with few hits.

    A near miss is a name of five letters or more whose partial ratio with the
    text is ``FUZZY_LEAST`` at least, but not whole, among the best three of all.
    Symbols that the title holds come first; at most eight stay.
    """
    rows = captures.withColumn("_head", F.concat(_text("title"), F.lit("\n"), F.substring("clean_text", 1, 600)))
    text, low = F.col("_head"), F.lower(F.col("_head"))
    real = lambda x: F.filter(x, lambda t: ~t.isin(*lexicon.NOT_TICKERS))
    exact = [F.when(F.contains(low, F.lit(a.lower())) & low.rlike(rf"(?<![a-z0-9])\Q{a.lower()}\E(?![a-z0-9])"), F.lit(s)) for a, s in lexicon.SYMBOLS.items() if len(a) > 1]
    found = F.array_distinct(F.concat(real(cashtags(text)), real(paren_tickers(text)), F.filter(F.array(*exact), lambda x: x.isNotNull())))
    rows = rows.withColumn("_found", found)
    names = list(lexicon.SYMBOLS)
    # Texts that aren't asked about are null to the function.
    near = nearest_names(names, 3, FUZZY_LEAST)(F.when((F.size("_found") < 3) & (F.length("_head") < 400), F.col("_head")))
    symbol_of = F.create_map(*(F.lit(x) for a in names for x in (a, lexicon.SYMBOLS[a])))
    # A name that stands there letter by letter has been found, or is part of a longer word.
    drift = F.filter(F.coalesce(near, F.array().cast("array<struct<name:string,score:double>>")), lambda x: (x["score"] < 100) & (F.length(F.trim(x["name"])) >= 5))
    fuzzy = F.transform(drift, lambda x: F.element_at(symbol_of, x["name"]))
    every = F.array_distinct(F.concat("_found", fuzzy))
    first = F.filter(every, lambda s: F.contains(F.lower(_text("title")), F.lower(s)))
    return rows.withColumn("candidate_symbols", F.slice(F.concat(first, F.array_except(every, first)), 1, 8)).drop("_head", "_found")


def horizons(reasons: Column) -> Column:
    has = lambda names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    names = F.array(F.when(has(HORIZONS["short"]), F.lit("intraday")), F.when(has(HORIZONS["short"]), F.lit("one_day")), F.when(has(HORIZONS["one_week"]), F.lit("one_week")), F.when(has(HORIZONS["structural"]), F.lit("structural")))
    return F.filter(names, lambda x: x.isNotNull())


def channels(assets: Column, reasons: Column) -> Column:
    """Channels of the rules that hold, in their order, each once."""
    tests = [F.when(F.array_contains(assets, a) & (F.lit(True) if r == "*" else F.array_contains(reasons, r)), F.lit(c)) for a, r, c in lexicon.CHANNELS]
    return F.array_distinct(F.filter(F.array(*tests), lambda x: x.isNotNull()))


def evidence(title: Column, parts: Column, terms: Column, top: int = 3) -> Column:
    """The sentences (title first) that hold most of the terms; the first scores half a point more; without terms the first alone."""
    every = F.when(strip(F.coalesce(title, F.lit(""))) != "", F.concat(F.array(strip(title)), parts)).otherwise(parts)
    low_terms = F.array_distinct(F.filter(F.transform(terms, F.lower), lambda t: t != ""))

    def scored(t: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            hits = F.size(F.filter(t, lambda term: F.contains(F.lower(s), term) & F.regexp_like(F.lower(s), F.concat(F.lit(r"(?<![a-z0-9])\Q"), term, F.lit(r"\E(?![a-z0-9])")))))
            return F.struct((-(hits + F.when(i == 0, 0.5).otherwise(0.0))).alias("minus"), i.alias("i"), s.alias("s"))

        return F.transform(F.filter(F.array_sort(F.transform(every, one)), lambda x: x["minus"] < 0), lambda x: x["s"])

    best = F.slice(F.array_distinct(F.transform(F.array(low_terms), scored)[0]), 1, top)
    return F.when(F.size(low_terms) == 0, F.slice(every, 1, 1)).otherwise(best)


def _map_of(kind: str) -> Column:
    return F.map_from_entries(F.transform(F.array_sort(F.filter("_labels", lambda x: x["kind"] == kind)), lambda x: F.struct(x["label"], x["score"])))


def _top(scores: Column) -> Column:
    return F.coalesce(F.array_max(F.map_values(scores)), F.lit(0.0))


def _passed(scores: Column, least: float) -> Column:
    """Labels of enough score, best first, then by name."""
    entries = F.filter(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("key"))), lambda x: x["minus"] <= -least)
    return F.transform(F.array_sort(entries), lambda x: x["key"])


#: What of a capture its record follows from; the rest is carried along.
CONTENT = ["title", "text", "domain", "source_type"]
CARRIED = {"capture_id": "string", "doc_id": "string", "published_ts": "timestamp", "language": "string", "url": "string"}


def enrich(captures: DataFrame, settled: bool = False) -> DataFrame:
    """Records of captures (capture_id, title, text, domain, source_type, ...).

    Enrichment costs milliseconds a text and moving a row costs microseconds,
    so captures of equal content are enriched once and joined.  With ``settled``
    the contents are enriched here and now and written: their size is known
    then, and a few of them are sent to the captures instead of the other way.
    """
    spark = captures.sparkSession
    # Lengths before the parts, so that no two contents are written alike.
    content = F.sha2(F.concat(*(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in CONTENT)), 256)
    keyed = captures.withColumn("_content", content)
    distinct = keyed.select(F.col("_content").alias("capture_id"), *CONTENT).dropDuplicates(["capture_id"])
    # A number of its own, as contents are few bytes and much work.
    partitions = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = _enriched(distinct.repartition(partitions, "capture_id"))
    if settled:
        known = materialize(known, "enriched")
    made = [c for c in known.columns if c not in (*CARRIED, *CONTENT)]
    carried = keyed.select("_content", "title", "domain", *(F.col(c) if c in captures.columns else F.lit(None).cast(kind).alias(c) for c, kind in CARRIED.items()))
    out = carried.join(known.select(F.col("capture_id").alias("_content"), *made), "_content")
    return out.select(*known.columns)


def _enriched(captures: DataFrame) -> DataFrame:
    """``enrich`` of captures whose id is unique, each by itself."""
    scores = label_scores(captures).groupBy("capture_id").agg(F.collect_list(F.struct("kind", "label", "score")).alias("_labels"))
    rows = with_symbols(with_entities(sentiment(prefilter(captures)))).join(scores, "capture_id", "left")
    rows = rows.withColumn("_labels", F.coalesce("_labels", F.array().cast("array<struct<kind:string,label:string,score:double>>")))
    hits = F.col("entity_hits")
    equity = F.exists(hits, lambda h: (h["kind"] == "cashtag") | ((h["kind"] == "ticker") & equity_shaped(h["text"])))
    assets = _map_of("asset")
    bridged = F.map_concat(F.map_filter(assets, lambda k, v: k != "equities"), F.map_from_arrays(F.array(F.lit("equities")), F.array(F.greatest(F.coalesce(F.try_element_at(assets, F.lit("equities")), F.lit(0.0)), F.lit(0.6)))))
    rows = rows.withColumns({"_asset": F.when(equity, bridged).otherwise(assets), "_reason": _map_of("reason"), "_negative": _map_of("negative")})
    n_hits = F.size(F.filter(hits, lambda h: h["kind"] != "company"))
    size = F.length(_text("text"))
    density = F.when(size > 0, F.least(F.lit(1.0), n_hits / (F.when(size > 0, size) / 1000.0) / 3.0)).otherwise(0.0)
    mood = F.when(F.col("sentiment_label") != "neutral", F.col("sentiment_score")).otherwise(0.0)
    rows = rows.withColumns({"_a": _top(F.col("_asset")), "_r": _top(F.col("_reason")), "_n": _top(F.col("_negative")), "_density": density, "_mood": mood})
    raw = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in SCORE_WEIGHTS.items()])
    rows = rows.withColumn("finance_relevance_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    blocked = (F.col("_n") >= THRESHOLDS["negative_class_block"]) & (F.col("_a") < 0.5) & (F.col("_r") < 0.5)
    gated = (F.col("_a") == 0) & (F.col("_r") < 0.75)
    relevant = (F.col("finance_relevance_score") >= THRESHOLDS["finance_relevance_floor"]) & ~blocked & ~gated & F.col("keep")
    rows = rows.withColumns({"is_finance_relevant": relevant, "asset_classes": _passed(F.col("_asset"), THRESHOLDS["asset_class_min"]), "impact_reason_codes": _passed(F.col("_reason"), THRESHOLDS["reason_code_min"])})
    slash = lambda c, none: F.when(F.size(c) > 0, F.array_join(c, "/")).otherwise(none)
    terms = F.concat("asset_classes", "impact_reason_codes", F.slice("candidate_entities", 1, 8))
    best = lambda c, p: F.map_from_entries(F.transform(F.slice(F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("key")))), 1, 3), lambda x: F.struct(F.concat(F.lit(p), x["key"]), -x["minus"])))
    parts = {"asset_class_max": "_a", "reason_code_max": "_r", "negative_class_max": "_n", "prefilter_rule_score": "rule_score", "domain_prior": "domain_prior", "source_type_prior": "source_prior", "sentiment_confidence": "_mood", "entity_density": "_density", "raw_relevance_score": "finance_relevance_score"}
    base = F.create_map(*(x for k, c in parts.items() for x in (F.lit(k), F.col(c).cast("double"))))
    have = lambda c, kind="string": F.col(c) if c in captures.columns else F.lit(None).cast(kind).alias(c)
    return rows.select(
        "capture_id", have("doc_id"), "title", F.coalesce(F.when(F.length("text") > 0, F.substring("text", 1, 2000)), F.col("title"), F.lit("(no body)")).alias("text_excerpt"),
        have("published_ts", "timestamp"), "domain", have("language"), have("url"), "is_finance_relevant", "finance_relevance_score", "asset_classes", "impact_reason_codes", "candidate_symbols", "candidate_entities",
        horizons(F.col("impact_reason_codes")).alias("impact_horizons"), "sentiment_label", F.col("sentiment_score").cast("double").alias("sentiment_score"), evidence(F.col("title"), sentences(F.col("text")), terms).alias("evidence_sentences"),
        F.concat(slash(F.col("asset_classes"), "general"), F.lit(" | "), slash(F.col("impact_reason_codes"), "no-specific-reason"), F.lit(" | sentiment="), F.col("sentiment_label")).alias("reason_text"),
        F.map_concat(base, best(F.col("_asset"), "ac_"), best(F.col("_reason"), "rc_")).alias("component_scores"),
    )


def hash_embedding(texts: DataFrame, text: str = "text", size: int = 64) -> DataFrame:
    """Add ``vector``: signed hashes of words and, by half, of word pairs, at unit length."""
    names = texts.columns
    schema = T.StructType([*texts.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])
    where = names.index(text)

    def one(value: str | None) -> list[float]:
        out = np.zeros(size, np.float32)
        words = regex.findall(r"[a-z0-9]+", (value or "").lower())
        for feature, weight in [*((w, 1.0) for w in words), *((f"{a} {b}", 0.5) for a, b in pairwise(words))]:
            h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
            out[h % size] += weight if h >> 32 & 1 else -weight
        norm = float(np.linalg.norm(out)) or 1.0
        return (out / norm).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = pa.array([one(t) for t in batch.column(where).to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*names, "vector"])

    return texts.mapInArrow(run, schema)


def capture_id(url: Column, text: Column) -> Column:
    """The same id for the same URL and text (a SHA-256 prefix)."""
    return F.concat(F.lit("c-"), F.substring(F.sha2(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), text), 256), 1, 32))
