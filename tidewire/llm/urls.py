"""URL filters: rules of hosts and paths, and boosted trees on lexical features for what no rule says.

The trees are grown from labelled URLs by DataFrame aggregates alone.  Features
are cut at their quantiles, so that equal rows fall together before anything is
learned.  A level of a tree is one aggregate: the sums of gradients and
curvatures for every (node, feature, bin), a table of bounded size whatever the
number of rows, from which the split of the level is read.  All nodes of a
level share their split, so a tree is as many comparisons as it has levels and
a list of leaf values, and a model is one short expression.

Suffix statistics tell how often URLs of the same host suffix or file ending
are blocked.  They are counted over all labelled rows, in a fixed number of
hash buckets, so that their table can be broadcast at any size of the corpus.
A labelled row's own statistics leave out its fold.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_hash, materialize, named

BLOCK, ALLOW = "block", "allow"
#: Rows that the trees are grown from at most (those of least hash), and their number, levels, step and shrinkage of small leaves.
FIT_ROWS, TREES, LEVELS, STEP, SHRINK = 200_000, 24, 3, 0.3, 1.0
#: Bins of a feature at most, and trees after which the scores so far are written down.
BINS, WRITTEN = 32, 8
#: Buckets of each suffix statistic, folds, and rows that the overall rate stands for in a bucket.
BUCKETS, FOLDS, PRIOR = 4096, 5, 20
#: Characters told apart by the entropy; all others count as one.
PRINTABLE = [chr(c) for c in range(0x21, 0x7F)]
SUFFIXES = ("top", "site", "ending")
LEXICAL = ("length", "host_length", "labels", "hyphens", "depth", "digits", "host_digits", "entropy", "parameters")
FEATURES = (*LEXICAL, *(f"{s}_{x}" for s in SUFFIXES for x in ("rate", "seen")))


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(urls: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Add host, path, and the rule and rule_verdict of the longest of ``rules`` that fits (else null).

    A rule fits its host and all subdomains if the path starts with the rule's.
    The rules are part of the plan: a list as people write it.
    """
    host, path = host_and_path(F.col(url))
    out = urls.withColumns({"host": host, "path": path})
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    fits = [((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path)) for r in ordered]
    first = lambda values: F.coalesce(F.lit(None).cast("string"), *(F.when(fit, F.lit(v)) for fit, v in zip(fits, values, strict=True)))
    return out.withColumns({"rule": first([r.name for r in ordered]), "rule_verdict": first([r.verdict for r in ordered])})


def _entropy(text: Column) -> Column:
    """Bits a character."""
    whole = F.length(text)
    known = F.filter(F.transform(F.array(*map(F.lit, PRINTABLE)), lambda c: whole - F.length(F.replace(text, c, F.lit("")))), lambda n: n > 0)
    other = whole - F.aggregate(known, F.lit(0), lambda a, n: a + n)
    bits = lambda n: n * F.log2(n.cast("double"))
    total = F.aggregate(known, F.lit(0.0), lambda a, n: a + bits(n)) + F.when(other > 0, bits(other)).otherwise(0.0)
    return F.when(whole > 0, F.log2(whole.cast("double")) - total / whole).otherwise(0.0)


def with_lexical_features(urls: DataFrame, url: str) -> DataFrame:
    """Add the lexical features of ``url`` and the bucket of each suffix; ``urls`` has host and path."""
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    labels = F.size(F.split(host, r"\."))
    digits = lambda c: F.regexp_count(c, F.lit("[0-9]")) / F.greatest(F.length(c), F.lit(1))
    keys = {"top": F.substring_index(host, ".", -1), "site": F.substring_index(host, ".", -2), "ending": F.regexp_extract(path, r"\.([^./]*)/*$", 1)}
    return urls.withColumns({
        "length": F.length(text).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": labels.cast("double"),
        "hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "digits": digits(text),
        "host_digits": digits(host),
        "entropy": _entropy(text),
        "parameters": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0),
        **{f"{s}_bucket": F.pmod(F.xxhash64(F.lit(s), key), F.lit(BUCKETS)).cast("int") for s, key in keys.items()},
    })


def _statistic(seen: Column, blocked: Column, rate: float) -> dict[str, Column]:
    return {"rate": (blocked + PRIOR * rate) / (seen + PRIOR), "seen": F.log1p(seen.cast("double"))}


@dataclass
class UrlModel:
    """Suffix statistics, and trees of (feature, cut) splits with a value for each leaf."""

    suffixes: DataFrame | None = None
    rate: float = 0.0
    trees: list[tuple[list[tuple[str, float]], list[float]]] = field(default_factory=list)
    start: float = 0.0

    def score(self) -> Column:
        """The chance that a URL is to be blocked, from its features."""

        def value(splits: list[tuple[str, float]], leaves: list[float]) -> Column:
            leaf = reduce(lambda a, b: a + b, [F.when(F.col(f) > cut, 1 << k).otherwise(0) for k, (f, cut) in enumerate(splits)])
            return F.element_at(F.array(*map(F.lit, leaves)), leaf + 1)

        total = reduce(lambda a, b: a + b, [value(*tree) for tree in self.trees], F.lit(self.start))
        return 1 / (1 + F.exp(-total))


def with_suffix_features(urls: DataFrame, model: UrlModel) -> DataFrame:
    for s in SUFFIXES:
        own = model.suffixes.filter(F.col("suffix") == s).select(F.col("bucket").alias(f"{s}_bucket"), F.col("seen").alias("_seen"), F.col("blocked").alias("_blocked"))
        # At most BUCKETS rows, whatever the input.
        urls = urls.join(F.broadcast(own), f"{s}_bucket", "left")
        stats = _statistic(F.coalesce("_seen", F.lit(0)), F.coalesce("_blocked", F.lit(0)), model.rate)
        urls = urls.withColumns({f"{s}_{x}": c for x, c in stats.items()}).drop("_seen", "_blocked")
    return urls


def _split(sums: dict[tuple[int, int, int], tuple[float, float]], nodes: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the split of all nodes that gains most, the first of equal ones; rows of that bin and below go left."""
    best = None
    features = defaultdict(set)
    for _, f, b in sums:
        features[f].add(b)
    gain = lambda g, h: g * g / (h + SHRINK)
    for f, bins in sorted(features.items()):
        whole = {n: [sum(sums.get((n, f, b), (0.0, 0.0))[k] for b in bins) for k in (0, 1)] for n in range(nodes)}
        left = {n: [0.0, 0.0] for n in range(nodes)}
        for b in sorted(bins)[:-1]:
            total = 0.0
            for n in range(nodes):
                g, h = sums.get((n, f, b), (0.0, 0.0))
                left[n][0] += g
                left[n][1] += h
                (lg, lh), (wg, wh) = left[n], whole[n]
                total += gain(lg, lh) + gain(wg - lg, wh - lh) - gain(wg, wh)
            # Sums of tasks come in any order; digits that this changes decide nothing.
            total = float(f"{total:.9g}")
            if total > 1e-9 and (best is None or total > best[0]):
                best = total, f, b
    return best


def fit_urls(labelled: DataFrame) -> UrlModel:
    """Suffix statistics over all of ``labelled`` (url, blocked: 1 or 0), and trees grown from ``FIT_ROWS`` of them at most.

    Rows without a label are left out, null URLs are empty ones.  Without
    labelled rows everything is allowed; with one label alone that is the answer.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(F.coalesce("url", F.lit("")).alias("url"), F.col("blocked").cast("int").alias("blocked"), host.alias("host"), path.alias("path")).filter(F.col("blocked").isNotNull())
    rows = with_lexical_features(rows, "url").withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    buckets = F.explode(F.array(*(F.struct(F.lit(s).alias("suffix"), F.col(f"{s}_bucket").alias("bucket")) for s in SUFFIXES)))
    tallies = rows.select(buckets.alias("_b"), "fold", "blocked").groupBy("_b.suffix", "_b.bucket", "fold").agg(F.count(F.lit(1)).alias("seen"), F.sum("blocked").alias("blocked"))
    tallies = materialize(tallies, "url-tallies")
    total = tallies.filter(F.col("suffix") == SUFFIXES[0]).agg(F.sum("seen"), F.sum("blocked")).first()
    seen, blocked = total[0] or 0, total[1] or 0
    suffixes = materialize(tallies.groupBy("suffix", "bucket").agg(F.sum("seen").alias("seen"), F.sum("blocked").alias("blocked")), "url-suffixes")
    model = UrlModel(suffixes, blocked / seen if seen else 0.0, [], math.log((blocked + 0.5) / (seen - blocked + 0.5)) if seen else -1.0)
    if blocked in (0, seen):
        return model
    sample = by_hash(rows, FIT_ROWS / seen, "url")
    for s in SUFFIXES:
        own = tallies.filter(F.col("suffix") == s)
        whole = own.groupBy("bucket").agg(F.sum("seen").alias("_all"), F.sum("blocked").alias("_bad"))
        own = whole.join(own.select("bucket", "fold", "seen", F.col("blocked").alias("bad")), "bucket").select(F.col("bucket").alias(f"{s}_bucket"), "fold", (F.col("_all") - F.col("seen")).alias("_seen"), (F.col("_bad") - F.col("bad")).alias("_blocked"))
        # At most BUCKETS * FOLDS rows.
        sample = sample.join(F.broadcast(own), [f"{s}_bucket", "fold"])
        sample = sample.withColumns({f"{s}_{x}": c for x, c in _statistic(F.col("_seen"), F.col("_blocked"), model.rate).items()}).drop("_seen", "_blocked")
    sample = materialize(sample.select("blocked", *FEATURES), "url-sample")
    ranks = [k / BINS for k in range(1, BINS)]
    found = sample.agg(*(F.percentile_approx(f, ranks, 2000).alias(f) for f in FEATURES)).first()
    cuts = [sorted(set(found[f])) for f in FEATURES]
    number = lambda f, own: F.size(F.filter(F.array(*map(F.lit, own)), lambda c: c < F.col(f)))
    bins = F.array(*(number(f, own) for f, own in zip(FEATURES, cuts, strict=True))).alias("bins")
    grown = sample.select(bins, "blocked").groupBy("bins").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("bad")).withColumn("total", F.lit(model.start))
    grown = materialize(grown, "url-bins")
    for k in range(TREES):
        tree = _grow(grown)
        if tree is None:
            break
        splits, leaves = tree
        model.trees.append(([(FEATURES[f], cuts[f][b]) for f, b in splits], leaves))
        grown = grown.withColumn("total", F.col("total") + F.element_at(F.array(*map(F.lit, leaves)), _leaf(splits) + 1))
        if k % WRITTEN == WRITTEN - 1:
            grown = materialize(grown, "url-bins")
    return model


def _leaf(splits: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.col("bins")[f] > b, 1 << k).otherwise(0) for k, (f, b) in enumerate(splits)], F.lit(0))


def _grow(rows: DataFrame) -> tuple[list[tuple[int, int]], list[float]] | None:
    """Splits (feature, bin) and leaf values of the next tree for ``rows`` (bins, n, bad, total); None if nothing gains."""
    chance = 1 / (1 + F.exp(-F.col("total")))
    rows = rows.withColumns({"g": F.col("bad") - F.col("n") * chance, "h": F.col("n") * chance * (1 - chance)})
    splits: list[tuple[int, int]] = []
    while len(splits) < LEVELS:
        cells = rows.select(_leaf(splits).alias("node"), "g", "h", F.posexplode("bins").alias("feature", "bin"))
        # Nodes x features x bins at most.
        sums = {(r[0], r[1], r[2]): (r[3], r[4]) for r in cells.groupBy("node", "feature", "bin").agg(F.sum("g"), F.sum("h")).collect()}
        best = _split(sums, 1 << len(splits))
        if best is None:
            break
        splits.append(best[1:])
    if not splits:
        return None
    # The leaves' sums are those of the last level's bins on either side of its split.
    f, b = splits[-1]
    half = 1 << (len(splits) - 1)
    if best is None:
        sums = {(r[0], f, 0): (r[1], r[2]) for r in rows.groupBy(_leaf(splits)).agg(F.sum("g"), F.sum("h")).collect()}
        leaves = [sums.get((leaf, f, 0), (0.0, 0.0)) for leaf in range(2 * half)]
    else:
        leaves = [[0.0, 0.0] for _ in range(2 * half)]
        for (node, own, at), (g, h) in sums.items():
            if own == f:
                leaf = leaves[node + (half if at > b else 0)]
                leaf[0] += g
                leaf[1] += h
    return splits, [float(f"{STEP * g / (h + SHRINK):.9g}") for g, h in leaves]


def judge_urls(urls: DataFrame, rules: list[Rule], model: UrlModel) -> DataFrame:
    """Add host, path, rule, score and verdict (the rule's, else block at a score of one half) to ``urls`` (url, ...).

    A null URL, or one without ``://``, has an empty host and path and no rule.
    Repeated rows get equal verdicts, an empty table gives none, and columns
    named like an added one are replaced; all others come back as they were.
    """
    added = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in urls.columns if c not in added]
    # The caller's columns travel as one struct, so that none of their names can clash with a feature's.
    rows = urls.select(F.struct(*(named(c) for c in kept)).alias("_row"), F.col("url").alias("_url"))
    rows = with_suffix_features(with_lexical_features(with_rules(rows, rules, "_url"), "_url"), model).withColumn("score", model.score())
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))
    return rows.withColumn("verdict", verdict).select(*(F.col("_row").getField(c).alias(c) for c in kept), *added)
