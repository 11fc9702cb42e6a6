from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from tidewire.llm import urls
from tidewire.llm.queries import URL_RULES
from tidewire.llm.urls import Rule


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:stop], rest[stop:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


ODD = [
    None, "", "no scheme", "http://", "https://Example.NET/en/1", "http://example.net/en", "http://badexample.net/en/2", "http://a.b.example.com/de/?x=1", "x://org/fr/#y", "http://net", "http://net/",
    "http://u.org?fr/=1", "http://u.org#/fr/", "a://b://c.net/", "http://ÄÖ.NET/ä/\n/b?c\n#d", "http://example.com/de/" + "x" * 200_000, "://", "http://ex\nample.net/q", "HTTP://EXAMPLE.COM/DE/", "http://example.com/de/", "http://x.org/fr//",
]


def test_hosts_paths_and_rules(spark):
    rng = random.Random(2)
    odd = ODD + ["".join(rng.choice(["http", "://", "net", "org", "example", ".", "com", "/", "en", "de", "fr", "?", "#", "&", "A", "é"]) for _ in range(rng.randint(1, 12))) for _ in range(800)]
    rules = [*URL_RULES, Rule("block", "example.org", "/fr/"), Rule("allow", "com", "/d"), Rule("block", "", "/x")]
    for own in (URL_RULES, rules[:-1]):
        out = urls.with_rules(spark.createDataFrame(list(enumerate(odd)), "i long, url string"), own).collect()
        assert len(out) == len(odd)
        for r in out:
            host, path = parts(r["url"])
            assert (r["host"], r["path"], r["rule"], r["rule_verdict"]) == (host, path, *ruled(host, path, own)), repr(r["url"])[:200]


def bad_and_good(n, seed):
    """URLs whose label shows in their form alone."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("aeioubcdfghlmnprst") for _ in range(k))
    out = []
    for _ in range(n):
        top = rng.choice(["com", "net", "org"])
        if rng.random() < 0.4:
            junk = "".join(rng.choice("abcdef0123456789") for _ in range(24))
            out.append((f"http://{word(4)}-{word(3)}-{rng.randint(100, 99999)}.{top}/{junk}?{'&'.join(f'{word(1)}={rng.randint(0, 9**6)}' for _ in range(rng.randint(2, 6)))}", 1))
        else:
            out.append((f"https://www.{word(7)}.{top}/{word(5)}/{word(8)}.html", 0))
    return out


def test_held_out_accuracy(spark):
    model = urls.fit_urls(spark.createDataFrame(bad_and_good(1500, 1), "url string, blocked int"))
    assert model.trees
    fresh = bad_and_good(600, 2)
    out = urls.judge_urls(spark.createDataFrame(fresh, "url string, blocked int"), [], model).collect()
    right = sum((r["verdict"] == "block") == (r["blocked"] == 1) for r in out)
    assert len(out) == 600 and right >= 590


def test_suffix_statistics_tell_apart(spark):
    rng = random.Random(4)
    rows = [(f"http://h{rng.randint(0, 40)}.{top}/{rng.randint(10, 99)}", int(top == "zip")) for top in rng.choices(["zip", "com"], k=800)]
    model = urls.fit_urls(spark.createDataFrame(rows, "url string, blocked int"))
    out = urls.judge_urls(spark.createDataFrame([("http://new.zip/11",), ("http://new.com/11",)], "url string"), [], model).collect()
    assert {r["url"]: r["verdict"] for r in out} == {"http://new.zip/11": "block", "http://new.com/11": "allow"}


def plain_features(url):
    host, path = parts(url)
    counts = Counter(c if "!" <= c <= "~" else "" for c in url)
    entropy = -sum(n / len(url) * math.log2(n / len(url)) for n in counts.values()) if url else 0.0
    digits = lambda s: sum(c in "0123456789" for c in s) / max(1, len(s))
    query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
    depth = sum(a == "/" and b != "/" for a, b in zip(path, path[1:], strict=False))
    return (len(url), len(host), host.count(".") + 1, host.count("-"), depth, digits(url), digits(host), entropy, query.count("&") + 1 if query else 0)


def test_lexical_features(spark):
    rows = [(u,) for u in [*ODD, *(u for u, _ in bad_and_good(50, 3))] if u is not None]
    out = urls.with_lexical_features(urls.with_rules(spark.createDataFrame(rows, "url string"), []), "url").collect()
    for r in out:
        assert [r[f] for f in urls.LEXICAL] == pytest.approx(plain_features(r["url"]), abs=1e-6), repr(r["url"])[:100]


def test_trees_as_grown_by_hand(spark, monkeypatch):
    """Each tree against a search over all splits, row by row."""
    rng = random.Random(6)
    rows = [([rng.randint(0, 3), rng.randint(0, 2)], 1) for _ in range(200)]
    rows = [(b, n, int(b[0] > 1) ^ int(b[1] > 0) if rng.random() < 0.9 else 1, -0.3) for b, n in rows]
    monkeypatch.setattr(urls, "LEVELS", 2)
    splits, leaves = urls._grow(spark.createDataFrame(rows, "bins array<int>, n long, bad long, total double"))
    p = 1 / (1 + math.exp(0.3))

    def gain(groups):
        return sum(sum(y - p for y in g) ** 2 / (len(g) * p * (1 - p) + urls.SHRINK) for g in groups)

    def leaf(b, splits):
        return sum(int(b[f] > c) << k for k, (f, c) in enumerate(splits))

    def grouped(splits):
        return [[r[2] for r in rows if leaf(r[0], splits) == k] for k in range(1 << len(splits))]

    own = []
    for _ in range(2):
        own.append(max(((f, c) for f in range(2) for c in range(3 - f)), key=lambda s: (round(gain(grouped([*own, s])), 9), -s[0], -s[1])))
    assert splits == own
    assert leaves == pytest.approx([urls.STEP * sum(y - p for y in g) / (len(g) * p * (1 - p) + urls.SHRINK) for g in grouped(own)], rel=1e-6)


def test_awkward(spark):
    schema = "page_id long, url string, host int, score string, `a.b` string, length string"
    rows = [(k, u, 1, "s", "x", "y") for k, u in enumerate([*ODD, *ODD])] + [(None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, schema)
    empty = spark.createDataFrame([], schema)
    one = spark.createDataFrame([("http://a.net/", 1), (None, 1), ("x", None)], "url string, blocked int")
    for model, verdict in ((urls.fit_urls(one.limit(0)), "allow"), (urls.fit_urls(one), "block")):
        out = urls.judge_urls(pages, URL_RULES, model).collect()
        assert len(out) == len(rows) and {r["verdict"] for r in out if r["rule"] is None} == {verdict}
        assert set(out[0].asDict()) == {"page_id", "url", "a.b", "length", "host", "path", "rule", "score", "verdict"} and out[0]["a.b"] == "x" and out[0]["length"] == "y"
        assert urls.judge_urls(empty, URL_RULES, model).count() == 0
