from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from tidewire.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = W.findall(text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_statistics_match_brute_force(spark):
    rng = random.Random(2)
    words = ["a", "bb", "ccc", "é", "#x", "|", "日本", " "]
    texts = [None, "", " ", "\n\n", "a b c d e a b c d e", "x " * 12] + ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t ", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = quality.with_text_statistics(df).collect()
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_outliers_go_and_clean_texts_stay(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    clean = [" ".join(word() for _ in range(rng.randint(12, 600))) for _ in range(900)]
    junk = [" ".join(word() + "###" for _ in range(80)) for _ in range(60)] + [" ".join("z" * 60 for _ in range(5)) + " " + " ".join("q" * rng.randint(50, 70) + word() for _ in range(60)) for _ in range(20)]
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(clean + junk)]
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id")
    assert out.kept[: len(clean)].mean() > 0.995 and not out.kept[out.index >= len(clean)].any()


def test_awkward(awkward, nothing):
    out = {r["doc_id"]: r for r in quality.quality_rules(awkward).collect()}
    assert out[1]["base_failed"] and not out[2]["kept"] and set(out[3].asDict()) >= {"lang", "kept", "n_words"}
    assert quality.quality_rules(nothing).count() == 0
    # Columns of the caller's that are named like inner ones come back as they were.
    named = awkward.selectExpr("*", "'mine' AS x0", "'mine' AS m0", "'mine' AS cell", "'mine' AS _own", "'mine' AS _words", "'mine' AS _rows")
    assert quality.quality_rules(named).select("x0", "m0", "cell", "_own", "_words", "_rows").distinct().collect() == [("mine",) * 6]


def test_small_cells_are_judged_by_their_own_language(spark):
    """Words long for a small language are far out there, though another language has such words, and thin sources next to a hot one stay with it."""
    rng = random.Random(4)
    text = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(k - 1, k + 1))) for _ in range(rng.randint(40, 90)))
    rows = [(text(3), "aa", "hot") for _ in range(450)] + [(text(3), "aa", f"s{i % 3}") for i in range(120)] + [(text(12), "bb", f"s{i % 3}") for i in range(120)] + [(text(7), "cc", "s0") for _ in range(40)]
    odd = [(text(12), "aa", "s0"), (text(12), "aa", "rare"), (text(3), "bb", "s1"), (text(14), "cc", "s0")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows + odd)], "doc_id long, text string, lang string, source string")
    out = quality.quality_rules(df).toPandas().set_index("doc_id").sort_index()
    assert out.kept[: len(rows)].all() and not out.kept[out.index >= len(rows)].any() and out.distance.notna().all()


def test_trimmed_shares_are_those_of_a_normal_distribution():
    import numpy as np

    d = np.sort((np.random.default_rng(5).normal(size=(400_000, 5)) ** 2).sum(axis=1))
    for share, factor in quality.TRIMMED.items():
        assert abs(d[: int(share * len(d))].mean() / 5 - factor) < 0.003


def mcd(x, share=quality.SHARE, starts=40, seed=1):
    """The minimum covariance determinant by many random starts, with the operator's floors; the log determinant too."""
    rng = np.random.default_rng(seed)
    floors, h = np.diag(np.square(quality.FLOORS)), int(np.ceil(share * len(x)))

    def moments(own, factor):
        return own.mean(axis=0), np.cov(own.T, bias=True) / factor + floors

    def squares(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    best = None
    for _ in range(starts):
        m, c = moments(x[rng.choice(len(x), 8, replace=False)], 1)
        for _ in range(60):
            m, c = moments(x[np.argsort(squares(m, c), kind="stable")[:h]], quality.TRIMMED[0.75])
        found = (np.linalg.slogdet(c)[1], m, c)
        best = found if best is None or found[0] < best[0] else best
    return best[0], *moments(x[squares(best[1], best[2]) <= quality.NEAR], quality.TRIMMED[0.975])


def test_estimate_is_the_least_determinant_of_many_starts(spark):
    """Correlated cells with a fifth of far rows: centre and scatter agree with a plain search from random starts."""
    rng = np.random.default_rng(3)
    cells, rows = {}, []
    for cell in ("a", "b", "c"):
        mix = rng.normal(size=(5, 5)) * 2
        x = rng.normal(size=(400, 5)) @ mix + rng.normal(size=5)
        x[:80] = rng.normal(size=(80, 5)) * 0.5 + 25
        cells[cell] = x
        rows += [(cell, *map(float, v)) for v in x]
    got = quality.fit_scatter(spark.createDataFrame(rows, "cell string, x0 double, x1 double, x2 double, x3 double, x4 double")).toPandas().set_index("cell")
    for cell, x in cells.items():
        _, m, c = mcd(x)
        mine = np.array([got.loc[cell, f"m{i}"] for i in range(5)])
        scatter = np.array([[got.loc[cell, f"c{max(i, j)}{min(i, j)}"] for j in range(5)] for i in range(5)])
        assert np.allclose(mine, m, atol=0.15 * np.sqrt(np.diag(c)).max()) and abs(np.linalg.slogdet(scatter)[1] - np.linalg.slogdet(c)[1]) < 0.3


def test_verdicts_match_a_plain_version(spark):
    """Two languages with sources of several sizes: distances from plain estimates, led from all rows to language to source."""
    rng = random.Random(7)
    text = lambda k, n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(k - 2, k + 2))) + ("#" if rng.random() < 0.02 else "") for _ in range(n))
    rows = [(text(4 + 2 * (lang == "bb"), rng.randint(15, 200)), lang, source) for lang in ("aa", "bb") for source, n in (("big", 300), ("mid", 60), ("small", 10)) for _ in range(n)]
    rows += [(text(14, 50), "aa", "big"), (text(4, 60).replace(" ", "| "), "bb", "mid"), (text(13, 30), "bb", "small"), (text(4, 5), "aa", "mid")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    out = quality.quality_rules(df).toPandas().set_index("doc_id").sort_index()
    stats = [brute(t) for t, _, _ in rows]
    failed = [s[0] < 10 or 100 * s[4] > 20 * s[0] for s in stats]
    assert out.base_failed.tolist() == failed
    x = np.array([[np.log(max(n, 1)), np.log(max(c / max(n, 1), 0.5)), np.arcsinh(20 * y / max(n, 1)), np.log1p(d), np.arcsinh(20 * r / max(n, 1))] for n, c, y, d, r in stats])
    fine = ~np.array(failed)
    langs, sources = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    cache = {}

    def estimate(name, mask):
        if name not in cache:
            cache[name] = (mask.sum(), *mcd(x[mask])[1:]) if mask.sum() >= quality.LEAST else (mask.sum(), None, None)
        return cache[name]

    want = []
    for i in range(len(rows)):
        _, m, c = estimate("", fine)
        for name, mask in (((langs[i],), fine & (langs == langs[i])), ((langs[i], sources[i]), fine & (langs == langs[i]) & (sources == sources[i]))):
            n, mine, scatter = estimate(name, mask)
            if mine is not None:
                a, b = n / (n + quality.CENTRE_ROWS), n / (n + quality.SCATTER_ROWS)
                m, c = a * mine + (1 - a) * m, b * scatter + (1 - b) * c
        d = (x[i] - m) @ np.linalg.inv(c) @ (x[i] - m)
        want.append(bool(fine[i]) and d <= quality.FAR)
    assert (out.kept != np.array(want)).sum() <= 1 and not out.kept.tolist()[-4:].count(True)
