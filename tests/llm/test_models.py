from __future__ import annotations

import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import hilbert, htmltext, language, neighbours, toxicity

DATA = "/root/testdata/sf0.01"
need_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
WORDS = {"xx": ["bal", "bor", "bim"], "yy": ["kze", "krr", "kyl"], "zz": ["oua", "oei", "oiu"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(2)) for _ in range(n))


def test_language_held_out_and_mixtures(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang := rng.choice(list(WORDS)), rng.randint(3, 30)), lang) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(df)
    out = language.predict_languages(df.drop("lang"), model).toPandas().merge(df.toPandas(), on="doc_id")
    held = out[[zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]]
    assert len(held) > 50 and (held.lang == held.lang_pred).mean() > 0.98
    pi = model.proportions([sentence(rng, "xx", 60) + " " + sentence(rng, "yy", 30), sentence(rng, "zz", 50), "", "123 !"])
    assert pi[0, model.names.index("xx")] == pytest.approx(2 / 3, abs=0.05) and pi[0, model.names.index("zz")] == 0
    assert pi[1].max() == pytest.approx(1) and not pi[2:].any()


def test_language_of_a_text_does_not_depend_on_its_batch(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang := rng.choice(list(WORDS)), rng.randint(3, 30)), lang) for i in range(300)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [sentence(rng, "xx", rng.randint(0, 9)) + " " + sentence(rng, "yy", rng.randint(0, 9)) + rng.choice(["", " oxx", " 12 ", " \u0301"]) for _ in range(150)] + ["\u0301\u0300 \u0302", "", "a", "\u0301 a"]
    whole = model.proportions(texts)
    assert all((model.proportions([t])[0] == whole[i]).all() for i, t in enumerate(texts))
    assert not whole[150:152].any() and whole[152].any() and whole[153].any()


def em_by_the_definition(model, text):
    """The same mixture, word by word with plain loops."""
    import math
    import unicodedata

    letter = lambda c: unicodedata.category(c)[0] in "LM"
    words, low = [], text.lower()
    for i, c in enumerate(low):
        if letter(c):
            if i == 0 or not letter(low[i - 1]):
                words.append(np.zeros(len(model.names)))
            around = [ord(x) if x and letter(x) else 0 for x in (low[i - 1] if i else "", c, low[i + 1 : i + 2])]
            x = (around[0] << 42) ^ (around[1] << 21) ^ around[2]
            words[-1] += model.logs[((x ^ (x >> 29)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48] * language.TEMPER

    def em(pi):
        live = pi > 0
        for _ in range(language.ROUNDS):
            new = language.PRIOR * live
            for w in words:
                share = np.exp(w - w.max()) * pi
                new = new + share / share.sum()
            new, old = new / new.sum(), pi
            pi = new
            if np.abs(new - old).max() < 1e-3:
                break
        return pi, sum(math.log((np.exp(w - w.max()) * pi).sum()) + w.max() for w in words)

    full, _ = em(np.full(len(model.names), 1 / len(model.names)))
    if full.max() >= 0.999:
        return full
    order = np.argsort(-full)
    sets = []
    for size in range(1, len(full) + 1):
        own = np.zeros(len(full))
        own[order[:size]] = full[order[:size]]
        pi, mass = em(own / own.sum())
        sets.append((mass - size * (2 + math.log(len(words))), -size, pi.tolist()))
    return np.array(max(sets)[2])


def test_language_is_the_plain_mixture(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, lang := rng.choice(list(WORDS)), rng.randint(3, 30)), lang) for i in range(300)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for _ in range(60):
        text = " ".join(sentence(rng, x, rng.randint(1, 8)) for x in rng.sample(list(WORDS), rng.randint(1, 3)))
        assert np.allclose(model.proportions([text])[0], em_by_the_definition(model, text), atol=2e-3)


@need_data
def test_language_on_the_documents(spark):
    from tidewire.llm.queries import op3_language_id

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = op3_language_id(spark, DATA).join(docs, "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()


def test_language_awkward(awkward, nothing):
    out = language.predict_languages(awkward, language.fit_languages(awkward)).collect()
    assert [r["lang_pred"] for r in out if r["text"] in (None, "")] == ["und", "und"] and all(0 <= r["score"] <= 1 for r in out)
    assert language.predict_languages(nothing, language.fit_languages(nothing)).count() == 0
    assert {r["lang_pred"] for r in language.predict_languages(awkward, language.fit_languages(nothing)).collect()} == {"und"}


def test_toxicity_folds_exceptions_and_length():
    lexicon = toxicity.Lexicon.learn([], [])
    lexicon.curve = (-2.0, 4.0, 0.0, 0.0)
    for text in ("you idiot", "you 1d10t", "you IDIОT", "ïdiot!", "stúpid", "i​diot"):
        assert lexicon.score(text) > 0.5, text
    for text in ("put it in the trash can", "a clownfish swims", "patriotism", "", None):
        assert lexicon.score(text) < 0.5, text
    assert lexicon.evidence("idiot " + "word " * 5000)[:2] < lexicon.evidence("idiot")[:2]


def test_toxicity_learns_beginnings_and_ignores_copies():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioubcdfgl") for _ in range(6))
    plain = [" ".join(word() for _ in range(60)) for _ in range(600)]
    bad = [" ".join([*(word() for _ in range(60)), "zorbl" + word()[:3]]) for _ in range(60)]
    copies = [" ".join(["copycat", *(f"same{k}" for k in range(30))])] * 40
    lexicon = toxicity.Lexicon.learn(plain + bad + copies, [0] * 600 + [1] * 60 + [1] * 40)
    assert any(t.startswith("zorb") for t in lexicon.weights) and not any(t.startswith(("copy", "same")) for t in lexicon.weights)
    assert lexicon.score("x y zorblqq") > 0.5 > lexicon.score(plain[0])


def test_toxicity_weighs_terms_that_clean_texts_hold_too():
    """A beginning that half its texts share with clean ones counts, but many of them are needed."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioubcdfgl") for _ in range(6))
    make = lambda n, hits: " ".join([*(word() for _ in range(n)), *("grumx" + word()[:2] for _ in range(hits))])
    plain = [make(60, rng.random() < 0.15) for _ in range(900)]
    bad = [make(60, rng.randint(4, 8)) for _ in range(120)]
    lexicon = toxicity.Lexicon.learn(plain + bad, [0] * 900 + [1] * 120)
    assert lexicon.score(make(60, 6)) > 0.5 > lexicon.score(make(60, 1))


def test_toxicity_is_the_plain_match():
    """Against a plain search of every term at every place, with a sweep that many phrases don't slow down."""
    rng = random.Random(5)
    lexicon = toxicity.Lexicon.learn([], [])
    lexicon.weights |= {"zor": 2.0, "zorbl": 3.0}
    lexicon.exceptions |= {"zor clown fish", "moron ic"}

    def plain(text):
        t, free = toxicity.fold(text), {}
        places = lambda x, whole: [i for i in range(len(t)) if t.startswith(x, i) and not (i and t[i - 1].isalnum()) and not (whole and t[i + len(x) : i + len(x) + 1].isalnum())]
        phrases = [(i, i + len(x)) for x in lexicon.exceptions for i in places(x, True)]
        for x, w in lexicon.weights.items():
            for i in places(x, x in lexicon.whole):
                if not any(a <= i and i + len(x) <= b for a, b in phrases):
                    free[i] = max(free.get(i, 0.0), w)
        total, pages = sum(free.values()), len(t) / 300
        return (total / (1 + np.log1p(pages)), total / (1 + pages), max(free.values())) if free else (0.0, 0.0, 0.0)

    parts = ["idiot", "1d10t", "zor", "zorblax", "zor clown fish", "class clown", "clown", "trash can", "trash", "moron ic", "word", "s", "."]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 25)))
        assert np.allclose(lexicon.evidence(text), plain(text)), text
    began = time.monotonic()
    lexicon.score("class clown " * 200_000)
    assert time.monotonic() - began < 20


def test_toxicity_sample_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"text number {i}" + " zorblax" * (i % 7 == 0)) for i in range(900)] + [(3, "another of that id")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 7 == 0)) for i in range(900)] * 2, "doc_id long, quality int, toxic int")
    fits = [toxicity.fit_toxicity(docs.repartition(n), labels.repartition(n), rows=300, most_bytes=b) for n in (1, 7) for b in (3000, 10**8)]
    assert fits[0].curve == fits[2].curve and fits[1].curve == fits[3].curve != fits[0].curve and fits[1].weights == fits[3].weights


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 0, 1), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(awkward, toxicity.fit_toxicity(awkward, labels)).collect()
    assert len(out) == 7 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert toxicity.score_toxicity(nothing, toxicity.fit_toxicity(nothing, labels.limit(0))).count() == 0


def test_sum_product_is_exact_on_small_trees():
    """Marginals equal those from all labelings."""
    from itertools import product

    rng = random.Random(3)
    model = htmltext.Model()
    model.edge = {k: rng.uniform(-2, 2) for k in model.edge}
    tree = htmltext.Tree("<div><p>a</p><ul><li>b<li>c</ul></div>")
    model.node = {f: rng.uniform(-2, 2) for fs in tree.features for f in fs}
    n = len(tree.parent)
    total, on = 0.0, np.zeros(n)
    for y in product((0, 1), repeat=n):
        s = sum(model.node[f] for i in range(n) if y[i] for f in tree.features[i])
        s += sum(model.edge["leaf" if tree.texts[i] is not None else "element", y[tree.parent[i]], y[i]] for i in range(1, n))
        total += np.exp(s)
        on += np.exp(s) * np.array(y)
    assert np.allclose(model.marginals(tree)[0], on / total)


def test_pages_held_out():
    model = htmltext.default_model()
    right = wrong = 0
    for tree, labels in htmltext.labelled_pages(60, seed=123):
        for t, y, p in zip(tree.texts, labels, model.marginals(tree)[0], strict=True):
            if t is not None:
                right += (p > 0.5) == bool(y)
                wrong += (p > 0.5) != bool(y)
    assert wrong <= 0.01 * right


def test_page_markup():
    get = htmltext.default_model().extract
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><script>var a='</p>'</script><!-- <p>no</p> --><article><h1>A &amp; B</h1><p>One\n  two <b>three<br>four<p>Five &lt;six&gt;</article><footer>&copy; x</footer>"
    assert get(page) == "A & B\nOne two three four\nFive <six>"
    assert get(None) == get("") == get("<html></html>") == "" and get("<article><p>" + "<b>x " * 3000) != ""


def test_page_loses_only_what_its_attributes_hide():
    get = htmltext.default_model().extract
    page = """<article><h1>Head line here</h1><p title="the hidden cost of war">One two three four five six.</p><p class="text hidden md:block">Seven eight nine ten, <a href=x title='a hidden link'>linked words</a> go on.</p>
<p data-hidden=1>The area is <math><mi>a</mi><mo>=</mo><mn>42</mn></math> in all of these cases.</p><p hidden>gone1</p><p style="color:red; display: none">gone2</p><span aria-hidden="true">gone3</span><p HIDDEN="">gone4</p></article>"""
    assert get(page) == "Head line here\nOne two three four five six.\nSeven eight nine ten, linked words go on.\nThe area is a=42 in all of these cases."


def test_broken_pages_take_time_in_proportion():
    get = htmltext.default_model().extract
    page = """<html><head><title>T</title><body class='x y' data-a=1 hidden2><!-- c --><article id="m"><p title="a > b">One two &amp; three four<br/>five six seven.<ul><li>x<li>y</ul></article><script>1</script>"""
    for i in range(len(page)):
        assert "title" not in get(page[:i]) and "data-a" not in get(page[:i])
    assert get(page).startswith("One two & three four five six seven.")
    text = "<article><p>One two three four five six seven eight.</p>"
    began = time.monotonic()
    for tail in (
        "<img " + " ".join(f'a{i}=""' for i in range(10_000)), "<a " * 100_000, '<a b="' * 100_001, "<" * 300_000, "</" * 300_000, "<!" * 300_000, "<!--" * 300_000, "<script>" + "</script " * 100_000,
        "<p " + "a=" * 300_000, "<p class" + " " * 1_000_000, '<p class="' + "x " * 500_000, "<div>" * 100_000, "<div>" * 50_000 + "</section>" * 50_000, "<b>" * 50_000 + "<p>" + "<i>" * 50_000 + "</b>" * 50_000,
        "<ul><li>" * 50_000 + "</li>" * 50_000, "<span hidden>" * 100_000, "<p style='" + "; display " * 100_000 + "'",
    ):
        assert get(text + tail).startswith("One two three four five six seven eight."), tail[:30]
    assert time.monotonic() - began < 60
    assert get("<article><p>One two three four five &#" + "0" * 6000 + "65; six &#" + "9" * 6000 + "; seven &#x41; eight</p></article>") == "One two three four five A six � seven A eight"
    assert get("<table><tr><td>a<td>b<tr><td>c<td>d</table>") is not None
    assert htmltext.Tree("<head><meta x><p>One two three").texts[-1] == "One two three"


def test_pages_awkward(awkward, nothing):
    rename = lambda d: d.withColumnRenamed("text", "html")
    out = htmltext.extract_text(rename(awkward))
    assert out.count() == 7 and out.filter("main_text is null").count() == 0 and htmltext.extract_text(rename(nothing)).count() == 0


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = hilbert.hilbert_index(grid, bits)
        assert sorted(keys) == list(range(len(grid))) and (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_recall_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6000, 16))
    base[3000:3400] = base[0]  # a large group of equal vectors
    base[5000] = base[17] * 3  # the same direction
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(7000, [1.0] * 3), (7050, [1.0, 2.0, 3.0]), (6001, None), (6002, [0.0] * 16), (6003, [float("nan")] * 16), (6004, [1.0, None] + [0.0] * 14), (6050, [1.0] * 3), (None, [1.0] * 16), (17, [float(x) for x in base[17]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0, 5).toPandas()
    # Vectors of three components are near each other only: 6050 isn't a query's own length for 16.
    short = got[got.query_id >= 6000]
    assert sorted(zip(short.query_id, short.vec_id, strict=True)) == [(6050, 7000), (6050, 7050), (7000, 6050), (7000, 7050), (7050, 6050), (7050, 7000)]
    got = got[got.query_id < 6000]
    asked = [i for i in range(6000) if i % 50 == 0]
    assert set(got.query_id) == set(asked) and (got.groupby("query_id").size() == 5).all() and got.vec_id.max() < 6000
    unit = base.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for q, own in got.groupby("query_id"):
        s = unit @ unit[q]
        s[q] = -9
        kth = np.sort(s)[-5]
        hits += (own.score >= kth - 1e-9).sum()
        assert np.allclose(s[own.vec_id], own.score, atol=1e-9)
    assert hits >= 0.9 * 5 * len(asked)
    zero = got[got.query_id == 3000].sort_values("rank")
    assert zero.vec_id.tolist() == [0, 3001, 3002, 3003, 3004]


def test_neighbours_repeated_ids_do_not_use_up_a_group(spark):
    """Rows of one id count once among equal vectors, however many there are."""
    same, other = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(7, same)] * 8 + [(9, same), (100, other), (101, [1.0, 2.0, 2.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 7, 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [9, 101]
    twice = [(i, same) for i in range(10)] * 2 + [(i, [1.0, float(i), 0.0]) for i in range(20, 30)]
    got = neighbours.nearest(spark.createDataFrame(twice, "vec_id long, embedding array<double>"), F.col("vec_id") < 10, 5).toPandas()
    assert len(got) == 50 and all(sorted(own.vec_id) == [i for i in range(10) if i != q][:5] for q, own in got.groupby("query_id"))


def test_neighbours_ties_go_to_the_smaller_id(spark):
    """Multiples of one vector have one direction; vectors that mirror each other have one cosine."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=20)
    rows = [(i, [float(x) for x in v * (0.1 + 0.37 * i)]) for i in range(29)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5] and all(1 - 1e-12 < r["score"] <= 1 for r in got)
    mirrored = [(50, [1.0, 0.0, 0.0])] + [(i, [3.0, 0.1 * (-1) ** i, 0.7] if i % 3 else [3.0, 0.7, 0.1 * (-1) ** i]) for i in range(9, 0, -1)]
    got = neighbours.nearest(spark.createDataFrame(mirrored, "vec_id long, embedding array<double>"), F.col("vec_id") == 50).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("n", [600, 3000, 12_000])
def test_neighbours_recall_is_alike_at_every_size(spark, n):
    """Vectors without structure, where windows are all that an ordering can offer."""
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    unit = base.astype(float) / np.linalg.norm(base.astype(float), axis=1, keepdims=True)
    hits = 0
    for q, own in got.groupby("query_id"):
        s = unit @ unit[q]
        s[q] = -9
        hits += (own.score >= np.sort(s)[-5] - 1e-9).sum()
    assert hits >= 0.88 * 5 * len(range(0, n, 50))


def test_neighbours_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
