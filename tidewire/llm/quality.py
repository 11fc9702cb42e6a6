"""Quality rules: a base rule, then robust multivariate outliers, with DataFrame functions alone.

Every text gets a vector of transformed statistics.  Per language and source a
minimum-covariance-determinant estimate gives centre and scatter of the bulk,
and texts at a large Mahalanobis distance from it are rejected.  The fewer rows
a cell has, the more its estimate leans on that of all rows of its language,
and that one on the estimate of all rows.

The estimate is the best of several starts, as in fast MCD: medians and
quartile ranges, and the scatters of two bounded transforms and of the plain
values.  From each, concentration steps keep the ``SHARE`` of rows nearest to
the centre and take their mean and covariance.  After ``TRIALS`` steps the
start of least determinant stays in each cell and goes on until determinants
no longer fall; a last step takes all rows within a quantile.  Each step
aggregates sums of products per cell (a language and source, a language, or
all rows), so a source with a third of all rows costs partial sums, never a
task of its own.  All rows take part in every step, each in its cells of the
three levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, let, materialize, named

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5
#: Share of rows in a concentration step, ranks that its cut may be off (one in so many), steps of each start and of the best at most.
SHARE, RANKS, TRIALS, STEPS = 0.75, 2000, 2, 30
#: Steps end where no cell's log determinant falls by more.
SETTLED = 1e-3
STARTS = ("ranges", "tanh", "signs", "plain")
#: Mean squared distance in 5 dimensions of the nearest 75 % and 97.5 % of a normal distribution, as a share of the whole.
TRIMMED = {0.75: 0.7075, 0.975: 0.9468}
#: 0.975 quantile of chi-square with 5 degrees of freedom, for the last step.
NEAR = 12.83
#: Squared distance beyond which a text is rejected: far outside any normal bulk (chi-square, 5 degrees: 1e-9), as text statistics have long tails.
FAR = 52.0
#: Least standard deviation of each statistic, so that a statistic that is constant in the bulk has a scale.
FLOORS = (0.35, 0.06, 0.35, 0.35, 0.35)
#: Least rows of a cell that is fitted, five for each dimension; smaller ones take the estimate of the level above.
LEAST = 25
#: The cell of all rows.
ALL = "\3"
#: Rows that the level above stands for in a cell's centre and in its scatter, which needs more of them.
CENTRE_ROWS, SCATTER_ROWS = 5, 50
#: Rows of the fitted table (about 300 bytes each) up to which it is broadcast to the documents.
BROADCAST_ROWS = 50_000
DIMS = range(len(FLOORS))


def with_text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text (null: all 0)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, f"{WHITE}+"), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumn("_words", words)
        .withColumn("_lines", lines)
        .withColumns({
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
        })
        .drop("_words", "_lines")
    )


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """How many words lie in a ``k``-word window that is found twice or more."""

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
        return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))

    def covered(g: Column) -> Column:
        order = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            twin = lambda n, x: F.coalesce(F.get(s, n).getField("h") == x.getField("h"), F.lit(False))
            at = F.transform(s, lambda x, n: F.when(twin(n - 1, x) | twin(n + 1, x), x.getField("i")).otherwise(-1))
            return F.array_sort(F.filter(at, lambda i: i >= 0))

        steps = lambda p: F.transform(p, lambda i, n: F.least(F.lit(k), F.coalesce(F.get(p, n + 1) - i, F.lit(k))))
        return let(order, lambda s: let(again(s), lambda p: F.aggregate(steps(p), F.lit(0), lambda a, b: a + b)))

    return F.when(F.size(words) < k, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> list[Column]:
    """Length, word length, and rates of symbols, repeated lines and repeated words, on scales where the bulk is near normal."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.log(F.greatest(F.col("word_chars") / n, F.lit(0.5))),
        F.asinh(20 * F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.asinh(20 * F.col("n_repeat_words") / n),
    ]


def _columns(name: str) -> list[tuple[int, int, str]]:
    return [(i, j, f"{name}{i}{j}") for i in DIMS for j in DIMS if j <= i]


def _whitened(params: DataFrame, *keys: str) -> DataFrame:
    """``keys``, m, the inverse w of the Cholesky factor of the covariances c, and their log determinant, row by row."""
    for i, j, _ in _columns("l"):
        dot = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
        rest = F.col(f"c{i}{j}") - dot
        params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 * 0.01))) if i == j else rest / F.col(f"l{j}{j}"))
    for i, j, _ in _columns("w"):
        if i == j:
            params = params.withColumn(f"w{i}{i}", 1 / F.col(f"l{i}{i}"))
    for i in DIMS:
        for j in reversed(range(i)):
            dot = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)])
            params = params.withColumn(f"w{i}{j}", -dot / F.col(f"l{i}{i}"))
    volume = reduce(lambda a, b: a + b, [2 * F.log(F.col(f"l{i}{i}")) for i in DIMS])
    return params.select(*keys, *(f"m{i}" for i in DIMS), *(c for _, _, c in _columns("w")), volume.alias("volume"))


def _distance() -> Column:
    dx = [F.col(f"x{i}") - F.col(f"m{i}") for i in DIMS]
    rows = [reduce(lambda a, b: a + b, [F.col(f"w{i}{j}") * dx[j] for j in range(i + 1)]) for i in DIMS]
    return reduce(lambda a, b: a + b, [y * y for y in rows])


def _moments(near: DataFrame, factor: float, *keys: str) -> DataFrame:
    """Mean m and covariance c per ``keys``, the latter over ``factor`` and with floors on its diagonal."""
    sums = near.groupBy(*keys).agg(
        *(F.avg(f"x{i}").alias(f"m{i}") for i in DIMS),
        *(F.covar_pop(f"x{i}", f"x{j}").alias(c) for i, j, c in _columns("c")),
    )
    return sums.withColumns({c: F.col(c) / factor + (FLOORS[i] ** 2 if i == j else 0.0) for i, j, c in _columns("c")})


def _starts(rows: DataFrame, small: bool) -> DataFrame:
    """First centre m and scatter c of each (cell, start)."""
    quartiles = rows.groupBy("cell").agg(*(F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], RANKS).alias(f"q{i}") for i in DIMS))
    scales = quartiles.select(
        "cell",
        *(F.col(f"q{i}")[1].alias(f"m{i}") for i in DIMS),
        *(F.sqrt(((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 + FLOORS[i] ** 2).alias(f"s{i}") for i in DIMS),
    )
    scales = materialize(scales, "quality-scales")
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in DIMS]
    length = F.sqrt(reduce(lambda a, b: a + b, [x * x for x in z]))
    kinds = {"tanh": [F.tanh(x) for x in z], "signs": [F.coalesce(F.try_divide(x, length), F.lit(0.0)) for x in z], "plain": z}
    spread = _with(rows, scales, small).select("cell", *(x.alias(f"{kind}{i}") for kind, xs in kinds.items() for i, x in enumerate(xs)))
    found = spread.groupBy("cell").agg(
        *(F.avg(F.col(f"{kind}{i}") * F.col(f"{kind}{j}")).alias(f"{kind}{i}{j}") for kind in kinds for i, j, _ in _columns("c"))
    ).join(scales, "cell")

    def scatter(kind: str, i: int, j: int) -> Column:
        """The transform's correlations, on the scale of the quartile ranges."""
        si, sj = F.col(f"s{i}"), F.col(f"s{j}")
        if i == j:
            return si * sj
        if kind == "ranges":
            return F.lit(0.0)
        norm = F.sqrt(F.col(f"{kind}{i}{i}") * F.col(f"{kind}{j}{j}"))
        return F.coalesce(0.95 * F.try_divide(F.col(f"{kind}{i}{j}"), norm), F.lit(0.0)) * si * sj

    each = [F.struct(F.lit(kind).alias("start"), *(scatter(kind, i, j).alias(c) for i, j, c in _columns("c"))) for kind in STARTS]
    return found.select("cell", *(f"m{i}" for i in DIMS), F.inline(F.array(*each)))


def _with(rows: DataFrame, params: DataFrame, small: bool) -> DataFrame:
    """``rows`` with the values of their cells; a ``small`` table goes to all tasks, so that no cell's rows meet in one."""
    return rows.join(F.broadcast(params) if small else params, "cell")


def _step(rows: DataFrame, params: DataFrame, small: bool) -> DataFrame:
    """One concentration step: params (cell, start, m, w, volume) of the ``SHARE`` of rows nearest by the given ones."""
    far = _with(rows, params, small).withColumn("d", _distance())
    cuts = materialize(far.groupBy("cell", "start").agg(F.percentile_approx("d", SHARE, RANKS).alias("cut")).join(params, ["cell", "start"]), "quality-cuts")
    near = _with(rows, cuts, small).withColumn("d", _distance()).filter("d <= cut")
    return materialize(_whitened(_moments(near, TRIMMED[0.75], "cell", "start"), "cell", "start"), "quality-cells")


def fit_scatter(rows: DataFrame, small: bool = False) -> DataFrame:
    """Centre m and scatter c of each cell of ``rows`` (cell, x0, x1, ...): the minimum covariance determinant, reweighted.

    ``small`` says that the cells are few enough to be broadcast.
    """
    params = materialize(_whitened(_starts(rows, small), "cell", "start"), "quality-cells")
    for _ in range(TRIALS):
        params = _step(rows, params, small)
    best = params.groupBy("cell").agg(F.min_by(F.struct(*params.columns[1:]), F.struct("volume", "start")).alias("best"))
    params = materialize(best.select("cell", "best.*"), "quality-cells")
    live = params
    for _ in range(STEPS):
        # A cut by approximate ranks may raise a determinant a little: the lesser of the two stays, and its cell is settled.
        after = _step(rows, live, small)
        fall = F.max(F.when(F.col("old"), F.col("volume"))) - F.min("volume")
        both = params.withColumn("old", F.lit(True)).unionByName(after.withColumn("old", F.lit(False)))
        both = both.groupBy("cell").agg(F.min_by(F.struct(*params.columns[1:]), "volume").alias("best"), (fall > SETTLED).alias("live"))
        both = materialize(both.select("cell", "best.*", "live"), "quality-cells")
        params, live = both.drop("live"), both.filter("live").drop("live")
        if live.isEmpty():
            break
    near = _with(rows, params, small).withColumn("d", _distance()).filter(F.col("d") <= NEAR)
    return materialize(_moments(near, TRIMMED[0.975], "cell"), "quality-cells")


def _shrunk(names: DataFrame, fitted: DataFrame) -> DataFrame:
    """Centre m and whitening w for each row of ``names`` (_own, _lang, n, lang_rows), led from all rows to the language to the source."""
    levels = (
        names.join(fitted.alias("own"), F.col("_own") == F.col("own.cell"), "left")
        .join(fitted.alias("lang"), _of_language() == F.col("lang.cell"), "left")
        .join(F.broadcast(fitted.filter(F.col("cell") == ALL)).alias("all"), F.lit(True), "left")
    )

    def led(x: str, weight: int) -> Column:
        found = F.col(f"all.{x}")
        for level, n in (("lang", F.col("lang_rows")), ("own", F.col("n"))):
            own, share = F.col(f"{level}.{x}"), n / (n + weight)
            found = F.coalesce(share * own + (1 - share) * found, own, found)
        return found

    centre = [led(f"m{i}", CENTRE_ROWS).alias(f"m{i}") for i in DIMS]
    scatter = [led(c, SCATTER_ROWS).alias(c) for _, _, c in _columns("c")]
    return _whitened(levels.select(F.col("_own").alias("cell"), *centre, *scatter), "cell").drop("volume")


def _of_language() -> Column:
    return F.concat(F.col("_lang"), F.lit("\2"))


def quality_rules(docs: DataFrame, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Add the five statistics, base_failed, kept and distance to the columns ``carry`` (all, if None) of ``docs`` (text, lang, source, ...).

    kept is false if base_failed, else the verdict of the robust distance.  A
    null language or source is a value of its own.  Null and empty texts fail
    the base rule.  Every language and source with ``LEAST`` rows that pass the
    base rule has an estimate of its own, drawn towards that of all rows of the
    language, which is drawn towards that of all rows; with fewer rows the
    level above alone counts.  Only a table with fewer than ``LEAST`` such rows
    in all rejects nothing beyond the base rule.  Repeated rows get equal
    verdicts.  Columns of ``docs`` named like an added one are replaced.
    The statistics and the carried columns are written once to the shared folder.
    """
    kept = [c for c in (carry if carry is not None else docs.columns) if c not in {*BASE, "base_failed", "kept", "distance"}]
    # The caller's columns travel as one struct, so that none of their names can clash with what is added.
    row = F.struct(*(named(c) for c in kept)) if kept else F.struct(F.lit(0).alias("_"))
    stats = with_text_statistics(docs.select(row.alias("_row"), "text", "lang", "source")).withColumn("base_failed", base_failed())
    stats = materialize(stats.select("_row", "lang", "source", *BASE, "base_failed"), "quality-rows")
    lang, source = F.coalesce(F.col("lang").cast("string"), F.lit("\0")), F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    keyed = stats.filter(~F.col("base_failed")).select(lang.alias("_lang"), F.concat_ws("\1", lang, source).alias("_own"), *(x.alias(f"x{i}") for i, x in enumerate(_vector())))
    counts = materialize(keyed.groupBy("_lang", "_own").agg(F.count(F.lit(1)).alias("n")), "quality-counts")
    names = materialize(counts.join(counts.groupBy("_lang").agg(F.sum("n").alias("lang_rows")), "_lang"), "quality-names")
    total = counts.agg(F.sum("n")).first()[0] or 0
    large = [F.when(F.col("n") >= LEAST, F.col("_own")), F.when(F.col("lang_rows") >= LEAST, _of_language()), F.when(F.lit(total >= LEAST), F.lit(ALL))]
    cells = names.select("_own", F.array_compact(F.array(*large)).alias("cells"))
    # Sources, their languages and the whole, each with a row for every start.
    small = 3 * len(STARTS) * names.count() <= BROADCAST_ROWS
    vectors = materialize(keyed.drop("_lang").join(F.broadcast(cells) if small else cells, "_own").drop("_own"), "quality-vectors")
    rows = vectors.select(F.explode("cells").alias("cell"), *(f"x{i}" for i in DIMS))
    fitted = materialize(_shrunk(names, fit_scatter(rows, small)).withColumnRenamed("cell", "_own"), "quality-fitted")
    # One row for each language and source; beyond the checked number the join is a shuffled one.
    fitted = F.broadcast(fitted) if fitted.count() <= BROADCAST_ROWS else fitted
    judged = stats.withColumn("_own", F.concat_ws("\1", lang, source)).withColumns({f"x{i}": x for i, x in enumerate(_vector())}).join(fitted, "_own", "left")
    inlier = F.coalesce(_distance() <= FAR, F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & inlier).withColumn("distance", _distance()).select(*(F.col("_row")[c].alias(c) for c in kept), *BASE, "base_failed", "kept", "distance")
