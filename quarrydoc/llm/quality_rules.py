"""Quality rules: robust multivariate outliers, natively.

Each document becomes a vector of transformed text statistics. Per (lang, source)
the minimum-covariance-determinant (MCD) estimate is found by concentration steps
(C-steps) from three robust starts: keep the `support` share nearest by Mahalanobis
distance, re-estimate mean and covariance, repeat until no determinant falls, and take the start that ends
with the smallest. Every step is a grouped
aggregation with map-side combine; a p x p Cholesky factor is written as column
expressions, so nothing leaves the JVM. Documents whose distance exceeds the cutoff
are rejected.

Defined results: null text counts as empty; documents that fail the base rule take no
part in the estimates; a null lang or source is a group of its own; every group has its own
estimate, drawn towards its language's and that one towards the estimate over all documents as rows
are few (`_shrunk`; no switch by size); a flat dimension
gets the variance floor; ties and repeated rows change nothing; an empty table gives
an empty result; extra columns are carried by `filter_documents`, which joins nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, discard, hash_windows, table, words

SYMBOLS = "[#*$%&|<>]"
DIMS = ("z_wordlen", "z_symbols", "z_repeat")
VAR_FLOOR = 1e-2
#: Makes the scatter of the nearest 75 % of three normal dimensions consistent: 0.75 / P(chi2_5 <= q), q the 0.75 quantile of chi2_3.
CONSISTENCY = 1.61
BROADCAST_GROUPS = 50_000
#: Of approximate percentiles: ranks are right to a share of 1 / ACCURACY of the rows.
ACCURACY = 10_000


def text_statistics(t: Column, tokens: Column) -> dict[str, Column]:
    """The base statistics of a text without nulls and its words."""
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(F.array_join(tokens, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
    }


def repeat_words(windows: Column, width: int) -> Column:
    """Words covered by windows whose hash occurs twice or more; linear-logarithmic in the text's length.

    aggregate(array(x), ...) binds x to a variable, so that it is computed once and not per element.
    """
    zero, no = F.lit(0).cast("long"), F.lit(False)
    total = lambda xs: F.aggregate(xs, zero, lambda s, x: s + x)

    def spans(at: Column) -> Column:
        return F.transform(at, lambda a, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - a, F.lit(width))))

    def covered(pairs: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(pairs, i)["h"] == x["h"], no)
        hit = F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1))
        at = F.sort_array(F.transform(hit, lambda x: x["i"]))
        return F.aggregate(F.array(at), zero, lambda s, bound: s + total(spans(bound)))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    full = F.aggregate(F.array(pairs), zero, lambda s, bound: s + covered(bound))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), zero).otherwise(full)


def statistics(docs: DataFrame, keep: list[str], window: int = 5) -> DataFrame:
    """keep + n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed."""
    d = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t")).withColumn("_words", words(F.col("_t")))
    d = d.select(*keep, *[c.alias(n) for n, c in text_statistics(F.col("_t"), F.col("_words")).items()], F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"))
    d = d.withColumn("_win", hash_windows(F.col("_h"), window))
    d = d.withColumn("n_repeat_words", repeat_words(F.col("_win"), window)).drop("_h", "_win")
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def transformed(stats: DataFrame) -> DataFrame:
    """The vector: log mean word length, and the square roots of the shares of symbols and repeated words."""
    w = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (
        stats.withColumn("z_wordlen", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / w))
        .withColumn("z_symbols", F.sqrt(F.col("n_symbols") / w))
        .withColumn("z_repeat", F.sqrt(F.col("n_repeat_words") / w))
    )


def _factor(params: DataFrame, p: int) -> DataFrame:
    """Columns c{i}{j} (lower covariance) become the Cholesky factor l{i}{j}."""
    for j in range(p):
        left = reduce(lambda a, b: a + b, [F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
        params = params.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - left, F.lit(VAR_FLOOR * 0.01))))
        for i in range(j + 1, p):
            cross = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
            params = params.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - cross) / F.col(f"l{j}{j}"))
    return params


def _distance(p: int, param=F.col) -> Column:
    """Squared Mahalanobis distance by forward substitution, as one expression over m*, l* and the dimensions."""
    ys: list[Column] = []
    for i in range(p):
        part = F.col(DIMS[i]) - param(f"m{i}")
        for k in range(i):
            part = part - param(f"l{i}{k}") * ys[k]
        ys.append(part / param(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [y * y for y in ys])


def _moments(rows: DataFrame, by: list[str], scale: float) -> DataFrame:
    p = len(DIMS)
    cols = [F.count(F.lit(1)).alias("n"), *[F.avg(DIMS[i]).alias(f"m{i}") for i in range(p)]]
    cols += [(F.covar_pop(DIMS[i], DIMS[j]) * scale + (VAR_FLOOR if i == j else 0.0)).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    return _factor(rows.groupBy(*by).agg(*cols), p)


def _hinted(params: DataFrame) -> DataFrame:
    """params to be broadcast where they are few rows (about 150 bytes each); beyond that both sides are dealt by key."""
    return F.broadcast(params) if params.count() <= BROADCAST_GROUPS else params


def _starts(vectors: DataFrame, by: list[str], med: DataFrame, small, written) -> DataFrame:
    """Three estimates per group to start from (by, __start, m*, c*): median and MAD; signs; the half nearest to the median.

    Signs: the covariance of the vectors scaled by MAD and cut to length one, which no outlier sways. Half: mean and
    covariance of the rows up to the median scaled length.
    """
    p = len(DIMS)
    dev = vectors.join(small(med), by).groupBy(*by).agg(*[F.percentile_approx(F.abs(F.col(DIMS[i]) - F.col(f"m{i}")), 0.5, ACCURACY).alias(f"s{i}") for i in range(p)])
    scale = [F.sqrt(F.pow(F.col(f"s{i}") * 1.4826, 2) + VAR_FLOOR).alias(f"s{i}") for i in range(p)]
    spread = written(med.join(dev, by).select(*by, *[f"m{i}" for i in range(p)], *scale), "mcd-spread")
    z = vectors.join(small(spread), by).withColumns({f"z{i}": (F.col(DIMS[i]) - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(p)})
    z = z.withColumn("len", F.sqrt(reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)])))
    mid = written(z.groupBy(*by).agg(F.percentile_approx("len", 0.5, ACCURACY).alias("mid")), "mcd-mid")
    unit = lambda i: F.when(F.col("len") > 0, F.col(f"z{i}") / F.col("len")).otherwise(0.0)
    near = F.col("len") <= F.col("mid")
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    got = z.join(small(mid), by).groupBy(*by).agg(
        *[F.avg(F.when(near, F.col(DIMS[i]))).alias(f"a{i}") for i in range(p)],
        *[F.avg(unit(i) * unit(j)).alias(f"u{i}{j}") for i, j in pairs],
        *[F.covar_pop(F.when(near, F.col(DIMS[i])), F.when(near, F.col(DIMS[j]))).alias(f"h{i}{j}") for i, j in pairs],
    )
    got = spread.join(got, by)
    floor = lambda i, j: VAR_FLOOR if i == j else 0.0
    mad = [F.col(f"m{i}").alias(f"m{i}") for i in range(p)] + [(F.pow(F.col(f"s{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in pairs]
    sign = [F.col(f"m{i}").alias(f"m{i}") for i in range(p)] + [(F.col(f"u{i}{j}") * p * F.col(f"s{i}") * F.col(f"s{j}") + floor(i, j)).alias(f"c{i}{j}") for i, j in pairs]
    half = [F.col(f"a{i}").alias(f"m{i}") for i in range(p)] + [(F.coalesce(F.col(f"h{i}{j}"), F.lit(0.0)) + floor(i, j)).alias(f"c{i}{j}") for i, j in pairs]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("__start"), *cols) for k, cols in enumerate((mad, sign, half))]))
    started = written(_factor(got.select(*by, rows.alias("e")).select(*by, "e.*"), p), "mcd-start")
    discard(spread, mid)
    return started


def mcd(vectors: DataFrame, by: list[str], support: float, steps: int) -> DataFrame:
    """MCD location and scatter per group `by`: C-steps from several starts until no determinant falls, `steps` at most; the smallest determinant wins.

    The starts of all groups take each step together, and every step is a small written table.
    """
    p = len(DIMS)
    med = table(vectors.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(DIMS[i], 0.5, ACCURACY).alias(f"m{i}") for i in range(p)]), "mcd-median")
    # few groups, of about 150 bytes each and start, are broadcast and written as a few files; beyond that both sides are dealt by key
    few = med.count() <= BROADCAST_GROUPS
    small = F.broadcast if few else (lambda d: d)
    written = lambda d, name: table(d.coalesce(4) if few else d, name)
    params = _starts(vectors, by, med, small, written)
    each = [*by, "__start"]
    rows = vectors.withColumn("__start", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    for _ in range(steps):
        d = rows.join(small(params), each).withColumn("_d", _distance(p)).select(*each, *DIMS, "_d")
        cut = written(d.groupBy(*each).agg(F.percentile_approx("_d", support, ACCURACY).alias("_q")), "mcd-cut")
        kept = d.join(small(cut), each).where(F.col("_d") <= F.col("_q"))
        after = written(_moments(kept, each, CONSISTENCY), "mcd-step")
        fall = after.select(*each, _log_det(p).alias("new")).join(params.select(*each, _log_det(p).alias("old")), each)
        falls = fall.where(F.abs(F.col("old") - F.col("new")) > 1e-4).limit(1).count()
        discard(params, cut)
        params = after
        if not falls:
            break
    values = [f"m{i}" for i in range(p)] + [f"c{i}{j}" for i in range(p) for j in range(i + 1)]
    best = params.groupBy(*by).agg(F.min_by(F.struct(*values), F.struct(_log_det(p).alias("d"), F.col("__start"))).alias("e"))
    # n: the group's rows, not those of the last support set
    out = table(_factor(best.select(*by, "e.*"), p).join(med.select(*by, "n"), by), "mcd")
    discard(params, med)
    return out


def _log_det(p: int) -> Column:
    return reduce(lambda a, b: a + b, [2 * F.log(F.col(f"l{i}{i}")) for i in range(p)])


def _shrunk(own: DataFrame, parent: DataFrame, up: list[str], min_group: int) -> DataFrame:
    """Estimates drawn towards those of the group above, joined on `up`: the normal-inverse-Wishart posterior.

    The parent counts as one row for the location and as `min_group` rows for the scatter; own rows count beyond
    the p + 1 without which a scatter has no full rank. The distance of the two locations widens the scatter.
    """
    p = len(DIMS)
    names = [f"m{i}" for i in range(p)] + [f"c{i}{j}" for i in range(p) for j in range(i + 1)]
    above = parent.select(*up, F.struct(*names).alias("__p"))
    d = own.drop(*[f"l{i}{j}" for i in range(p) for j in range(i + 1)])
    d = d.join(_hinted(above), up) if up else d.join(F.broadcast(above), how="left")  # one row
    rows = F.greatest(F.col("n") - (p + 1), F.lit(0)).cast("double")
    place, size = rows / (rows + 1), rows + max(min_group, 1)
    gap = [F.col(f"m{i}") - F.col("__p")[f"m{i}"] for i in range(p)]
    cols = {f"m{i}": F.col("__p")[f"m{i}"] + place * gap[i] for i in range(p)}
    for i in range(p):
        for j in range(i + 1):
            above_c = F.col("__p")[f"c{i}{j}"]
            cols[f"c{i}{j}"] = above_c + (F.col(f"c{i}{j}") - above_c) * rows / size + gap[i] * gap[j] * place / size
    return _factor(d.withColumns(cols).drop("__p"), p)


def _keyed(stats: DataFrame, keys: list[str]) -> DataFrame:
    return transformed(stats).withColumns({f"__k{i}": F.coalesce(F.col(k), F.lit(NULL_KEY)) for i, k in enumerate(keys)})


def fit(stats: DataFrame, keys: list[str], support: float, steps: int, min_group: int) -> DataFrame:
    """Estimates (__k*, __e struct) per group with rows that pass the base rule: over all rows, by the first key, by the first two, ...

    All levels are estimated together, each row once in each; then each is drawn towards the one above.
    """
    by, p = [f"__k{i}" for i in range(len(keys))], len(DIMS)
    names = [f"m{i}" for i in range(p)] + [f"l{i}{j}" for i in range(p) for j in range(i + 1)]
    good = _keyed(stats.where(~F.col("base_failed")), keys).select(*by, *DIMS)
    levels = good.withColumn("__level", F.explode(F.array(*[F.lit(i) for i in range(len(by) + 1)])))
    levels = levels.withColumns({k: F.when(F.col("__level") > i, F.col(k)).otherwise("") for i, k in enumerate(by)})
    levels = table(levels.select("__level", *by, *DIMS), "mcd-vectors")
    each = mcd(levels, ["__level", *by], support, steps)
    est = each.where("__level = 0").drop("__level", *by)
    for depth in range(1, len(by) + 1):
        own = each.where(F.col("__level") == depth).drop("__level", *by[depth:])
        est = table(_shrunk(own, est, by[: depth - 1], min_group), "mcd-shrunk")
    est = table(est.select(*by, F.struct(*names).alias("__e")), "mcd-estimates")
    discard(levels, each)
    return est


def verdicts(stats: DataFrame, estimates: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    """stats plus distance (squared; null for base failures) and kept. One output row per input row."""
    by, p = [f"__k{i}" for i in range(len(keys))], len(DIMS)
    d = _keyed(stats, keys)
    d = d.join(_hinted(estimates), by, "left") if by else d.join(F.broadcast(estimates), how="left")  # one row
    distance = _distance(p, lambda n: F.col("__e")[n])
    d = d.withColumn("distance", F.when(~F.col("base_failed"), distance)).drop(*by, "__e", *DIMS)
    kept = F.when(F.col("base_failed"), False).otherwise(F.col("distance") <= cutoff)
    return d.withColumn("kept", F.coalesce(kept, F.lit(True)))


KEYS = ("lang", "source")


def quality_rules(docs: DataFrame, keep: list[str] = ["doc_id", "lang", "source"], keys=KEYS, support: float = 0.75, steps: int = 10, cutoff: float = 27.0, min_group: int = 30) -> DataFrame:
    """Statistics and verdict per document: `keep` columns (with `keys`), base statistics, base_failed, distance, kept."""
    stats = table(statistics(docs, keep), "quality-stats")
    return verdicts(stats, fit(stats, list(keys), support, steps, min_group), list(keys), cutoff)


def filter_documents(docs: DataFrame, keys=KEYS, support: float = 0.75, steps: int = 10, cutoff: float = 27.0, min_group: int = 30) -> DataFrame:
    """The rows of docs that stay. Statistics are computed again where the rows are, so no text is shuffled and ids need not be unique."""
    keys = list(keys)
    stats = table(statistics(docs, keys), "quality-stats")
    estimates = fit(stats, keys, support, steps, min_group)
    discard(stats)
    # the documents' own columns travel in one struct, whatever their names
    rows = statistics(docs.withColumn("__row", F.struct(*docs.columns)), ["__row", *keys])
    return verdicts(rows, estimates, keys, cutoff).where("kept").select("__row.*")
