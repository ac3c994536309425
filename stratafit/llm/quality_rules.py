"""Quality rules: simple limits, then robust multivariate outliers.

Each text gets a vector of transformed statistics. For each language and source the minimum-covariance-determinant estimate
(the mean and covariance of the half of the rows with the least determinant) is computed: concentration steps, each over all
rows, take the distances under the current estimate, their median by a histogram, and the moments of the rows below it. They
begin at several robust starts side by side; after two steps each group goes on with the start of least determinant, until
the determinants settle. One more step takes the moments of all rows within a chi-square quantile. Every step is one partial
aggregation, whatever the size of a group. The same is done for each language as a whole. An estimate of few rows says little, so
means and covariances of a source are drawn to those of its language, and these to the mean of all languages, by weights of
rows; there is no size at which the treatment changes. Rows further away than a far chi-square quantile, by Mahalanobis distance,
are rejected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, free, kept, line_counts, materialise, text_udf, window_hashes, words_of

SYMBOLS = b"#*$%&|<>"
#: The transformed statistics, see ``transformed``.
FEATURES = ["length", "word_length", "symbols", "dup_lines", "repeats", "upper"]
#: An estimate from n rows has the weight n against this weight of the level above: ten rows for each statistic.
PRIOR_ROWS = 60
#: Starts of the concentration steps, steps before they are compared, and steps at most.
STARTS = ["medians", "all", "winsorised"]
FIRST_STEPS, MOST_STEPS = 2, 12
#: A step that lowers the logarithm of the determinant by less is the last one.
SETTLED = 0.01
#: Spread (standard deviation) that each transformed statistic has at least: where nearly all texts agree on a value (no symbols,
#: no repeated lines) the determinant would be zero, and the least deviation an outlier.
FLOOR = [0.5, 0.05, 0.02, 0.1, 0.1, 0.05]
#: Probability, under normal statistics, that a row lies beyond the cutoff. The statistics have heavy tails, so it is tiny.
TAIL = 1e-12
#: Estimates of so many groups are broadcast (under 1 kB each).
FEW_GROUPS = 10_000

_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
_D = range(len(FEATURES))


def chi_square_quantile(tail: float, degrees: int) -> float:
    """Where an even chi-square distribution has the probability ``tail`` above; the tail is a finite sum."""
    above = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) > tail else (low, middle)
    return low


#: Rejected beyond this squared Mahalanobis distance.
CUTOFF = chi_square_quantile(TAIL, len(FEATURES))
#: Rows within it make the last estimate.
INNER = chi_square_quantile(0.025, len(FEATURES))


def consistency(tail: float) -> float:
    """What makes the covariance of normal rows nearer than the chi-square quantile consistent."""
    x, k = chi_square_quantile(tail, len(FEATURES)), len(FEATURES) // 2 + 1
    return (1 - tail) / (1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k)))


def repeated_words(h: np.ndarray) -> int:
    """Words, by their hashes, inside 3-word windows that are found twice or more, their first places included."""
    if len(h) < 4:
        return 0
    windows = window_hashes(h, 3)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    found = np.zeros(len(windows), bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for i in range(3):
        covered[i : len(windows) + i] |= found
    return int(covered.sum())


def base_statistics(texts: pa.Array) -> list[np.ndarray]:
    """The columns of _BASE; a null text has none of anything."""
    w = words_of(texts)
    bytes_of = w.histograms()
    lines, different = line_counts(texts)
    letters = [x for x in range(256) if x not in b" \t\n\v\f\r" and not 0x80 <= x < 0xC0]  # first bytes of code points
    after = np.flatnonzero(w.data[:-1] == 0xC3) + 1  # the capitals from U+00C0 to U+00DE
    after = after[(w.data[after] >= 0x80) & (w.data[after] <= 0x9E) & (w.data[after] != 0x97)]
    capitals = bytes_of[:, 65:91].sum(1) + w.counted(after)
    repeats = np.array([repeated_words(h) for h in w.by_text()], np.int64)
    return [w.counts, bytes_of[:, letters].sum(1), bytes_of[:, list(SYMBOLS)].sum(1), lines - different, repeats, lines, capitals]


_statistics = text_udf(_BASE, lambda texts: pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in base_statistics(texts)], [x.split()[0] for x in _BASE.split(", ")]))


def transformed(s: Column) -> list[Column]:
    """FEATURES from the struct of base statistics: logarithms of sizes, square roots of shares."""
    words, chars, lines = (F.greatest(s[x], F.lit(1)).cast("double") for x in ("n_words", "word_chars", "n_lines"))
    return [F.log(words), F.log(chars / words), F.sqrt(s["n_symbols"] / chars), F.sqrt(s["n_dup_lines"] / lines), F.sqrt(s["n_repeat_words"] / words), F.sqrt(s["n_upper"] / chars)]


def _small(groups: DataFrame) -> DataFrame:
    """groups, for a join: broadcast if there are few."""
    return F.broadcast(groups) if groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else groups


def _estimate(scale: float):
    """Means, inverse covariances and logarithms of determinants from sums; covariances are scaled and floored."""

    def estimate(batches):
        for x in batches:
            out = []
            for n, s, ss in zip(x["n"], x["s"].map(np.array), x["ss"].map(np.array), strict=True):
                mean, cov = s / n, np.zeros((len(_D), len(_D)))
                cov[np.triu_indices(len(_D))] = ss / n
                cov = (cov + np.triu(cov, 1).T - np.outer(mean, mean)) * scale + np.diag(np.square(FLOOR))
                out.append((mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1]), cov.ravel().tolist()))
            yield pd.DataFrame({"g": x["g"], "start": x["start"], **{name: [o[i] for o in out] for i, name in enumerate(("mean", "inv", "logdet", "cov"))}})

    return estimate


def _moments(rows: DataFrame, scale: float, x: Column | None = None) -> DataFrame:
    """(g, start, mean, inv, logdet, cov), written, from rows (g, start, x)."""
    x = F.col("x") if x is None else x
    sums = rows.groupBy("g", "start").agg(F.count("*").cast("double").alias("n"), F.array(*[F.sum(x[i]) for i in _D]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i in _D for j in _D if j >= i]).alias("ss"))
    return materialise(sums.mapInPandas(_estimate(scale), "g array<string>, start int, mean array<double>, inv array<double>, logdet double, cov array<double>"), "estimates")


def _starts(rows: DataFrame) -> DataFrame:
    """Estimates by start: medians and median deviations without correlations; the moments of all rows; those of rows drawn in to
    two median deviations of the medians. Values are rounded for the exact medians, so that a group has a bounded number of
    different ones."""
    median = lambda x: F.percentile(F.round(x, 2), F.lit(0.5))
    middle = _small(materialise(rows.groupBy("g").agg(F.array(*[median(F.col("x")[i]) for i in _D]).alias("mean")), "medians"))
    spread = rows.join(middle, "g").groupBy("g", "mean").agg(F.array(*[median(F.abs(F.col("x")[i] - F.col("mean")[i])) for i in _D]).alias("mad"))
    spread = materialise(spread, "spreads")
    variance = [F.pow(1.4826 * F.col("mad")[i], 2) + FLOOR[i] ** 2 for i in _D]
    medians = spread.select("g", F.lit(0).alias("start"), "mean", F.array(*[1 / variance[i] if i == j else F.lit(0.0) for i in _D for j in _D]).alias("inv"), sum((F.log(v) for v in variance), F.lit(0.0)).alias("logdet"))
    whole = _moments(rows.withColumn("start", F.lit(1)), 1.0)
    low, high = (lambda i, sign=sign: F.col("mean")[i] + sign * 2 * 1.4826 * F.col("mad")[i] for sign in (-1, 1))
    drawn_in = F.array(*[F.greatest(low(i), F.least(high(i), F.col("x")[i])) for i in _D])
    winsorised = _moments(rows.join(_small(spread), "g").select("g", F.lit(2).alias("start"), drawn_in.alias("x")), 1.0)
    return medians.unionByName(whole.drop("cov")).unionByName(winsorised.drop("cov"))


def squared_distance(x: Column, mean: Column, inv: Column) -> Column:
    d = len(FEATURES)
    y = [x[i] - mean[i] for i in _D]
    return sum((y[i] * y[j] * inv[i * d + j] * (1 if i == j else 2) for i in _D for j in range(i, d)), F.lit(0.0))


#: Distances are told apart to this factor (of squared distances) in the histogram.
_BIN = 0.02


def _concentrated(rows: DataFrame, estimates: DataFrame, share: float, scale: float = 1.0) -> DataFrame:
    """The estimates from the share of rows nearest by the given ones, for each group and start."""
    keys = ["g", "start"]
    far = rows.join(_small(estimates.drop("logdet", "cov")), "g").withColumn("d2", squared_distance(F.col("x"), F.col("mean"), F.col("inv")))
    far = far.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-3) / _BIN).cast("int")).select(*keys, "x", "bin")
    counts = far.groupBy(*keys, "bin").count().groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "count"))).alias("bins"), F.sum("count").alias("total"))  # a few thousand bins at most
    state = F.aggregate("bins", F.struct(F.lit(0.0).alias("n"), F.lit(-(1 << 30)).alias("edge")), lambda a, b: F.struct((a["n"] + b["count"]).alias("n"), F.when(a["n"] < share * F.col("total"), b["bin"]).otherwise(a["edge"]).alias("edge")))
    edges = materialise(counts.select(*keys, state["edge"].alias("edge")), "edges")
    return _moments(far.join(_small(edges), keys).filter("bin <= edge"), scale)


def mcd_estimates(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """(g, start, mean, inv, logdet, cov), written, from (g array<string>, x array<double>): a row for each g, with the start that won."""
    now = _starts(rows)
    for _ in range(FIRST_STEPS):
        now = _concentrated(rows, now, share)
    best = now.groupBy(F.col("g").alias("b")).agg(F.min(F.struct("logdet", "start")).alias("best"))
    now = materialise(now.join(best, (F.col("g") == F.col("b")) & (F.col("start") == F.col("best.start"))).select("g", "start", "mean", "inv", "logdet"), "estimates")
    for _ in range(MOST_STEPS - FIRST_STEPS):
        new = _concentrated(rows, now, share)
        settled = now.select("g", F.col("logdet").alias("before")).join(new, "g").filter(F.col("before") - F.col("logdet") > SETTLED).isEmpty()
        dropped(now)
        now = new
        if settled:
            break
    now = now.withColumn("inv", F.transform("inv", lambda v: v / consistency(1 - share)))
    inside = rows.join(_small(now.drop("cov")), "g").filter(squared_distance(F.col("x"), F.col("mean"), F.col("inv")) <= INNER)
    return _moments(inside.select("g", "start", "x"), consistency(0.025))


def _inverted(batches):
    for x in batches:
        yield x.assign(inv=[np.linalg.inv(np.array(v).reshape(len(_D), -1)).ravel().tolist() for v in x["cov"]]).drop(columns="cov")


def shrunk(estimates: DataFrame, rows: DataFrame, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """(g, mean, inv) of the sources in estimates (g, mean, cov), which have them for languages too; g is (lang, source) or (lang). rows
    (g): what the estimates stand on."""
    sizes = rows.groupBy(F.col("g").alias("of")).agg(F.count("*").cast("double").alias("n"))
    known = materialise(estimates.join(sizes, F.col("g") == F.col("of")).select("g", "n", F.concat("mean", "cov").alias("v")), "known")
    width = len(_D) * (len(_D) + 1)
    langs = known.filter(F.size("g") == 1).select(F.col("g")[0].alias("lang"), F.col("n").alias("ln"), F.col("v").alias("lv"))
    whole = langs.agg(F.array(*[F.sum(F.col("ln") * F.col("lv")[i]) / F.sum("ln") for i in range(width)]).alias("wv"))  # one row
    drawn = lambda v, n, to: F.zip_with(v, to, lambda a, b: (n * a + prior_rows * b) / (n + prior_rows))
    langs = langs.join(F.broadcast(whole), F.lit(True)).select("lang", drawn("lv", F.col("ln"), "wv").alias("lv"))
    own = known.filter(F.size("g") == 2).join(langs, F.col("g")[0] == F.col("lang")).select("g", drawn("v", F.col("n"), "lv").alias("v"))
    own = own.select("g", F.slice("v", 1, len(_D)).alias("mean"), F.slice("v", len(_D) + 1, width).alias("cov"))
    return own.mapInPandas(_inverted, "g array<string>, mean array<double>, inv array<double>")


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", mark: str = "__rules") -> DataFrame:
    """docs, all rows and columns, with a struct ``mark``: the base statistics, base_failed, distance2 and kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: not base_failed, and within
    CUTOFF of the estimate of the row's language and source, see ``shrunk``; ties with the cutoff stay. Estimates use the rows that aren't
    base_failed. Null and empty texts have no words, so they are base_failed; very long ones are read whole. Null languages and
    sources form groups of their own. Repeated rows count as often as they stand. An empty table gives an empty result. A column
    of docs named like the mark raises an error.
    """
    bounded_batches(docs.sparkSession)
    group, estimate = free(docs, f"{mark}_group"), free(docs, f"{mark}_estimate")
    stats = docs.withColumn(free(docs, mark), _statistics(F.col(text_col).cast("string")))
    s = F.col(mark)
    failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    x = F.array(*transformed(s))
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (lang_col, source_col))
    with kept("verdicts"):
        vectors = materialise(stats.select(lang.alias("lang"), source.alias("source"), failed.alias("failed"), x.alias("x")).filter("not failed").drop("failed"), "vectors")
        rows = materialise(vectors.select(F.explode(F.array(F.array("lang", "source"), F.array("lang"))).alias("g"), "x"), "rows")
        dropped(vectors)
        best = shrunk(mcd_estimates(rows), rows)
        best = materialise(best.select(F.struct(F.col("g")[0].alias("lang"), F.col("g")[1].alias("source")).alias(group), F.struct("mean", "inv").alias(estimate)), "verdicts")
    joined = stats.withColumn(group, F.struct(lang.alias("lang"), source.alias("source"))).join(_small(best), group, "left")
    d2 = squared_distance(x, F.col(estimate)["mean"], F.col(estimate)["inv"])
    fields = [s[f.split()[0]].alias(f.split()[0]) for f in _BASE.split(", ")]
    out = F.struct(*fields, failed.alias("base_failed"), d2.alias("distance2"), (~failed & F.coalesce(d2 <= CUTOFF, F.lit(True))).alias("kept"))
    return joined.withColumn(mark, out).select(*docs.columns, mark)


def kept_rows(docs: DataFrame, **names: str) -> DataFrame:
    """The rows of docs that the rules keep, with their columns; see ``judged`` for odd rows and empty tables."""
    return judged(docs, **names).filter("__rules.kept").select(*docs.columns)
