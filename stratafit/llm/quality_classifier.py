"""Quality classifier: Bradley-Terry pairwise ranking.

A document's score is linear in its features; the probability that one document is better than another is the logistic
function of their score difference. The weights minimise the logistic loss of the feature differences of preference
pairs (a labelled good document before a labelled bad one). The threshold is a quantile of the training scores: the share
of bad ones among the labels. All labelled documents teach: few are gathered, and pairs are drawn among them; of more, groups are
made by hash, of which all pairs count, and an iteration sums over the groups on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.selection import exact_quantile
from .common import bounded_batches, distinct, free, kept, line_counts, materialise, text_udf, window_hashes, words_of

#: So many labelled documents are gathered at most; of more, only sums reach the driver.
GATHERED = 6000
#: Preference pairs drawn from gathered documents.
PAIRS = 60_000
#: Documents of a group, and those of each kind in it, at least as a mean: documents of a rarer kind stand in several groups.
GROUP, LEAST = 200, 10
#: What the threshold scores after scaling.
CUT = 0.3

_FEATURES = 14
#: Kinds of bytes whose shares are features.
_KINDS = [bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&", b"|<>", b"!?", b".,;:"]


def features(texts: pa.Array) -> np.ndarray:
    """A row for each text: shares of kinds of bytes, lines and words; logarithms of sizes. Texts without words are all zeros but
    the first."""
    w = words_of(texts)
    n = w.counts.astype(float)
    bytes_of = w.histograms()
    among = lambda chosen: bytes_of[:, list(chosen)].sum(1)
    chars = np.maximum(among([*range(33, 128), *range(192, 256)]), 1)  # each other byte continues a character
    lines, different = line_counts(texts)
    by_words = np.zeros((len(texts), 3))
    for i, h in enumerate(w.by_text()):
        if len(h):
            t = window_hashes(h, 3)
            by_words[i] = len(distinct(h)) / len(h), np.mean(h[1:] == h[:-1]) if len(h) > 1 else 0, 1 - len(distinct(t)) / len(t) if len(t) else 0
    some = np.maximum(n, 1)
    columns = [np.log1p(n) / 10, np.log(chars / some) / 3, by_words[:, 0], by_words[:, 1], np.sqrt(by_words[:, 2])]
    columns += [np.sqrt(among(k) / chars) for k in _KINDS]
    columns += [1 - different / np.maximum(lines, 1), np.log1p(lines) / 10]
    out = np.column_stack([n == 0, *columns])
    out[n == 0, 1:] = 0
    return out


def _vectors(texts: pa.Array) -> pa.Array:
    x = features(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, _FEATURES) if len(x) else [0], pa.int32()), pa.array(x.ravel()))


feature_vector = text_udf(T.ArrayType(T.DoubleType()), _vectors)


@dataclass(frozen=True)
class Ranker:
    weights: tuple[float, ...]
    #: Linear scores at or above it are accepted.
    threshold: float

    def linear(self, x: Column) -> Column:
        return sum((x[i] * w for i, w in enumerate(self.weights)), F.lit(0.0))

    def score(self, x: Column) -> Column:
        """0 to 1; CUT at the threshold."""
        return 1 / (1 + F.exp(F.lit(self.threshold + math.log(1 / CUT - 1)) - self.linear(x)))


def bradley_terry(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, steps: int = 30, seed: int = 7) -> np.ndarray:
    """Weights by Newton steps on the mean logistic loss of differences (good minus bad) plus a ridge penalty."""
    rng = np.random.default_rng(seed)
    better, worse = x[good], x[~good]
    w = np.zeros(x.shape[1])
    if not len(better) or not len(worse):
        return w
    d = better[rng.integers(len(better), size=pairs)] - worse[rng.integers(len(worse), size=pairs)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(d @ w))
        gradient = d.T @ p / pairs - penalty * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _grouped(rows: DataFrame, id_col: str, good: int, bad: int) -> DataFrame:
    """(g, good, bad): groups of about GROUP documents by hash, with the vectors of their good and bad ones, each behind the number of
    its copies, as arrays end to end."""
    groups = -(-(good + bad) // GROUP)
    each = rows.groupBy(id_col, "__label", "__hash").agg(F.first("x").alias("x"), F.count("*").cast("double").alias("n"))
    times = lambda n: max(1, min(groups, -(-LEAST * groups // n)))
    is_good = F.col("__label") == 1
    each = each.withColumn("__k", F.explode(F.sequence(F.lit(1), F.when(is_good, times(good)).otherwise(times(bad)))))
    # Copies of a document go to groups one after another, so that none has it twice.
    g = F.pmod(F.xxhash64(id_col, "__label", "__hash") + F.col("__k"), F.lit(groups))
    vector = F.concat(F.array("n"), "x")
    joined = lambda kind: F.flatten(F.collect_list(F.when(kind, vector)))  # noqa: E731  a group's few
    return each.groupBy(g.alias("g")).agg(joined(is_good).alias("good"), joined(~is_good).alias("bad"))


def _pair_sums(groups: DataFrame, w: np.ndarray) -> np.ndarray:
    """Over all pairs of all groups: their number, the gradient of the logistic loss at w with its sign changed, and its hessian."""
    f = len(w)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, gradient, hessian = 0.0, np.zeros(f), np.zeros((f, f))
        for batch in batches:
            for a, b in zip(batch.column("good"), batch.column("bad"), strict=True):
                better, worse = (v.values.to_numpy().reshape(-1, f + 1) for v in (a, b))
                (m, x), (n, y) = (better[:, 0], better[:, 1:]), (worse[:, 0], worse[:, 1:])
                p = 1 / (1 + np.exp((x @ w)[:, None] - y @ w))
                copies = np.outer(m, n)
                pairs += copies.sum()
                first, second = copies * p, copies * p * (1 - p)
                gradient += first.sum(1) @ x - first.sum(0) @ y
                across = x.T @ second @ y
                hessian += (x.T * second.sum(1)) @ x + (y.T * second.sum(0)) @ y - across - across.T
        sums = np.concatenate([[pairs], gradient, hessian.ravel()])
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(sums)), pa.int32()), "v": sums})

    got = groups.select("good", "bad").mapInArrow(work, T.StructType().add("k", T.IntegerType()).add("v", T.DoubleType()))
    return np.array([r["v"] for r in got.groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()])


def bradley_terry_of(groups: DataFrame, features: int = _FEATURES, penalty: float = 1e-3, steps: int = 30) -> np.ndarray:
    """As bradley_terry over all pairs of each group; see ``_grouped``. A step is one job, of which only sums reach the driver."""
    w = np.zeros(features)
    for _ in range(steps):
        sums = _pair_sums(groups, w)
        if not sums[0]:
            break
        gradient = sums[1 : features + 1] / sums[0] - penalty * w
        hessian = sums[features + 1 :].reshape(features, features) / sums[0] + penalty * np.eye(features)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", gathered: int = GATHERED) -> Ranker:
    """Learn from all labelled documents. Up to ``gathered`` of them come to the driver, as features only; of more, sums.

    Null labels, ids without a document and labels of one kind only are no preference: without a pair every score is CUT.
    An id that is labelled or stands in docs more than once counts as often.
    """
    bounded_batches(docs.sparkSession)
    chosen = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("__label")).filter(F.col("__label").isNotNull() & F.col(id_col).isNotNull())
    text = F.col(text_col).cast("string")
    # Features first: a join that shuffles moves them, not texts.
    rows = docs.filter(F.col(id_col).isNotNull()).select(id_col, feature_vector(text).alias("x"), F.xxhash64(text).alias("__hash")).join(chosen, id_col)
    with kept():
        rows = materialise(rows, "labelled")
        counts = rows.agg(F.count("*"), F.coalesce(F.count_if(F.col("__label") == 1), F.lit(0))).first()
        if counts[0] > gathered:
            return _fit_large(rows, id_col, counts[1], counts[0] - counts[1])
        # In an order that the rows themselves give: pairs are drawn by places.
        got = rows.orderBy(id_col, "__label", "__hash").toPandas()
    if got.empty:
        return Ranker((0.0,) * _FEATURES, 0.0)
    x, good = np.array(got["x"].tolist()), got["__label"].to_numpy() == 1
    w = bradley_terry(x, good)
    linear = x @ w
    if good.all() or not good.any():
        return Ranker(tuple(w), float(linear.min()))
    ordered, bad = np.sort(linear), int((~good).sum())
    return Ranker(tuple(w), float((ordered[bad - 1] + ordered[bad]) / 2))


def _fit_large(rows: DataFrame, id_col: str, good: int, bad: int) -> Ranker:
    if not good or not bad:
        return Ranker((0.0,) * _FEATURES, 0.0)
    w = tuple(float(v) for v in bradley_terry_of(materialise(_grouped(rows, id_col, good, bad), "groups")))
    scores = rows.select(Ranker(w, 0.0).linear(F.col("x")).alias("score"))
    # Between the scores at the places bad - 1 and bad.
    return Ranker(w, float(exact_quantile(scores, "score", (bad - 0.5) / (good + bad - 1)).first()["value"]))


def scored(docs: DataFrame, ranker: Ranker, text_col: str = "text", mark: str = "__quality") -> DataFrame:
    """docs, all rows and columns, with a double ``mark``: the score, from the text alone, so repeated rows score alike.

    Null, empty and blank texts score alike; a very long one is scored whole. An empty table gives an empty result. A column of
    docs named like the mark raises an error.
    """
    bounded_batches(docs.sparkSession)
    x = free(docs, f"{mark}_x")
    return docs.withColumn(x, feature_vector(F.col(text_col).cast("string"))).withColumn(free(docs, mark), ranker.score(F.col(x))).drop(x)


def accepted(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of docs at or above the threshold (ties stay), with their columns, repeated rows each; see ``scored``."""
    return scored(docs, ranker, text_col).filter(F.col("__quality") >= CUT).select(*docs.columns)
