"""Exact conditional logistic regression.

The denominator of a stratum is the sum, over all subsets of as many rows as it has cases, of the products of their exp(xb): the
coefficient of z ** cases in the product of 1 + exp(xb) * z over its rows. It is taken by Cauchy's integral over a circle through
the saddle point. There the rows' factors are those of independent draws with probabilities p = 1 / (1 + exp(-(xb + shift))) that
add up to the number of cases, and the coefficient follows from the probability that so many are drawn. The trapezoidal rule
gives it to rounding from a number of points that doesn't grow with the stratum (36 or so of 100,000 rows): points beyond some 9
standard deviations alias nothing, and points at which all factors together vanish add nothing. At a point the integrand and its
derivatives are sums over rows:

    log f = sum log(1 + p (u - 1)),   first: sum x q,   second: sum x x' q (1 - q),   q = p u / (1 + p (u - 1)),   u on the circle

so that parts of a stratum are summed anywhere and added up, in memory that depends neither on rows nor on cases. Strata of up to
LARGE rows stand whole in a task, many in a batch; for larger ones the shift is found from a histogram of xb, and each task's sums are added in an
aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.data import dealt
from ..sources.paths import ship

#: Rows of a stratum that one task takes whole.
LARGE = 20_000
#: Rows that are worked on at once.
_CHUNK = 20_000
#: Bins of xb for each unit, for the shifts of large strata. They decide how well the sums are conditioned, not what they are.
_BINS = 64


def points(n: np.ndarray, variance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all, used): points on the circle for strata of n rows whose draws have the variance, and how many of the upper half are used."""
    deviation = np.sqrt(np.maximum(variance, 1e-300))
    every = np.minimum(n + 1, np.ceil(9 * deviation + 30)).astype(np.int64)
    upto = np.arcsin(np.minimum(1.0, np.sqrt(21.0) / deviation)) / np.pi  # 2 variance sin(pi k / every) ** 2 <= 42
    return every, np.minimum(every // 2, np.floor(every * upto).astype(np.int64)) + 1


def shifts(xb: np.ndarray, count: np.ndarray, starts: np.ndarray, cases: np.ndarray) -> np.ndarray:
    """For groups of values, each standing for ``count`` rows, the shift at which probabilities add up to the cases, between none and all."""
    per = np.diff(np.append(starts, len(xb)))
    n = np.add.reduceat(count, starts)
    middle = np.log(cases / (n - cases))
    low, high = middle - np.maximum.reduceat(xb, starts), middle - np.minimum.reduceat(xb, starts)
    at = (low + high) / 2
    for _ in range(200):
        p = _sigmoid(xb + np.repeat(at, per))
        off = np.add.reduceat(count * p, starts) - cases
        low, high = np.where(off < 0, at, low), np.where(off < 0, high, at)
        slope = np.add.reduceat(count * p * (1 - p), starts)
        step = at - np.divide(off, slope, out=np.zeros_like(off), where=slope > 0)
        new = np.where((step > low) & (step < high) & (slope > 0), step, (low + high) / 2)
        if (np.abs(new - at) <= 1e-13 * (1 + np.abs(at))).all():
            break
        at = new
    return at


def _sigmoid(v: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(v))
    return np.where(v >= 0, 1.0, e) / (1 + e)


def _packed(p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(p)


def point_sums(p: np.ndarray, x: np.ndarray, theta: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """By group: sum log f - i theta p, sum x q, and sum x x' q (1 - q) (upper triangle), complex, a row each. theta: each row's angle."""
    u = np.exp(1j * theta)
    f = 1 + p * (u - 1)
    q = p * u / f
    v = q * (1 - q)
    parts = [np.add.reduceat(np.log(f) - 1j * theta * p, starts)[:, None], np.add.reduceat(x * q[:, None], starts)]
    parts += [np.add.reduceat(x[:, a:] * (x[:, a] * v)[:, None], starts) for a in range(x.shape[1])]
    return np.concatenate(parts, axis=1)


class Integral:
    """Adds up the points of groups: ln of the coefficient's probability, and its first two derivatives."""

    def __init__(self, groups: int, p: int, every: np.ndarray, excess: np.ndarray):
        """excess: the sum of probabilities less the cases."""
        self.p, self.every, self.excess = p, every, excess
        self.d, self.first, self.second = np.zeros(groups), np.zeros((groups, p)), np.zeros((groups, len(_packed(p)[0])))

    def add(self, k: int, of: np.ndarray, sums: np.ndarray) -> None:
        """The point k of the groups ``of``, by their point_sums."""
        theta = 2 * np.pi * k / self.every[of]
        twice = np.where((k == 0) | (2 * k == self.every[of]), 1.0, 2.0) / self.every[of]  # the lower half is the conjugate of the upper
        w = twice * np.exp(sums[:, 0] + 1j * theta * self.excess[of])
        g, h = sums[:, 1 : 1 + self.p], sums[:, 1 + self.p :]
        a, b = _packed(self.p)
        self.d[of] += w.real
        self.first[of] += (w[:, None] * g).real
        self.second[of] += (w[:, None] * (g[:, a] * g[:, b] + h)).real

    def moments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = _packed(self.p)
        mean = self.first / self.d[:, None]
        return np.log(self.d), mean, self.second / self.d[:, None] - mean[:, a] * mean[:, b]


def whole_strata(xb: np.ndarray, y: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and information (upper triangle) of each group of rows with some cases and some others."""
    per = np.diff(np.append(starts, len(xb)))
    cases = np.add.reduceat(y, starts)
    shift = shifts(xb, np.ones(len(xb)), starts, cases)
    at = xb + np.repeat(shift, per)
    p = _sigmoid(at)
    mass = np.add.reduceat(p, starts)
    x = x - np.repeat(np.add.reduceat(x * p[:, None], starts) / mass[:, None], per, axis=0)  # centred: no cancellation between squares
    every, used = points(per, np.add.reduceat(p * (1 - p), starts))
    total = Integral(len(starts), x.shape[1], every, mass - cases)
    for k in range(int(used.max())):
        of = np.flatnonzero(used > k)
        rows = np.repeat(used > k, per)
        begin = np.cumsum(per[of]) - per[of]
        total.add(k, of, point_sums(p[rows], x[rows], 2 * np.pi * k / np.repeat(every[of], per[of]), begin))
    log_p, mean, information = total.moments()
    log_d = np.add.reduceat(np.logaddexp(0, at), starts) - cases * shift + log_p
    return np.add.reduceat(y * xb, starts) - log_d, np.add.reduceat(x * y[:, None], starts) - mean, information


def _dense(lists: pa.Array, ids: np.ndarray) -> np.ndarray:
    """Lists of (i, x) as a matrix with a column for each of the sorted ids."""
    out = np.zeros((len(lists), len(ids)))
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    out[row, np.searchsorted(ids, flat.field("i").to_numpy(zero_copy_only=False))] = flat.field("x").to_numpy(zero_copy_only=False)
    return out


def _labelled(task: int, ids: np.ndarray, level: float, g: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    """(task, i, j, value) of a task's sums."""
    a, b = _packed(len(ids))
    i = [None, *ids.tolist(), *ids[a].tolist()]
    j = [None] * (1 + len(ids)) + ids[b].tolist()
    return pa.RecordBatch.from_arrays([pa.array([task] * len(i), pa.int32()), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(np.concatenate([[level], g, h]))], ["task", "i", "j", "value"])


_OUT = "task int, i long, j long, value double"


def _of_small(rows: DataFrame, ids: np.ndarray, size: int) -> DataFrame:
    """Moments by task of the strata of rows, each whole in a partition and sorted there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}

        def done(table: pa.Table) -> None:
            task, stratum = (table.column(c).to_numpy() for c in ("task", "stratumId"))
            starts = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (stratum[1:] != stratum[:-1])]))
            x = _dense(table.column("xs").combine_chunks(), ids)
            ends = np.append(starts[1:], len(task))
            first = 0
            while first < len(starts):  # whole strata of _CHUNK rows together, or a larger one
                last = max(first + 1, int(np.searchsorted(ends, starts[first] + _CHUNK, side="right")))
                cut = slice(starts[first], ends[last - 1])
                parts = whole_strata(table.column("xb").to_numpy()[cut], table.column("y").to_numpy()[cut], x[cut], starts[first:last] - starts[first])
                for t in np.unique(task[starts[first:last]]):
                    mine = task[starts[first:last]] == t
                    new = [v[mine].sum(0) for v in parts]
                    sums[int(t)] = [a + b for a, b in zip(sums[int(t)], new, strict=True)] if int(t) in sums else new
                first = last

        left = None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            task, stratum = (table.column(c).to_numpy() for c in ("task", "stratumId"))
            end = int(np.flatnonzero((task != task[-1]) | (stratum != stratum[-1])).max(initial=-1)) + 1  # the last stratum may go on
            if end:
                done(table.slice(0, end))
            left = table.slice(end)
        if left is not None and left.num_rows:
            done(left)
        for t, (level, g, h) in sums.items():
            yield _labelled(t, ids, float(level), g, h)

    keys = ["task", "stratumId"]
    return dealt(rows.select(*keys, "xb", "y", "xs").repartition(*keys), size, "stratumId").sortWithinPartitions(*keys).mapInArrow(work, _OUT)


def _of_large(rows: DataFrame, ids: np.ndarray) -> DataFrame:
    """Moments by task of strata that no task takes whole."""
    keys, p = ["task", "stratumId"], len(ids)
    ends = (1 + p + len(_packed(p)[0])) * 2  # numbers for a point

    def find(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        value, count, cases = (b[c].to_numpy(float) for c in ("value", "n", "cases"))
        shift = shifts(value, count, np.zeros(1, int), np.array([cases.sum()]))[0]
        draws = _sigmoid(value + shift)
        every, used = points(np.array([count.sum()]), np.array([(count * draws * (1 - draws)).sum() + 1]))
        return pd.DataFrame({"task": [key[0]], "stratumId": [key[1]], "cases": [cases.sum()], "shift": [shift], "every": every, "used": used})

    bins = F.floor(F.col("xb") * _BINS)
    mean = F.log(F.avg(F.exp(F.col("xb") - F.col("bin") / _BINS))) + F.col("bin") / _BINS
    binned = rows.withColumn("bin", bins).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sum("y").alias("cases"), mean.alias("value"))
    found = binned.groupBy(*keys).applyInPandas(find, "task int, stratumId long, cases double, shift double, every long, used long")
    # Where the columns are centred, for the same reason as in whole strata.
    at = F.col("xb") + F.col("shift")
    draw = 1 / (1 + F.exp(-at))
    dealt = rows.join(found, keys)  # few strata: adaptive execution broadcasts them
    middle = dealt.select(*keys, draw.alias("p"), F.explode("xs").alias("e")).groupBy(*keys, F.col("e.i").alias("i")).agg(F.sum(F.col("p") * F.col("e.x")).alias("x"))
    middle = middle.groupBy(*keys).agg(F.collect_list(F.struct("i", "x")).alias("middle"))  # as many as covariates
    dealt = dealt.join(middle, keys, "left").withColumn("middle", F.coalesce("middle", F.array().cast("array<struct<i:bigint,x:double>>")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[list, np.ndarray]] = {}
        for b in batches:
            table = pa.Table.from_batches([b]).sort_by([("task", "ascending"), ("stratumId", "ascending")])
            task, stratum, xb, y = (table.column(c).to_numpy() for c in ("task", "stratumId", "xb", "y"))
            x = _dense(table.column("xs").combine_chunks(), ids)
            starts = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (stratum[1:] != stratum[:-1])])) if len(task) else []
            for i, j in zip(starts, np.append(starts[1:], len(task)), strict=True):
                about = {c: table.column(c)[int(i)].as_py() for c in ("cases", "shift", "every", "used")}
                centre = _dense(table.column("middle").combine_chunks().slice(int(i), 1), ids)[0] / max(about["cases"], 1)
                value, mine, z = xb[i:j] + about["shift"], y[i:j], x[i:j] - centre
                draws, zero = _sigmoid(value), np.zeros(1, int)
                plain = [np.logaddexp(0, value).sum(), draws.sum(), mine @ xb[i:j], *(mine @ z)]
                of = [point_sums(draws, z, np.full(j - i, 2 * np.pi * k / about["every"]), zero)[0] for k in range(about["used"])]
                new = np.concatenate([plain, np.concatenate([np.concatenate([v.real, v.imag]) for v in of])])
                key = int(task[i]), int(stratum[i])
                sums[key] = (about, new if key not in sums else sums[key][1] + new)
        names = ["cases", "shift", "every", "used"]
        columns = [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int64()), *[pa.array([v[0][c] for v in sums.values()], pa.float64()) for c in names], pa.array([v[1] for v in sums.values()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["task", "stratumId", *names, "sums"])

    parts = dealt.select(*keys, "xb", "y", "xs", "cases", "shift", "every", "used", "middle").mapInArrow(work, "task int, stratumId long, cases double, shift double, every double, used double, sums array<double>")
    added = parts.select(*keys, "cases", "shift", "every", "used", F.posexplode("sums").alias("at", "v")).groupBy(*keys, "cases", "shift", "every", "used", "at").agg(F.sum("v").alias("v"))

    def finish(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        v = b.sort_values("at")["v"].to_numpy()
        cases, shift, every, used = (b[c].iloc[0] for c in ("cases", "shift", "every", "used"))
        softplus, mass, level, g, of = v[0], v[1], v[2], v[3 : 3 + p], v[3 + p :].reshape(int(used), ends)
        total = Integral(1, p, np.array([every]), np.array([mass - cases]))
        for k, row in enumerate(of):
            total.add(k, np.zeros(1, int), (row[: ends // 2] + 1j * row[ends // 2 :])[None, :])
        log_p, mean, information = total.moments()
        return _labelled(int(key[0]), ids, float(level - (softplus - cases * shift + log_p[0])), g - mean[0], information[0]).to_pandas()

    return added.groupBy(*keys).applyInPandas(finish, _OUT)


def exact_moments(rows: DataFrame, entries: DataFrame, covariates: Sequence[int], large: int = LARGE, size: int = 0) -> DataFrame:
    """(task, i, j, value): log-likelihood (i, j null), gradient (j null) and information (i <= j) with exact denominators.

    rows: task, stratumId, rowId, y (1: a case), w (rows without weight go), xb; entries: rowId, xs, an array of (i, x). Strata without a case or
    without any other row say nothing. size: about how many rows there are, if it is known, see ``dealt``.
    """
    ship(rows.sparkSession)
    keys, ids = ["task", "stratumId"], np.array(sorted(covariates), np.int64)
    rows = dealt(rows.filter("w > 0").select(*keys, "rowId", (F.col("y") == 1).cast("double").alias("y"), "xb"), size, "stratumId")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("k")).filter("k > 0 and k < n").select(*keys, (F.col("n") > large).alias("large"))
    told = rows.join(sizes, keys).join(entries, "rowId", "left").withColumn("xs", F.coalesce("xs", F.array().cast("array<struct<i:bigint,x:double>>")))
    out = _of_small(told.filter("not large"), ids, size)
    if not sizes.filter("large").isEmpty():
        out = out.union(_of_large(told.filter("large"), ids))
    return out.groupBy("task", "i", "j").agg(F.sum("value").alias("value"))
