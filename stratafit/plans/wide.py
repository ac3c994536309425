"""Fits whose coefficients are a table, for any number of covariates: each iteration is one pass over rows and entries, steps are
taken on the executors, and the driver sees one row of sums."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import log_factorial
from ..operators.likelihood import entries, terms
from ..operators.survival import range_cuts
from ..sources.paths import delete, own_folders, ship, written
from .data import RegressionData
from .fit import Control, start_values
from .models import INTERCEPT_ID, Model
from .priors import Laplace, Normal, Prior, PriorSet, make_prior

#: Curvature under which a covariate stays where it is: no row at risk has it.
_FLAT = 1e-12
#: Entries and rows of a task, as a mean, where they are held by row; and where their sums are made as arrays.
_PART, _ARRAYS = 100_000, 1_000_000
#: Coefficients other than zero that are broadcast, at most; more of them are joined as Spark sees fit.
_FEW = 2_000_000


@dataclass(frozen=True)
class TableFit:
    """coefficients: covariateId, beta."""

    data: RegressionData
    prior: PriorSet
    coefficients: DataFrame
    log_likelihood: float
    log_prior: float
    iterations: int
    return_flag: str

    def frame(self) -> DataFrame:
        """(task 0, covariateId, beta), as scores and likelihoods take it."""
        return self.coefficients.select(F.lit(0).alias("task"), "covariateId", "beta")


def _penalties(prior: PriorSet, i: Column, variances: DataFrame | None, rows: DataFrame) -> DataFrame:
    """rows with the pulls of each covariate's prior: rate of the absolute and ridge of the squared distance from loc, and the log
    density at loc."""
    kinds = {type(p) for p in (prior.default, *prior.own.values())}
    if not kinds <= {Prior, Normal, Laplace} or prior.neighbours or prior.parents or prior.fit_hook is not None:
        raise ValueError("coefficients as a table take priors none, normal and laplace")
    free = Prior()

    def pulls(p: Prior, variance: Column | None = None, location: Column | None = None) -> Column:
        v = F.lit(getattr(p, "variance", 1.0)).cast("double") if variance is None else variance
        rate = F.sqrt(2 / v) if isinstance(p, Laplace) else F.lit(0.0)
        level = F.log(rate / 2) if isinstance(p, Laplace) else -0.5 * F.log(2 * math.pi * v) if isinstance(p, Normal) else F.lit(0.0)
        loc = F.lit(float(getattr(p, "location", 0.0))) if location is None else location
        return F.struct(rate.alias("rate"), (1 / v if isinstance(p, Normal) else F.lit(0.0)).alias("ridge"), loc.alias("loc"), level.alias("level"))

    own = pulls(prior.default)
    if variances is not None:
        location = F.coalesce("__l", F.lit(0.0)) if "location" in variances.columns else F.lit(0.0)
        told = variances.select(F.col("covariateId").alias("i"), F.col("variance").cast("double").alias("__v"), *[F.col("location").cast("double").alias("__l")] * ("location" in variances.columns))
        rows = rows.join(told, "i", "left")
        own = F.when(F.col("__v").isNotNull(), pulls(prior.default, F.col("__v"), location)).otherwise(own)
    without = {*prior.exclude, *([] if prior.force_intercept else [INTERCEPT_ID])} - set(prior.own)
    own = F.when(i.isin([int(c) for c in without]), pulls(free)).otherwise(own) if without else own
    for c, p in prior.own.items():
        own = F.when(i == int(c), pulls(p)).otherwise(own)
    return rows.withColumn("p", own).select(*[c for c in rows.columns if not c.startswith("__")], "p.*")


#: What gives the sums over rows at points, see ``_evaluated``.
_Sums = Callable[[DataFrame], DataFrame]


def _betas(points: DataFrame, total: int) -> tuple[DataFrame, bool]:
    """The coefficients (i, z) of points that aren't zero, and whether they are few enough to be broadcast. total: how many points there are."""
    betas = points.filter("i is not null and z <> 0").select("i", "z")
    few = total <= _FEW or betas.limit(_FEW + 1).count() <= _FEW
    return (F.broadcast(betas) if few else betas), few


def _weighted(data: RegressionData, weights: DataFrame | None) -> DataFrame:
    """The outcomes with the weight w of each."""
    if weights is not None:
        return data.outcomes.join(weights.select("rowId", F.col("w").cast("double").alias("w")), "rowId", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    return data.outcomes.withColumn("w", F.coalesce("weights", F.lit(1.0)) if "weights" in data.outcomes.columns else F.lit(1.0))


@contextmanager
def _by_row(data: RegressionData, weights: DataFrame | None, block: bool, control: Control) -> Iterator[tuple[RegressionData, DataFrame, Callable[[int], _Sums]]]:
    """The data with the weight w of each row, their covariates (i), and what gives their sums at points if told how many these are. block:
    the intercept counts for itself alone. Entries are held by row and sorted, so that an iteration joins them as they lie."""
    if data.model in (Model.LS, Model.LR, Model.PR):
        with _alone(data, weights, block) as held:
            yield held
        return
    parts = -(-(data.covariates.count() + data.outcomes.count() + 1) // _PART)
    held = lambda df: df.repartition(parts, "rowId").sortWithinPartitions("rowId").persist()
    outcomes = held(_weighted(data, weights))
    x, null = entries(replace(data, outcomes=outcomes)), F.lit(None)
    alone = (F.col("i") == INTERCEPT_ID) if block else F.lit(False)
    sizes = x.groupBy("rowId").agg(F.sum(F.when(alone, 0.0).otherwise(F.abs("x"))).alias("size"))
    bound = F.abs("x") * F.when(alone, F.abs("x")).otherwise(F.col("size"))
    rows = x.join(sizes, "rowId").select("rowId", "i", "x", bound.alias("bound"))
    # For each row one entry more, without a covariate, that carries its part of the log-likelihood.
    rows = held(rows.union(outcomes.select("rowId", null.cast("long"), null.cast("double"), null.cast("double"))))
    of = replace(data, outcomes=outcomes)
    ranges = range_cuts(outcomes, ["stratumId"], control.ranges) if data.model.survival else ()
    try:
        yield of, rows.select("i"), lambda total: lambda points: _grouped_sums(of, rows, *_betas(points, total), ranges)
    finally:
        rows.unpersist()
        outcomes.unpersist()


def _grouped_sums(data: RegressionData, x: DataFrame, betas: DataFrame, few: bool, ranges: tuple[float, ...]) -> DataFrame:
    sums = x.join(betas, "i").groupBy("rowId").agg(F.sum(F.col("x") * F.col("z")).alias("s"))
    rows = data.outcomes.join(sums, "rowId", "left").withColumns({"task": F.lit(0), "xb": F.coalesce("s", F.lit(0.0)) + (F.lit(0.0) if data.model.own_time else F.col("offset"))})
    t = terms(data, rows.drop("s"), ranges)
    sums = t.rows.select("rowId", "a", "b", "ll").join(x, "rowId").groupBy("i").agg(
        F.sum(F.col("a") * F.col("x")).alias("g"), F.sum(F.col("b") * F.col("bound")).alias("h"), F.sum(F.col("b") * F.col("x")).alias("c"), F.sum(F.when(F.col("i").isNull(), F.col("ll"))).alias("ll")
    )
    if t.groups is not None:
        null = F.lit(None).cast("double")
        level = t.groups.agg(F.sum("gll").alias("ll")).select(F.lit(None).cast("long").alias("i"), null.alias("g"), null.alias("h"), null.alias("c"), "ll")
        sums = sums.union(level).groupBy("i").agg(*[F.sum(c).alias(c) for c in ("g", "h", "c", "ll")])
    return sums


@contextmanager
def _alone(data: RegressionData, weights: DataFrame | None, block: bool) -> Iterator[tuple[RegressionData, DataFrame, Callable[[int], _Sums]]]:
    """As ``_by_row`` for models of independent rows. A row's first entry carries the row itself: of the intercept, or without a covariate
    where there is none. Predictors and sums are made of whole partitions as arrays, so that rows and entries are never joined."""
    outcomes = _weighted(data, weights).withColumn("offset", F.lit(0.0) if data.model.own_time else F.col("offset"))
    known = F.col("y").isNotNull() & F.col("offset").isNotNull()  # other rows teach nothing
    w = F.when(known, F.col("w")).otherwise(0.0)
    level = -w * log_factorial(F.col("y")) if data.model is Model.PR else F.lit(0.0)
    first = F.lit(INTERCEPT_ID if data.has_intercept else None).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = outcomes.select("rowId", first.alias("i"), F.lit(1.0 if data.has_intercept else 0.0).alias("x"), w.alias("w"), zero(F.col("y")).alias("y"), zero(F.col("offset")).alias("offset"), zero(level).alias("level"))
    null = F.lit(None).cast("double")
    x = data.covariates.select("rowId", F.col("covariateId").alias("i"), zero(F.col("covariateValue")).alias("x"), *[null.alias(c) for c in ("w", "y", "offset", "level")])
    entries_held = data.covariates.count() + data.outcomes.count() + 1
    parts = max(-(-entries_held // _ARRAYS), min(data.spark.sparkContext.defaultParallelism, -(-entries_held // _PART)))
    in_order = lambda df: df.repartition(parts, "rowId").sortWithinPartitions("rowId", F.desc_nulls_last("w"))
    held = in_order(rows.union(x)).persist()
    ship(data.spark)
    work = _array_sums(str(data.model), block)

    def sums(points: DataFrame, total: int) -> DataFrame:
        betas, few = _betas(points, total)
        if few:
            told = held.join(betas, "i", "left")
        else:  # the intercept's entries, one for each row, aren't shuffled by covariate
            own = F.broadcast(betas.filter(F.col("i") == INTERCEPT_ID))
            told = held.filter("w is not null").join(own, "i", "left").union(held.filter("w is null").join(betas, "i", "left"))
            told = in_order(told.select("rowId", "i", "x", "w", "y", "offset", "level", "z"))
        got = told.select("rowId", "i", "x", "w", "y", "offset", "level", F.coalesce("z", F.lit(0.0)).alias("z")).mapInArrow(work, "i long, g double, h double, c double, ll double")
        return got.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("g", "h", "c", "ll")])

    none = data.spark.range(1).select(F.lit(None).cast("long").alias("i"))
    try:
        yield replace(data, outcomes=outcomes), held.select("i").union(none), lambda total: lambda points: sums(points, total)
    finally:
        held.unpersist()


def _array_sums(model: str, block: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a partition's entries, sorted by row: (i, g, h, c, ll) as ``_evaluated`` has them, the log-likelihood in a row without a covariate."""
    intercept = INTERCEPT_ID

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found).combine_chunks()
        del found
        array = lambda c: table.column(c).to_numpy()  # noqa: E731  nulls of doubles are NaN
        row, x, w = array("rowId"), array("x"), array("w")
        real = table.column("i").is_valid().to_numpy()
        i = table.column("i").fill_null(intercept).to_numpy()
        new = np.concatenate([[True], row[1:] != row[:-1]])
        at, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        known = ~np.isnan(w[starts])  # entries of rows that aren't among the outcomes count for nothing
        xb = np.add.reduceat(x * array("z"), starts) + array("offset")[starts]
        y, w, level = array("y")[starts], w[starts], array("level")[starts]
        with np.errstate(over="ignore", invalid="ignore"):
            if model == "ls":
                a, b, ll = 2 * w * (y - xb), 2 * w, -w * (y - xb) * (y - xb)
            elif model == "lr":
                p = 1 / (1 + np.exp(-xb))
                a, b, ll = w * (y - p), w * p * (1 - p), w * (y * xb - np.logaddexp(0, xb))
            else:
                p = np.exp(xb)
                a, b, ll = w * (y - p), w * p, w * (y * xb - p) + level
        a, b, ll = (np.where(known, v, 0.0) for v in (a, b, ll))
        own = real & (i == intercept) if block else np.zeros(len(i), bool)
        size = np.abs(x)
        bound = size * np.where(own, size, np.add.reduceat(np.where(own, 0.0, size), starts)[at])
        ids, place = np.unique(i[real], return_inverse=True)
        total = lambda v: np.bincount(place, weights=v[real], minlength=len(ids))
        columns = [total(a[at] * x), total(b[at] * bound), total(b[at] * x)]
        none = np.full(len(ids), np.nan)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(v) for v in columns], pa.array(none, mask=np.ones(len(ids), bool))], ["i", "g", "h", "c", "ll"])
        null = pa.array([None], pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), null, null, null, pa.array([float(ll.sum())])], ["i", "g", "h", "c", "ll"])

    return work


def _evaluated(sums: _Sums, points: DataFrame) -> DataFrame:
    """points with g and h, the gradient and a bound of the curvature at z, and c, the curvature shared with the intercept; the row without
    a covariate has the log-likelihood as ll."""
    other = sums(points).withColumnRenamed("i", "j")
    return points.join(other, F.col("i").eqNullSafe(F.col("j"))).drop("j")


@dataclass(frozen=True)
class _Intercept:
    """A free intercept's row. Steps of the others count what it gives way; it then goes where its own derivative, carried on by
    theirs, is zero. Its curvature needs no bound, so that it converges with the others however many rows it has."""

    x: float
    z: float
    g: float
    h: float

    def gradient(self) -> Column:
        return F.when(F.col("i") == INTERCEPT_ID, 0.0).otherwise(F.col("g") - F.col("c") * (self.g / self.h))

    def step(self, crossed: float, damp: float, bound: float) -> float:
        """crossed: the sum of the others' steps times the curvature they share with it."""
        return max(-bound, min(bound, self.g / (self.h * damp) - crossed / self.h))


def _intercept(now: DataFrame, block: bool) -> _Intercept | None:
    row = now.filter(F.col("i") == INTERCEPT_ID).select("x", "z", "g", "h").first() if block else None
    return _Intercept(*row) if row is not None and all(math.isfinite(v) for v in row) and row["h"] > _FLAT else None


def _target(damp: float, bound: float, free: _Intercept | None) -> Column:
    """The best point of the bound at z, at most bound away in each coordinate. A free intercept stays, see its step."""
    z, h = F.col("z"), F.col("h") * damp
    pull = h * (z - F.col("loc")) + (free.gradient() if free else F.col("g"))
    best = F.col("loc") + F.signum(pull) * F.greatest(F.abs(pull) - F.col("rate"), F.lit(0.0)) / (h + F.col("ridge"))
    best = F.when(F.col("h") > _FLAT, F.greatest(F.least(best, z + bound), z - bound)).otherwise(z)
    return F.when(F.col("i") == INTERCEPT_ID, z).otherwise(best) if free else best


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    before = own_folders()
    out = written(df, "coefficients")
    return out, (own_folders() - before).pop()


def fit_table(data: RegressionData, prior: PriorSet | str = "none", control: Control = Control(), weights: DataFrame | None = None, variances: DataFrame | None = None, starting: DataFrame | None = None) -> TableFit:
    """The mode of the posterior by accelerated majorised steps: all coefficients move at once on a diagonal bound of the information, from
    a point that is carried on in the direction of the last move. An intercept without a prior moves with them by its exact curvature, as
    the heaviest covariate would be the last to converge and its gradient the furthest off. Momentum ends when a move turns against it; a step that lowers
    the objective is taken back, and shortened if it had none.

    variances: (covariateId, variance[, location]), the covariates' own, of the default prior's kind. starting: (covariateId, beta).
    Converged when what a step can gain, relative to the objective, is under the tolerance. Null coefficients and locations count
    as zero, null variances as the default; covariates that the data don't have are passed over. Not for exact conditional models.
    """
    prior = make_prior(prior) if isinstance(prior, str) else prior
    if data.model is Model.CLR_EXACT:
        raise ValueError("exact conditional models have no coefficients as a table")
    if data.model is Model.FGR and "censorWeights" not in data.outcomes.columns:
        raise ValueError("model fgr needs a column censorWeights among the outcomes")
    if data.has_intercept and not data.covariates.filter(F.col("covariateId") == INTERCEPT_ID).isEmpty():
        raise ValueError(f"covariate {INTERCEPT_ID} is the intercept; the data have entries of it")
    if data.model is Model.CLR_EFRON:
        data = replace(data, model=Model.CLR)
    told = variances is not None and not variances.filter(F.col("covariateId") == INTERCEPT_ID).isEmpty()
    free = INTERCEPT_ID not in prior.own and (INTERCEPT_ID in prior.exclude or not prior.force_intercept or (type(prior.default) is Prior and not told))
    block = data.has_intercept and free
    with _by_row(data, weights, block, control) as (held, ids, sums_of):
        return _fitted(data, held, ids, sums_of, prior, control, variances, starting, block)


def _fitted(data: RegressionData, held: RegressionData, ids: DataFrame, sums_of: Callable[[int], _Sums], prior: PriorSet, control: Control, variances: DataFrame | None, starting: DataFrame | None, block: bool) -> TableFit:
    first = start_values(held, [INTERCEPT_ID]).get(INTERCEPT_ID, 0.0) if data.has_intercept else 0.0
    points = _penalties(prior, F.col("i"), variances, ids.distinct())
    at = F.when(F.col("i") == INTERCEPT_ID, float(first)).otherwise(0.0)
    if starting is not None:
        points = points.join(starting.select(F.col("covariateId").alias("i"), F.col("beta").cast("double").alias("__b")), "i", "left")
        at = F.coalesce("__b", at)
    points = points.withColumns({"x": at, "z": at}).drop("__b")
    at_points = sums_of(points.limit(_FEW + 1).count())
    now, path = _stored(_evaluated(at_points, points))
    best, momentum, theta, damp, flag = None, 0.0, 1.0, 1.0, "MAX_ITERATIONS"
    for iteration in range(1, control.max_iterations + 1):
        free = _intercept(now, block)
        new, away = _target(damp, control.initial_bound, free), F.abs(F.col("z") - F.col("loc"))
        density = F.col("level") - F.col("rate") * away - 0.5 * F.col("ridge") * away * away
        total = lambda v: F.coalesce(F.sum(v), F.lit(0.0))
        others = F.col("i") != INTERCEPT_ID
        sums = now.withColumn("new", new).agg(
            F.sum("ll").alias("ll"),
            total(F.when(F.col("i").isNotNull(), density)).alias("density"),
            total(F.col("h") * F.pow(F.col("new") - F.col("z"), 2)).alias("gain"),
            total(F.col("h") * (F.col("z") - F.col("new")) * (F.col("new") - F.col("x"))).alias("turn"),
            total(F.when(others, F.col("c") * (F.col("new") - F.col("z")))).alias("crossed"),
            total(F.when(others, F.col("c") * (F.col("new") - F.col("x")))).alias("moved"),
        ).first().asDict()
        if free:
            sums["free"], step = free, free.step(sums["crossed"], damp, control.initial_bound)
            own = step + sums["crossed"] / free.h
            sums["gain"] += free.h * own * own
            sums["turn"] -= free.h * own * (free.z + step - free.x + sums["moved"] / free.h)
        objective = sums["ll"] + sums["density"] if sums["ll"] is not None else math.nan
        lower = not math.isfinite(objective) or (best is not None and objective < best[0] - 1e-12 * (abs(best[0]) + 1))
        if lower and best is None:
            flag = "ILLCONDITIONED"
            break
        if lower:
            damp = damp if momentum else damp * 4
            delete(path)
            objective, sums, now, path = best
            momentum, theta = 0.0, 1.0
        else:
            if best is not None:
                delete(best[3])
            best = objective, sums, now, path
            if sums["gain"] * damp < control.tolerance * (abs(objective) + 1):
                if not momentum:
                    flag = "SUCCESS"
                    break
                theta = 1.0  # once more, from the point itself
            following = (1 + math.sqrt(1 + 4 * theta * theta)) / 2
            momentum = 0.0 if theta == 1.0 or sums["turn"] > 0 else (theta - 1) / following
            theta = following if theta == 1.0 or sums["turn"] <= 0 else 1.0
        if iteration == control.max_iterations:
            break
        free = sums.get("free")
        moved = now.withColumn("new", _target(damp, control.initial_bound, free))
        if free:
            crossed = sums["crossed"] if not lower else moved.agg(F.coalesce(F.sum(F.when(others, F.col("c") * (F.col("new") - F.col("z")))), F.lit(0.0))).first()[0]  # damped anew
            moved = moved.withColumn("new", F.when(F.col("i") == INTERCEPT_ID, F.lit(free.z + free.step(crossed, damp, control.initial_bound))).otherwise(F.col("new")))
        moved = moved.withColumn("z", F.col("new") + momentum * (F.col("new") - F.col("x")))
        points = moved.select("i", "rate", "ridge", "loc", "level", F.col("new").alias("x"), "z")
        now, path = _stored(_evaluated(at_points, points))
    objective, sums, now, path = best or (math.nan, {"ll": math.nan, "density": math.nan}, now, path)
    found = now.filter("i is not null").select(F.col("i").alias("covariateId"), F.col("z").alias("beta"))
    return TableFit(data, prior, found, sums["ll"], sums["density"], iteration, flag)
