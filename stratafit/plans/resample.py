"""Folds, hyperparameter search and the bootstrap: tasks that are fitted side by side, each with weights of its own."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dense import TaskWeights
from ..operators.likelihood import log_likelihood
from ..operators.reduce import default_variance
from ..operators.score import coefficients
from .data import RegressionData
from .fit import Control, Fit, covariate_ids, fit, fit_tasks, start_values
from .models import Model
from .priors import PriorSet


def selector_unit(data: RegressionData, selector: str = "auto") -> str:
    """rowId or stratumId: what is drawn. auto: rows for pr and lr, else strata if there are more of them than rows in each."""
    if selector == "byRow":
        return "rowId"
    if selector == "byPid":
        return "stratumId"
    if data.model in (Model.PR, Model.LR):
        return "rowId"
    row = data.outcomes.agg(F.count("*").alias("n"), F.count_distinct("stratumId").alias("s")).first()
    return "stratumId" if row["n"] / max(row["s"], 1) < row["s"] else "rowId"


def auto_repetitions(n: int) -> int:
    return min(max(math.ceil(100 / math.sqrt(n)), 1), 10)


#: Bits of a hash that are told apart in one pass over the units.
_BITS = 14


def _hash(unit: str, seed: int, repetition: int) -> Column:
    """63 bits."""
    return F.shiftrightunsigned(F.xxhash64(unit, F.lit(seed), F.lit(repetition)), 1)


def hash_quantiles(units: DataFrame, h: Column, ranks: Sequence[int]) -> list[int]:
    """For each rank a number that so many of the hashes (63 bits, one for each row of units) don't exceed; where hashes are equal, the
    nearest above.

    A pass counts the next bits of the hashes in the ranges that hold a rank: some thousand counts for each reach the driver, and
    units are neither sorted nor shuffled.
    """
    hashes = units.select(h.alias("h"))
    found, inside, shift = {r: (1 << 63) - 1 for r in ranks}, {r: (0, r) for r in ranks if r > 0}, 63  # prefix, and rank within it
    while inside and shift > 0:
        below = max(0, shift - _BITS)
        prefixes = sorted({p for p, _ in inside.values()})
        rows = hashes.filter(F.shiftright("h", shift).isin(prefixes)) if shift < 63 else hashes
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in rows.groupBy(F.shiftright("h", below).alias("p")).count().orderBy("p").collect():
            counts.setdefault(r["p"] >> (shift - below), []).append((r["p"], r["count"]))
        after = {}
        for rank, (prefix, left) in inside.items():
            for p, n in counts.get(prefix, []):
                if left <= n:
                    found[rank] = ((p + 1) << below) - 1
                    if left < n:
                        after[rank] = (p, left)
                    break
                left -= n
        inside, shift = after, below
    return [found[r] if r > 0 else -1 for r in ranks]


def fold_of(data: RegressionData, k: int, seed: int = 0, repetition: int = 0, selector: str = "auto", deterministic: bool = False) -> tuple[str, Column]:
    """The column whose values are dealt to folds, and the fold of a row: folds of equal sizes (within one) by a hash; deterministic: the
    unit's id modulo k."""
    unit = selector_unit(data, selector)
    if deterministic:
        return unit, F.pmod(unit, F.lit(k)).cast("int")
    units = data.outcomes.select(unit) if unit == "rowId" else data.outcomes.select(unit).distinct()
    n, h = units.count(), _hash(unit, seed, repetition)
    edges = hash_quantiles(units, h, [n * i // k for i in range(1, k)])
    return unit, sum(((h > F.lit(e)).cast("int") for e in edges), F.lit(0))


def folds(data: RegressionData, k: int, seed: int = 0, repetition: int = 0, selector: str = "auto", deterministic: bool = False) -> DataFrame:
    """(rowId, fold), see ``fold_of``."""
    _, fold = fold_of(data, k, seed, repetition, selector, deterministic)
    return data.outcomes.select("rowId", fold.alias("fold"))


@dataclass(frozen=True)
class Search:
    """How a variance is chosen: auto (a unimodal search in its logarithm) or a grid; folds, repetitions, seed."""

    kind: str = "auto"
    fold: int = 10
    lower: float = 0.01
    upper: float = 20.0
    grid_steps: int = 10
    #: None: as many as auto_repetitions gives.
    repetitions: int | None = 1
    seed: int = 0
    start_variance: float = -1.0
    selector: str = "auto"
    deterministic: bool = False
    min_data: int = 100
    max_steps: int = 50


def log_grid(search: Search) -> list[float]:
    steps = search.grid_steps
    return [math.exp(math.log(search.lower) + k * (math.log(search.upper) - math.log(search.lower)) / max(steps - 1, 1)) for k in range(steps)]


def _own(data: RegressionData) -> Column:
    return F.coalesce("weights", F.lit(1.0)) if "weights" in data.outcomes.columns else F.lit(1.0)


def _read(data: RegressionData, unit: str) -> tuple[str, ...]:
    return (unit, *(["weights"] if "weights" in data.outcomes.columns else []))


def fold_weights(data: RegressionData, search: Search, copies: int = 1) -> tuple[TaskWeights, TaskWeights, int]:
    """Training and held-out weights of the tasks, numbered by copy, repetition and fold, and how many there are. A row's fold is told
    from a hash of its unit where the weight is used."""
    dealt = [fold_of(data, search.fold, search.seed, r, search.selector, search.deterministic) for r in range(search.repetitions)]
    unit, fold = dealt[0][0], F.array(*[f for _, f in dealt])
    per_copy = search.repetitions * search.fold

    def is_out(task: Column) -> Column:
        place = task % per_copy
        return F.get(fold, F.floor(place / search.fold).cast("int")) == place % search.fold

    train = TaskWeights(lambda task: F.when(is_out(task), 0.0).otherwise(_own(data)), _read(data, unit))
    held = TaskWeights(lambda task: F.when(is_out(task), _own(data)).otherwise(0.0), _read(data, unit))
    return train, held, copies * per_copy


def cv_scores(data: RegressionData, priors: Sequence[PriorSet], search: Search, control: Control = Control()) -> list[tuple[float, float]]:
    """(mean, standard deviation over folds) of the held-out log-likelihood for each prior; folds whose fit fails are left
    out. All folds of all priors are fitted in the same jobs."""
    ids = covariate_ids(data)
    train, held, tasks = fold_weights(data, search, len(priors))
    per = tasks // len(priors)
    start = start_values(data, ids)
    done = fit_tasks(data, [p for p in priors for _ in range(per)], ids, [start] * tasks, control, train)
    values = {r["task"]: r["value"] for r in log_likelihood(data, coefficients(data.spark, *[d["betas"] for d in done]), tasks, held, predictive=True, ranges=control.ranges).collect()}
    out = []
    for p in range(len(priors)):
        good = [values[t] for t in range(p * per, (p + 1) * per) if done[t]["flag"] == "SUCCESS" and values.get(t) is not None and math.isfinite(values[t])]
        out.append((float(np.mean(good)), float(np.std(good))) if good else (math.nan, math.nan))
    return out


def unimodal_search(value: Callable[[float], tuple[float, float]], start: float, max_steps: int = 50, step: float = math.log(10), y_tolerance: float = 0.01) -> tuple[float, dict[float, float]]:
    """The highest point of a unimodal function of ln x, and all points tried. value gives a mean and its standard deviation.

    Steps by a factor until the highest point has lower neighbours; then goes to the top of the parabola that fits all points
    best, each weighted by one over its deviation, or between the neighbours where that is no place for a new point. Ends when the
    neighbours are within a factor of 1.5, or the values there within y_tolerance.
    """
    seen: dict[float, tuple[float, float]] = {}

    def at(x: float) -> None:
        if x not in seen:
            seen[x] = value(math.exp(x))

    height = lambda x: seen[x][0] if math.isfinite(seen[x][0]) else -math.inf
    at(math.log(start))
    for _ in range(max_steps):
        best = max(seen, key=height)
        below, above = [x for x in seen if x < best], [x for x in seen if x > best]
        if not below or not above:
            at(best + step if not above else best - step)
            continue
        a, c = max(below), min(above)
        if max(c - best, best - a) < math.log(1.5) or max(height(best) - height(a), height(best) - height(c)) < y_tolerance:
            break
        good = [x for x in seen if math.isfinite(seen[x][0])]
        weights = [1 / max(seen[x][1], 1e-6) for x in good]
        curve = np.polyfit([x - best for x in good], [seen[x][0] for x in good], 2, w=np.array(weights) / max(weights)) if len(good) > 2 else np.zeros(3)
        top = best - curve[1] / (2 * curve[0]) if curve[0] < 0 else best
        if not a < top < c or min(abs(top - x) for x in seen) < 0.05:
            top = (best + (a if best - a > c - best else c)) / 2
        at(float(top))
    best = max(seen, key=height)
    return math.exp(best), {math.exp(x): v[0] for x, v in seen.items()}


def cross_validated(data: RegressionData, prior: PriorSet, search: Search = Search(), control: Control = Control()) -> Fit:
    """The fit at the variance with the best held-out log-likelihood. Of priors with several variances (fused, hierarchical) the auto
    search goes over one after another, until none changes by more than a hundredth of itself."""
    n = data.outcomes.count()
    if n < search.min_data:
        raise ValueError(f"cross-validation needs {search.min_data} rows at least")
    if not prior.default.regularized:
        raise ValueError("without a prior there is no variance to cross-validate")
    if search.repetitions is None:
        search = replace(search, repetitions=auto_repetitions(n))
    weights = data.outcomes.select("rowId", F.coalesce("weights", F.lit(1.0)).alias("w")) if "weights" in data.outcomes.columns else None
    if search.kind == "grid":
        points = log_grid(search)
        scores = cv_scores(data, [prior.with_variance(v) for v in points], search, control)
        best, tried = max(zip(points, scores, strict=True), key=lambda x: x[1][0] if math.isfinite(x[1][0]) else -math.inf)[0], {p: s[0] for p, s in zip(points, scores, strict=True)}
        chosen: dict[str, float] = {"variance": best}
    else:
        start = search.start_variance if search.start_variance > 0 else default_variance(data)
        chosen, tried = {name: start for name in prior.variances}, {}
        for _ in range(10):
            before = dict(chosen)
            for name in chosen:
                chosen[name], tried = unimodal_search(lambda v, name=name: cv_scores(data, [prior.with_variance({**chosen, name: v})], search, control)[0], chosen[name], search.max_steps)
            if len(chosen) == 1 or sum(abs(chosen[k] - before[k]) / chosen[k] for k in chosen) < 0.01:
                break
    out = fit(data, prior.with_variance(chosen), control, weights)
    return replace(out, cross_validation={**chosen, "ordinate": max(v for v in tried.values() if math.isfinite(v)), "points": tried})


def weight_based_search(data: RegressionData, in_sample: DataFrame, prior: PriorSet, variances: Sequence[float], control: Control = Control()) -> tuple[float, list[float]]:
    """The variance whose fit to the rows with in_sample (rowId, w) of 1 predicts the rows with 0 best, and all values."""
    ids = covariate_ids(data)
    start = start_values(data, ids)
    done = fit_tasks(data, [prior.with_variance(v) for v in variances], ids, [start] * len(variances), control, in_sample)
    rest = in_sample.select("rowId", (1 - F.col("w")).alias("w"))
    rows = log_likelihood(data, coefficients(data.spark, *[d["betas"] for d in done]), len(variances), rest, predictive=True, ranges=control.ranges)
    values = {r["task"]: r["value"] for r in rows.collect()}
    scores = [values[t] for t in range(len(variances))]
    return variances[int(np.nanargmax(scores))], scores


def outer_grid(data: RegressionData, make: Callable[..., PriorSet], grid: Sequence[Sequence[float]], search: Search = Search(kind="grid"), control: Control = Control(), inner: bool = False) -> tuple[tuple[float, ...], Fit]:
    """The best point of an outer grid of hyperparameters by cross-validation, and the fit there. inner: at each point the variance is
    searched for besides."""
    points = list(itertools.product(*grid))
    if inner:
        fits = [cross_validated(data, make(*p), replace(search, kind="auto"), control) for p in points]
        best = int(np.nanargmax([f.cross_validation["ordinate"] for f in fits]))
        return points[best], fits[best]
    scores = cv_scores(data, [make(*p) for p in points], search, control)
    best = points[int(np.nanargmax([s[0] for s in scores]))]
    return best, fit(data, make(*best), control)


#: Probabilities that a Poisson count of mean 1 is at most 0, 1, 2, ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def bootstrap_weights(data: RegressionData, seed: int = 0, selector: str = "auto") -> TaskWeights:
    """Independent Poisson(1) counts for each task and unit, times the rows' own weights, told from a hash where they are used. Up to the
    total's variation that is drawing units with replacement, without any task having to see all of them."""
    unit = selector_unit(data, selector)

    def of(task: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(unit, task.cast("int"), F.lit(seed)), 11) + 0.5) / float(1 << 53)
        return sum((F.when(u > float(e), 1).otherwise(0) for e in _POISSON), F.lit(0)).cast("double") * _own(data)

    return TaskWeights(of, _read(data, unit))


def bootstrap(fitted: Fit, replicates: int = 100, seed: int = 0, level: float = 0.95, na_rm: bool = False, selector: str = "auto") -> tuple[dict[int, dict[str, float]], list[dict[int, float]]]:
    """For each covariate original, bias, std_err, bpi_lower, bpi_upper; and all replicates. Replicates start at the fit."""
    data, ids = fitted.data, fitted.ids
    done = fit_tasks(data, [fitted.prior] * replicates, ids, [fitted.betas] * replicates, fitted.control, bootstrap_weights(data, seed, selector))
    values = {c: np.array([d["betas"][c] if d["flag"] == "SUCCESS" else math.nan for d in done]) for c in ids}
    out = {}
    for c, v in values.items():
        v = v[~np.isnan(v)] if na_rm else v
        low, high = (float(np.quantile(v, q)) for q in ((1 - level) / 2, (1 + level) / 2))
        out[c] = {"original": fitted.betas[c], "bias": float(v.mean()) - fitted.betas[c], "std_err": float(v.std(ddof=1)), "bpi_lower": low, "bpi_upper": high}
    return out, [d["betas"] for d in done]


def proportion_weights(data: RegressionData, total: int) -> DataFrame:
    """(rowId, w): 1 for the first ``total`` rows by id, else 0."""
    first = data.outcomes.select("rowId").orderBy("rowId").limit(total).withColumn("w", F.lit(1.0))
    return data.outcomes.select("rowId").join(first, "rowId", "left").select("rowId", F.coalesce("w", F.lit(0.0)).alias("w"))
