"""Fits: one Spark job for each iteration gives log-likelihood, gradient and information of all tasks; the step is found on
the driver by cyclic coordinate descent over the small quadratic model, with priors and trust regions.

Only coefficients and their information matrix reach the driver, never rows. With few covariates an iteration is one scan of rows
that hold them as columns. Many covariates are handled by an active set: the gradient of all is one job, and the quadratic model
covers those that are or may become non-zero; or by majorised steps, which need vectors only.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dense import MOST, Moments, TaskWeights, dense_moments, dense_rows
from ..operators.likelihood import convergence_sums, fit_moments, gradient, log_likelihood, majorizer_moments
from ..operators.score import coefficients
from ..operators.survival import range_cuts
from .data import RegressionData
from .models import INTERCEPT_ID, Model
from .priors import Jeffreys, Laplace, PriorSet, make_prior


@dataclass(frozen=True)
class Control:
    max_iterations: int = 100
    tolerance: float = 1e-8
    initial_bound: float = 2.0
    #: Inner cycles over the coordinates of one quadratic model.
    cycles: int = 200
    #: Two-level running sums over so many ranges of time; None: as many as the largest stratum's times need.
    ranges: int | None = None
    #: When a fit has converged: lange, the relative change of likelihood and prior; mittal, of the likelihood; gradient, of the sum of
    #: y * xb; zhang_oles, the sum of |change of xb| over that of |xb|, plus one; one_step, after one step.
    convergence: str = "lange"
    #: newton: steps on the whole information matrix; mm: all coefficients at once on a diagonal bound of it, for many of them.
    algorithm: str = "newton"
    #: Fit on an active set of covariates (Laplace prior), screened by the gradient of all.
    active_set: bool = False
    #: Called with the data and the control before a fit; gives the control to use.
    set_hook: Callable[[RegressionData, Control], Control] | None = None


@dataclass(frozen=True)
class Fit:
    data: RegressionData
    prior: PriorSet
    control: Control
    betas: Mapping[int, float]
    log_likelihood: float
    log_prior: float
    iterations: int
    return_flag: str
    information: np.ndarray
    gradient: Mapping[int, float]
    weights: DataFrame | None = None
    fixed: frozenset[int] = frozenset()
    cross_validation: Mapping[str, object] = field(default_factory=dict)
    #: The covariates of the information's rows; those that a fit on an active set leaves out have none.
    information_ids: tuple[int, ...] = ()

    @property
    def ids(self) -> list[int]:
        return sorted(self.betas)

    def frame(self) -> DataFrame:
        """(task 0, covariateId, beta)."""
        return coefficients(self.data.spark, self.betas)

    def coef(self, rescale: bool = False, ignore_convergence: bool = False) -> dict[str, float]:
        if self.return_flag != "SUCCESS" and not ignore_convergence:
            raise RuntimeError(f"the fit has not converged: {self.return_flag}")
        scale = {r["covariateId"]: r["scale"] for r in self.data.scales.collect()} if rescale and self.data.scales is not None else {}
        return {self.data.name_of(c): self.betas[c] * scale.get(c, 1.0) for c in self.ids}

    @property
    def degrees_of_freedom(self) -> int:
        return sum(not math.isnan(b) for b in self.betas.values())


CONVERGENCE = ("lange", "mittal", "gradient", "zhang_oles", "one_step")


def _collected(moments: DataFrame, ids: Sequence[int], tasks: int, diagonal: bool = False) -> list[Moments]:
    """Log-likelihood, gradient and information of each task; of a diagonal information only the diagonal, as a vector."""
    place, n = {c: k for k, c in enumerate(ids)}, len(ids)
    level, g, h = [0.0] * tasks, np.zeros((tasks, n)), np.zeros((tasks, n) if diagonal else (tasks, n, n))
    for r in moments.collect():
        t, value = r["task"], r["value"] if r["value"] is not None else 0.0
        if r["i"] is None:
            level[t] += value
        elif r["j"] is None:
            g[t, place[r["i"]]] += value
        elif diagonal:
            h[t, place[r["i"]]] += value
        else:
            a, b = place[r["i"]], place[r["j"]]
            h[t, a, b] += value
            if a != b:
                h[t, b, a] += value
    return [Moments(level[t], g[t], h[t]) for t in range(tasks)]


Evaluate = Callable[..., list[Moments]]


def _moments(data: RegressionData, ids: Sequence[int], control: Control, weights: DataFrame | TaskWeights | None) -> tuple[Evaluate, Callable[[], None]]:
    """A function that gives the moments at coefficients of the tasks with the given numbers, see ``dense_moments``, and one that ends its
    use."""
    if control.algorithm != "mm" and data.model is not Model.CLR_EXACT and len(ids) <= MOST:
        dense = dense_rows(data, ids, weights, control.ranges)
        return (lambda betas, numbers, **more: dense_moments(dense, betas, numbers, **more)), dense.rows.unpersist
    diagonal, of = control.algorithm == "mm", majorizer_moments if control.algorithm == "mm" else fit_moments
    ranges = range_cuts(data.outcomes, ["stratumId"], control.ranges) if data.model.survival else ()

    def long_form(betas: Sequence[Mapping[int, float]], numbers: Sequence[int], before: Sequence[Mapping[int, float]] | None = None, third: bool = False, score: bool = False) -> list[Moments]:
        if third:
            raise ValueError(f"the information's derivative needs a fit with at most {MOST} covariates, in steps of newton")
        used = weights
        if isinstance(weights, TaskWeights):
            own = F.array(*[F.lit(int(t)) for t in numbers])
            used = replace(weights, of=lambda task: weights.of(F.get(own, task)))
        now = coefficients(data.spark, *betas)
        out = _collected(of(data, now, ids, len(betas), used, ranges), ids, len(betas), diagonal)
        if before is not None or score:
            sums = {r["task"]: r for r in convergence_sums(data, now, coefficients(data.spark, *before) if before is not None else None, len(betas), used).collect()}
            out = [m._replace(**{n: math.nan if sums[t][n] is None else sums[t][n] for n in ("score", "moved", "size")}) for t, m in enumerate(out)]
        return out

    return long_form, lambda: None


class _Whole:
    """Rows with all covariates, few of them, held while fits on several active sets read them. The moments at the last coefficients are
    known, so that slopes at a fit cost no job."""

    def __init__(self, data: RegressionData, ids: Sequence[int], control: Control, weights: DataFrame | None) -> None:
        self.ids, self._known = list(ids), {}
        self._evaluate, self.end = _moments(data, self.ids, control, weights)

    @staticmethod
    def fits(data: RegressionData, ids: Sequence[int], control: Control) -> bool:
        return 0 < len(ids) <= MOST and control.algorithm != "mm" and data.model is not Model.CLR_EXACT and control.convergence in ("lange", "mittal", "one_step")

    def at(self, betas: Mapping[int, float]) -> Moments:
        key = tuple(float(betas.get(c, 0.0)) for c in self.ids)
        if key not in self._known:
            self._known = {key: self._evaluate([dict(zip(self.ids, key, strict=True))], [0])[0]}
        return self._known[key]

    def of(self, ids: Sequence[int]) -> Evaluate:
        """As ``_moments`` for some of the covariates, the others being zero."""
        place = [self.ids.index(c) for c in ids]

        def evaluate(betas: Sequence[Mapping[int, float]], numbers: Sequence[int], **more: object) -> list[Moments]:
            return [m._replace(gradient=m.gradient[place], information=m.information[np.ix_(place, place)]) for m in map(self.at, betas)]

        return evaluate

    def slopes(self, betas: Mapping[int, float], prior: PriorSet, without: Sequence[int]) -> list[tuple[int, float, float]]:
        """(covariate, slope, rate) at betas of those under a Laplace prior."""
        found = dict(zip(self.ids, self.at(betas).gradient, strict=True))
        return [(c, float(g), prior.of(c).rate) for c, g in found.items() if c not in without and isinstance(prior.of(c), Laplace)]


def _descend(ids: Sequence[int], beta: np.ndarray, g: np.ndarray, h: np.ndarray, prior: PriorSet, fixed: frozenset[int], bound: np.ndarray, control: Control) -> np.ndarray:
    """New coefficients: coordinate descent on the quadratic model at beta, within the trust region of each."""
    new, slope = beta.copy(), g.copy()
    index = {c: k for k, c in enumerate(ids)}
    if h.ndim == 1:  # a bound without mixed terms: all coordinates at once
        for k, c in enumerate(ids):
            if c not in fixed and h[k] > 1e-12:
                step = prior.of(c).step(g[k], h[k], beta[k], [beta[index[o]] for o in prior.seen_by(c) if o in index])
                new[k] += min(max(step, -bound[k]), bound[k])
        return new
    for _ in range(control.cycles):
        largest = 0.0
        for k, c in enumerate(ids):
            if c in fixed or h[k, k] <= 1e-12:
                continue
            step = prior.of(c).step(slope[k], h[k, k], new[k], [new[index[o]] for o in prior.seen_by(c) if o in index])
            step = min(max(step, beta[k] - bound[k] - new[k]), beta[k] + bound[k] - new[k])
            if step:
                new[k] += step
                slope -= h[:, k] * step
                largest = max(largest, abs(step))
        if largest < 1e-11:
            break
    return new


def start_values(data: RegressionData, ids: Sequence[int]) -> dict[int, float]:
    """Zeros, with the intercept at the link of the mean outcome."""
    betas = dict.fromkeys(ids, 0.0)
    if data.has_intercept:
        row = data.outcomes.agg(F.avg("y").alias("y"), (F.sum("y") / F.sum(F.exp("offset"))).alias("rate")).first()
        mean = min(max(row["y"] or 0.0, 1e-6), 1 - 1e-6) if data.model is Model.LR else row["y"] or 0.0
        betas[INTERCEPT_ID] = math.log(mean / (1 - mean)) if data.model is Model.LR else math.log(max(row["rate"] or 0.0, 1e-10)) if data.model is Model.PR else mean
    return betas


def covariate_ids(data: RegressionData) -> list[int]:
    found = sorted(r[0] for r in data.covariates.select("covariateId").distinct().collect())
    return [INTERCEPT_ID, *found] if data.has_intercept else found


@contextmanager
def _held(data: RegressionData) -> Iterator[None]:
    """The tables persisted while a fit reads them again and again, unless the caller has done so."""
    mine = [df for df in (data.outcomes, data.covariates) if not (df.storageLevel.useMemory or df.storageLevel.useDisk)]
    for df in mine:
        df.persist()
    try:
        yield
    finally:
        for df in mine:
            df.unpersist()


def fit_tasks(data: RegressionData, priors: Sequence[PriorSet], ids: Sequence[int], starts: Sequence[Mapping[int, float]], control: Control, weights: DataFrame | TaskWeights | None = None, fixed: Sequence[frozenset[int]] | None = None) -> list[dict]:
    """Fits of all tasks in lock-step: each iteration is one job over the tasks that haven't converged.

    weights: (rowId, w), or weights of each task's own. Returns betas, ll, g, h, iterations, flag.
    """
    with _held(data):
        return _fit_tasks(data, priors, sorted(ids), starts, control, weights, fixed)


def _fit_tasks(data: RegressionData, priors: Sequence[PriorSet], ids: Sequence[int], starts: Sequence[Mapping[int, float]], control: Control, weights: DataFrame | TaskWeights | None, fixed: Sequence[frozenset[int]] | None, whole: _Whole | None = None) -> list[dict]:
    if control.convergence not in CONVERGENCE:
        raise ValueError(f"convergence must be one of {CONVERGENCE}")
    n = len(priors)
    moments, end = (whole.of(ids), lambda: None) if whole else _moments(data, ids, control, weights)
    fixed = fixed or [frozenset()] * n
    beta = [np.array([s.get(c, 0.0) for c in ids]) for s in starts]
    state = [{"best": -math.inf, "flag": "MAX_ITERATIONS", "iterations": 0, "bound": np.full(len(ids), control.initial_bound), "at": None, "objective": math.nan} for _ in range(n)]
    open_tasks = list(range(n))
    named = lambda b: dict(zip(ids, map(float, b), strict=True))
    third = any(isinstance(p.default, Jeffreys) for p in priors)
    for iteration in range(1, control.max_iterations + 1):
        more = {"third": third, "score": control.convergence == "gradient"}
        if control.convergence == "zhang_oles":
            more["before"] = [named(state[t]["at"][0] if state[t]["at"] else beta[t]) for t in open_tasks]
        found = moments([named(beta[t]) for t in open_tasks], open_tasks, **more)
        still = []
        for m, t in zip(found, open_tasks, strict=True):
            s, (ll, g, h) = state[t], m[:3]
            s["iterations"] = iteration
            prior = priors[t]
            if isinstance(prior.default, Jeffreys):
                prior = _with_jeffreys(prior, m)
            value = ll + prior.log_density(named(beta[t]))
            if not math.isfinite(value) or not np.isfinite(g).all():
                s["flag"] = "ILLCONDITIONED"
                continue
            adaptive = any(p.adaptive for p in (prior.default, *prior.own.values()))
            if s["at"] is not None and value < s["best"] - 1e-10 * (abs(s["best"]) + 1) and not adaptive:
                beta[t] = (beta[t] + s["at"][0]) / 2  # too far: half the way back
                still.append(t)
                continue
            objective = {"mittal": ll, "gradient": m.score, "one_step": 0.0}.get(control.convergence, value)
            change = abs(objective - s["objective"]) / (abs(objective) + 1) if s["at"] is not None else math.inf
            if control.convergence == "zhang_oles" and s["at"] is not None:
                change = m.moved / (1 + m.size)
            first = s["at"] is None
            poor = change == 0.0 and s.get("steps", 0) == 1 and control.convergence in ("lange", "mittal", "gradient") and not fixed[t] >= set(ids)
            before = s["at"][0] if s["at"] is not None else None
            s.update(best=value, at=(beta[t].copy(), ll, g, h), objective=objective, steps=s.get("steps", 0) + 1)
            new = _descend(ids, beta[t], g, h, prior, fixed[t], s["bound"], control)
            step = np.abs(new - beta[t])
            if poor and step.max(initial=0) >= 1e-9:
                s["flag"] = "POOR_BLR_STEP"  # the first step has moved, but not the objective
                continue
            settled = step.max(initial=0) < 1e-5 or not adaptive or control.convergence != "lange"
            if (change < control.tolerance and settled) or step.max(initial=0) < 1e-9 or (control.convergence == "one_step" and not first):
                s["flag"] = "SUCCESS"
                continue
            if before is not None:
                s["bound"] = np.maximum(np.maximum(2 * step, s["bound"] / 2), 1e-3)
            beta[t] = new
            still.append(t)
        open_tasks = still
        if not open_tasks:
            break
    end()
    out = []
    for t, s in enumerate(state):
        at = s["at"] or (beta[t], math.nan, np.full(len(ids), math.nan), np.zeros((0, 0)))
        out.append({"betas": named(at[0]), "ll": at[1], "g": named(at[2]), "h": at[3], "h_ids": tuple(ids), "iterations": s["iterations"], "flag": s["flag"]})
    return out


def _with_jeffreys(prior: PriorSet, m: Moments) -> PriorSet:
    """The prior with the information of the one covariate, the last one, and its derivative."""
    h = float(m.information[-1, -1])
    return replace(prior, default=Jeffreys(m.third / (2 * h) if h > 0 else 0.0, max(h, 1e-300)))


def _check_jeffreys(data: RegressionData, ids: Sequence[int]) -> None:
    if len([c for c in ids if c != INTERCEPT_ID]) != 1:
        raise ValueError("a Jeffreys prior needs a model with exactly one covariate")
    if not data.covariates.filter("covariateValue <> 1").isEmpty():
        raise ValueError("a Jeffreys prior needs a covariate whose entries are all 1")


#: How often a fit that breaks down is tried again with a tenth of the first steps' bound.
RESTARTS = 5


def fit(data: RegressionData, prior: PriorSet | str = "none", control: Control = Control(), weights: DataFrame | None = None, starting: Mapping[int, float] | None = None, fixed: Sequence[int] = (), ids: Sequence[int] | None = None) -> Fit:
    """The mode of the posterior (of the likelihood without a prior).

    weights: (rowId, w), not negative; all zero: ILLCONDITIONED. fixed: covariates kept at their starting values. A
    coefficient that the data leave infinite ends at a large value, with a warning, after majorised steps have been tried. A fit that
    breaks down starts again with shorter steps. Hooks: control.set_hook may change the control at first; prior.fit_hook, where there
    is one, makes the whole fit.
    """
    prior = make_prior(prior) if isinstance(prior, str) else prior
    if control.set_hook is not None:
        control = control.set_hook(data, control)
    if prior.fit_hook is not None:
        return prior.fit_hook(data, replace(prior, fit_hook=None), control, weights)
    if data.model is Model.FGR and "censorWeights" not in data.outcomes.columns:
        raise ValueError("model fgr needs a column censorWeights among the outcomes")
    if weights is not None:
        low = weights.agg(F.min("w").alias("low"), F.max("w").alias("high")).first()
        if (low["low"] or 0.0) < 0:
            raise ValueError("weights must not be negative")
        if not low["high"]:
            return Fit(data, prior, control, dict.fromkeys(ids or covariate_ids(data), 0.0), math.nan, math.nan, 0, "ILLCONDITIONED", np.zeros((0, 0)), {}, weights)
    all_ids = list(ids) if ids is not None else covariate_ids(data)
    if data.has_intercept and prior.default.regularized and not prior.force_intercept and INTERCEPT_ID not in {*prior.exclude, *prior.own}:
        warnings.warn("the intercept is left out of the prior; exclude it, or take it in by force_intercept", stacklevel=2)
    if isinstance(prior.default, Jeffreys):
        _check_jeffreys(data, all_ids)
    start = start_values(data, all_ids) | dict(starting or {})
    if data.model is Model.CLR_EFRON:
        data = replace(data, model=Model.CLR)  # one likelihood: ties of conditional models follow Breslow
    tried = control
    for _ in range(RESTARTS + 1):
        if control.active_set and isinstance(prior.default, Laplace):
            done = _fit_active(data, prior, all_ids, start, tried, weights, frozenset(fixed), all_ids if ids is not None else None)
        else:
            done = fit_tasks(data, [prior], all_ids, [start], tried, weights, [frozenset(fixed)])[0]
        if done["flag"] == "POOR_BLR_STEP":
            warnings.warn("the first step leaves the convergence criterion as it was: a coefficient may be infinite", stacklevel=2)
            if control.convergence == "gradient":
                return fit(data, prior, replace(control, convergence="lange"), weights, starting, fixed, ids)
            break
        if done["flag"] != "ILLCONDITIONED":
            break
        tried = replace(tried, initial_bound=tried.initial_bound / 10)
    if done["flag"] in ("SUCCESS", "MAX_ITERATIONS") and _runs_away(done, prior, frozenset(fixed)):
        if done["flag"] == "MAX_ITERATIONS" and control.algorithm != "mm" and data.model is not Model.CLR_EXACT:
            done = fit_tasks(data, [prior], all_ids, [done["betas"]], replace(tried, algorithm="mm"), weights, [frozenset(fixed)])[0]
        warnings.warn("a coefficient runs away: the data may leave it infinite", stacklevel=2)
    return Fit(data, prior, control, done["betas"], done["ll"], prior.log_density(done["betas"]), done["iterations"], done["flag"], done["h"], done["g"], weights, frozenset(fixed), information_ids=done["h_ids"])


def _runs_away(done: Mapping, prior: PriorSet, fixed: frozenset[int]) -> bool:
    h = done["h"]
    flat = {c: float(np.abs(h[k]).max(initial=0.0)) for k, c in enumerate(done["h_ids"])} if h.size else {}
    return any(abs(b) > 15 and flat.get(c, 1.0) < 1e-3 for c, b in done["betas"].items() if not prior.of(c).regularized and c not in fixed and c != INTERCEPT_ID)


#: Violating covariates that join an active set at once, at most.
MOST_JOINING = 200


def _rates(prior: PriorSet, i: Column) -> Column:
    """The Laplace rate of each covariate; null where there is no such prior."""
    rate = lambda p: F.lit(p.rate if isinstance(p, Laplace) else None).cast("double")
    out = rate(prior.default)
    for c, p in prior.own.items():
        out = F.when(i == int(c), rate(p)).otherwise(out)
    return out


def _slopes(data: RegressionData, betas: Mapping[int, float], prior: PriorSet, ids: Sequence[int] | None, without: Sequence[int], control: Control, weights: DataFrame | None) -> DataFrame:
    """(i, value, rate): the gradient at betas of the covariates that may join, with their rates."""
    rows = gradient(data, coefficients(data.spark, betas), 1, weights, control.ranges).select("i", "value")
    listed = lambda c: F.broadcast(data.spark.createDataFrame([(int(x),) for x in c], "i long"))
    rows = rows.join(listed(ids), "i", "left_semi") if ids is not None else rows
    rows = rows.join(listed(without), "i", "left_anti") if without else rows
    return rows.withColumn("rate", _rates(prior, F.col("i")))


def _violating(slopes: DataFrame, most: int = MOST_JOINING) -> list[int]:
    """The covariates at zero whose slope is beyond their own rate, the worst first; judged on the executors."""
    beyond = F.abs("value") - F.col("rate")
    return [r["i"] for r in slopes.filter(beyond > 1e-6 * F.col("rate")).orderBy(beyond.desc(), "i").limit(most).collect()]


def _fit_active(data: RegressionData, prior: PriorSet, ids: Sequence[int], start: Mapping[int, float], control: Control, weights: DataFrame | None, fixed: frozenset[int], among: Sequence[int] | None = None, expected: Sequence[int] = (), whole: _Whole | None = None) -> dict:
    """Fits on the covariates that are non-zero, expected to be, or violate the optimality condition |g| <= rate at zero, until none
    does. among: the covariates that may join, where these aren't all of the data. The information is that of the active ones. whole:
    rows with all that may join, if there are few."""
    active = sorted({*[c for c in ids if start.get(c) or not isinstance(prior.of(c), Laplace) or prior.of(c).location or c in fixed], *expected})
    betas, iterations = dict(start), 0
    while True:
        fitted = (lambda: _fit_tasks(data, [prior], active, [betas], control, weights, [fixed], whole)) if whole else lambda: fit_tasks(data, [prior], active, [betas], control, weights, [fixed])
        done = fitted()[0] if active else {"betas": {}, "ll": math.nan, "g": {}, "h": np.zeros((0, 0)), "h_ids": (), "iterations": 0, "flag": "SUCCESS"}
        betas, iterations = dict.fromkeys(ids, 0.0) | done["betas"], iterations + done["iterations"]
        if done["flag"] == "ILLCONDITIONED":
            more = []
        elif whole:
            beyond = [(abs(g) - rate, c) for c, g, rate in whole.slopes(betas, prior, active) if abs(g) - rate > 1e-6 * rate]
            more = [c for _, c in sorted(beyond, key=lambda x: (-x[0], x[1]))[:MOST_JOINING]]
        else:
            more = _violating(_slopes(data, betas, prior, among, active, control, weights))
        if not more:
            if not active:
                done["ll"] = log_likelihood(data, coefficients(data.spark, betas or {INTERCEPT_ID: 0.0}), 1, weights, ranges=control.ranges).first()["value"]
            return done | {"betas": {c: betas[c] for c in sorted(ids)}, "g": dict.fromkeys(ids, math.nan) | done["g"], "iterations": iterations}
        active = sorted({*active, *more})


def fit_path(data: RegressionData, prior: PriorSet, variances: Sequence[float], control: Control = Control(), weights: DataFrame | None = None, ids: Sequence[int] | None = None) -> list[Fit]:
    """Laplace fits at rising variances, each begun at the one before, on active sets chosen by the sequential strong rule: a covariate is
    expected to stay at zero if its slope at the last fit is under twice the new rate less the last one. The rule may err, so each
    fit is checked like any other fit on an active set. Few covariates stand as columns of rows that are made once for all fits."""
    if not isinstance(prior.default, Laplace):
        raise ValueError("a path of variances is one of Laplace priors")
    all_ids = sorted(ids) if ids is not None else covariate_ids(data)
    among = all_ids if ids is not None else None
    betas, last, out = start_values(data, all_ids), None, []
    whole = _Whole(data, all_ids, control, weights) if _Whole.fits(data, all_ids, control) else None
    with nullcontext() if whole else _held(data):
        for v in sorted(variances):
            now = prior.with_variance(v)
            expected: list[int] = []
            nonzero = [c for c in all_ids if betas[c]]
            if last is not None and whole:
                expected = [c for c, g, rate in whole.slopes(betas, now, nonzero) if abs(g) >= 2 * rate - (rate if c in now.own else last)]
            elif last is not None:
                slopes = _slopes(data, betas, now, among, nonzero, control, weights)
                threshold = 2 * F.col("rate") - F.when(F.col("i").isin(list(map(int, prior.own))), F.col("rate")).otherwise(F.lit(last)) if prior.own else 2 * F.col("rate") - F.lit(last)
                expected = [r["i"] for r in slopes.filter(F.abs("value") >= threshold).select("i").collect()]  # no more than become active, but for a few
            done = _fit_active(data, now, all_ids, betas, control, weights, frozenset(), among, expected, whole)
            betas, last = done["betas"], now.default.rate
            out.append(Fit(data, now, control, betas, done["ll"], now.log_density(betas), done["iterations"], done["flag"], done["h"], done["g"], weights, information_ids=done["h_ids"]))
    if whole:
        whole.end()
    return out


def log_lik(fitted: Fit) -> tuple[float, int, int]:
    """The log-likelihood, its degrees of freedom (coefficients that are numbers) and the number of rows."""
    return fitted.log_likelihood, fitted.degrees_of_freedom, fitted.data.outcomes.count()


def predictive_log_likelihood(fit: Fit, weights: DataFrame) -> float:
    """The log-likelihood of rows with other weights (rowId, w) at the fit; risk sets and strata are those of the weights."""
    return log_likelihood(fit.data, fit.frame(), 1, weights, predictive=True, ranges=fit.control.ranges).first()["value"]
