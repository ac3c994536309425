"""Intervals, profiles, variances, residuals and tests of fits."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import survival
from ..operators.likelihood import weighted_rows
from ..operators.score import mean_linear_predictor
from .fit import Fit, fit_tasks
from .models import Model
from .priors import PriorSet


def vcov(fitted: Fit, covariates: Sequence[int] | None = None) -> tuple[list[int], np.ndarray]:
    """The inverse information, over all coefficients or over some of them alone."""
    known = list(fitted.information_ids or fitted.ids)
    ids = known if covariates is None else sorted(covariates)
    if missing := [c for c in ids if c not in known]:
        raise ValueError(f"the fit has no information on covariates {missing}")
    at = [known.index(c) for c in ids]
    return ids, np.linalg.inv(fitted.information[np.ix_(at, at)])


def standard_errors(fitted: Fit, covariates: Sequence[int] | None = None) -> dict[int, float]:
    ids, v = vcov(fitted, covariates)
    return dict(zip(ids, np.sqrt(np.diag(v)).tolist(), strict=True))


def wald_intervals(fitted: Fit, covariates: Sequence[int] | None = None, level: float = 0.95) -> dict[int, tuple[float, float]]:
    z = NormalDist().inv_cdf((1 + level) / 2)
    se = standard_errors(fitted, covariates)
    return {c: (fitted.betas[c] - z * s, fitted.betas[c] + z * s) for c, s in se.items()}


def _profile(fitted: Fit, points: Sequence[tuple[int, float]], starts: Sequence[Mapping[int, float]] | None = None, penalty: bool = True) -> list[tuple[float, float, dict[int, float]]]:
    """(value, derivative, coefficients) of the profile at each (covariate, point), fitted side by side."""
    if not points:
        return []
    starts = starts or [fitted.betas] * len(points)
    done = fit_tasks(fitted.data, [fitted.prior] * len(points), fitted.ids, [{**s, c: x} for (c, x), s in zip(points, starts, strict=True)], fitted.control, fitted.weights, [fitted.fixed | {c} for c, _ in points])
    out = []
    for d, (c, _) in zip(done, points, strict=True):
        good = d["flag"] == "SUCCESS" and math.isfinite(d["ll"])
        value = d["ll"] + (fitted.prior.log_density(d["betas"]) if penalty else 0.0) if good else math.nan
        out.append((value, d["g"].get(c, math.nan), d["betas"]))
    return out


def profile_likelihood(fitted: Fit, covariate: int, points: Sequence[float], penalty: bool = True, derivatives: bool = False) -> DataFrame:
    """(point, value[, derivative]): the likelihood maximised over the other coefficients, at each point."""
    if derivatives and fitted.prior.default.regularized and penalty:
        raise ValueError("derivatives need a flat prior")
    got = _profile(fitted, [(covariate, x) for x in points], penalty=penalty)
    rows = [(float(x), v, *([d] if derivatives else [])) for x, (v, d, _) in zip(points, got, strict=True)]
    return fitted.data.spark.createDataFrame(rows, "point double, value double" + ", derivative double" * derivatives)


def adaptive_profile(fitted: Fit, covariate: int, bounds: tuple[float, float], tolerance: float = 1e-3, grid: int = 10, rounds: int = 20) -> list[tuple[float, float]]:
    """Points of the profile between bounds: a grid, then more where straight lines between the points could be wrong by more
    than the tolerance, a concave function lying below its tangents. Each round's new points are fitted side by side."""
    xs = sorted({*np.linspace(*bounds, grid).tolist(), *([fitted.betas[covariate]] if bounds[0] < fitted.betas[covariate] < bounds[1] else [])})
    known = {x: (v, d) for x, (v, d, _) in zip(xs, _profile(fitted, [(covariate, x) for x in xs]), strict=True) if math.isfinite(v)}
    for _ in range(rounds):
        xs, new = sorted(known), []
        for a, b in zip(xs[:-1], xs[1:], strict=True):
            (va, da), (vb, db) = known[a], known[b]
            if da - db > 1e-12:
                x = (vb - va + da * a - db * b) / (da - db)
                if a < x < b and va + da * (x - a) - (va + (vb - va) * (x - a) / (b - a)) > tolerance:
                    new.append(x)
        if not new:
            break
        known |= {x: (v, d) for x, (v, d, _) in zip(new, _profile(fitted, [(covariate, x) for x in new]), strict=True) if math.isfinite(v)}
        if not any(x in known for x in new):
            break
    return [(x, known[x][0]) for x in sorted(known)]


def profile_intervals(fitted: Fit, covariates: Sequence[int], level: float = 0.95, allow_regularized: bool = False, penalty: bool = True, tolerance: float = 1e-3) -> dict[int, tuple[float, float]]:
    """Where the profile falls below its top by half the chi-square quantile; NaN where it doesn't. The ends of all covariates
    are bracketed and then narrowed (regula falsi, Illinois) in the same jobs."""
    if not 0.01 <= level <= 0.99:
        raise ValueError("level must be between 0.01 and 0.99")
    for c in covariates:
        if c in fitted.fixed:
            raise ValueError(f"covariate {c} is fixed")
        if fitted.prior.of(c).regularized and not allow_regularized:
            raise ValueError(f"covariate {c} has a prior: its interval needs allow_regularized")
    threshold = NormalDist().inv_cdf((1 + level) / 2) ** 2 / 2
    top = fitted.log_likelihood + (fitted.log_prior if penalty else 0.0)
    ends = [(c, side) for c in covariates for side in (-1, 1)]
    width = _first_steps(fitted, covariates, threshold)
    step = {e: width[e[0]] for e in ends}
    near = {e: (fitted.betas[e[0]], threshold) for e in ends}  # the excess over the limit is positive inside
    far: dict[tuple[int, int], tuple[float, float]] = {}
    failed: set[tuple[int, int]] = set()
    for _ in range(20):
        todo = [e for e in ends if e not in far and e not in failed]
        if not todo:
            break
        xs = {e: near[e][0] + e[1] * step[e] for e in todo}
        for e, (v, _, _) in zip(todo, _profile(fitted, [(e[0], xs[e]) for e in todo], penalty=penalty), strict=True):
            excess = v - top + threshold
            if math.isnan(excess):
                failed.add(e)
            elif excess < 0:
                far[e] = (xs[e], excess)
            else:
                near[e], step[e] = (xs[e], excess), 2 * step[e]
    found = {}
    for _ in range(40):
        todo = [e for e in far if e not in found]
        if not todo:
            break
        xs = {}
        for e in todo:
            (a, fa), (b, fb) = near[e], far[e]
            xs[e] = (a * fb - b * fa) / (fb - fa)
        for e, (v, _, _) in zip(todo, _profile(fitted, [(e[0], xs[e]) for e in todo], penalty=penalty), strict=True):
            excess = v - top + threshold
            if abs(excess) < tolerance or abs(near[e][0] - far[e][0]) < 1e-9 or math.isnan(excess):
                found[e] = xs[e]
            elif excess > 0:
                near[e], far[e] = (xs[e], excess), (far[e][0], far[e][1] / 2)
            else:
                far[e], near[e] = (xs[e], excess), (near[e][0], near[e][1] / 2)
    return {c: (found.get((c, -1), math.nan), found.get((c, 1), math.nan)) for c in covariates}


def _first_steps(fitted: Fit, covariates: Sequence[int], threshold: float) -> dict[int, float]:
    """Where the quadratic approximation has its ends, a little beyond; a tenth of the estimate where there is none."""
    out = {c: 0.1 * max(abs(fitted.betas[c]), 0.01) for c in covariates}
    try:
        se = standard_errors(fitted)
    except np.linalg.LinAlgError:
        return out
    return {c: 1.05 * math.sqrt(2 * threshold) * se[c] if math.isfinite(se[c]) and se[c] < 10 else out[c] for c in covariates}


def residuals(fitted: Fit, covariate: int | None = None) -> DataFrame:
    """Schoenfeld residuals of a Cox fit with one covariate, in the order of strata and times."""
    _one_cox(fitted)
    covariate = fitted.ids[0] if covariate is None else covariate
    rows = weighted_rows(fitted.data, fitted.frame())
    entries = fitted.data.covariates.filter(F.col("covariateId") == covariate)
    return survival.schoenfeld(rows, entries, fitted.control.ranges).orderBy("stratumId", "time", "rowId")


def _one_cox(fitted: Fit) -> None:
    if fitted.data.model is not Model.COX or len(fitted.ids) != 1:
        raise ValueError("only for Cox models with one covariate")


def test_proportionality(fitted: Fit, transform: str | Callable[[Column], Column] = "identity") -> dict[str, float]:
    """The score test that the covariate's effect changes with time; transform: of the time, by name or as a function of its column."""
    _one_cox(fitted)
    scale = max(1.0, float(fitted.information[0, 0]))
    if abs(fitted.gradient[fitted.ids[0]]) > 1e-5 * scale:
        raise ValueError("the fit is not at its mode")
    rows = weighted_rows(fitted.data, fitted.frame())
    return survival.proportionality(rows, fitted.data.covariates, transform, fitted.control.ranges).first().asDict()


test_proportionality.__test__ = False  # a statistical test


def baseline(fitted: Fit) -> DataFrame:
    """The survival curve at the covariates' means, strata taken together."""
    rows = weighted_rows(fitted.data, fitted.frame())
    mean = mean_linear_predictor(fitted.data, fitted.frame().select("covariateId", "beta")).first()["value"]
    return survival.baseline_survival(rows, mean, fitted.control.ranges)


def non_separable(fitted: Fit, refit, rounds: int = 10) -> Fit:
    """Fits again without the coefficients that the data leave undetermined, which end as NaN."""
    lost: set[int] = set()
    for _ in range(rounds):
        diag = np.diag(fitted.information) if fitted.information.size else np.zeros(0)
        bad = {c for k, c in enumerate(fitted.information_ids or fitted.ids) if k < len(diag) and (not math.isfinite(fitted.betas[c]) or diag[k] < 1e-8 or abs(fitted.betas[c]) > 15)}
        if not bad:
            break
        lost |= bad
        fitted = refit([c for c in fitted.ids if c not in lost])
    return replace(fitted, betas=dict(sorted({**fitted.betas, **dict.fromkeys(lost, math.nan)}.items())))


def log_prior_of(fitted: Fit, prior: PriorSet) -> float:
    return prior.log_density(fitted.betas)


def mse(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row, value: the mean squared error of (covariateId, estimate) against (covariateId, logRr)."""
    return estimates.join(truth, "covariateId").agg(F.avg(F.pow(F.col("estimate") - F.col("logRr"), 2)).alias("value"))


def coverage(intervals: DataFrame, truth: DataFrame) -> DataFrame:
    """One row, value: the share of (covariateId, lower, upper) that cover (covariateId, logRr)."""
    inside = (F.col("lower") <= F.col("logRr")) & (F.col("logRr") <= F.col("upper"))
    return intervals.join(truth, "covariateId").agg(F.avg(inside.cast("double")).alias("value"))
