"""Log-likelihood, gradient and information over rows that carry their few covariates as columns.

A fit with few covariates evaluates the same rows again and again. Here a row holds its covariates in columns, made once, and an
iteration is one scan: sums of the row's weight times products of its columns, by group (stratum, or distinct time within the
stratum) and then over groups. No iteration joins entries to rows or predictors back to them. Coefficients come as a small table
with a row for each task, so that the generated code of all iterations is the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import log_factorial, logistic, softplus
from ..plans.data import RegressionData
from ..plans.models import INTERCEPT_ID, Model
from .survival import Running, range_cuts, running_sums

#: Fits with so many covariates at most go this way: sums grow with their square.
MOST = 12


class Moments(NamedTuple):
    """What an iteration learns at a task's coefficients. third: the derivative of the last covariate's information along it.
    score: the sum of w * y * xb. moved and size: the sums of w * |xb - xb before| and w * |xb|. NaN where not asked for."""

    level: float
    gradient: np.ndarray
    information: np.ndarray
    third: float = math.nan
    score: float = math.nan
    moved: float = math.nan
    size: float = math.nan


@dataclass(frozen=True)
class TaskWeights:
    """Weights of each task's own, as a function of the task's number (a column) and of columns of the outcomes, evaluated row by row
    inside an aggregation: no table of rows times tasks is ever made."""

    of: Callable[[Column], Column]
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class DenseRows:
    """rows: stratumId, time, y, offset, cw, x0, x1, ... in the order of ids, and w or what the tasks' own weights read."""

    data: RegressionData
    ids: Sequence[int]
    rows: DataFrame
    own: TaskWeights | None
    cuts: Sequence[float]


def dense_rows(data: RegressionData, ids: Sequence[int], weights: DataFrame | TaskWeights | None = None, ranges: int | None = None) -> DenseRows:
    """The rows of data, persisted; weights (rowId, w), or those of tasks. Unpersist ``rows`` after use."""
    entries = data.covariates.filter(F.col("covariateId").isin([int(c) for c in ids]))
    of = [F.sum(F.when(F.col("covariateId") == c, F.col("covariateValue"))).alias(f"x{k}") for k, c in enumerate(ids) if c != INTERCEPT_ID]
    outcomes, own = data.outcomes, weights if isinstance(weights, TaskWeights) else None
    kept = ["rowId", "stratumId", "time", "y", "offset", *(["censorWeights"] if "censorWeights" in outcomes.columns else []), *(["weights"] if weights is None and "weights" in outcomes.columns else [])]
    read = [c for c in own.columns if c not in kept] if own else []
    rows = outcomes.select(*kept, *read)
    if of:
        rows = rows.join(entries.groupBy("rowId").agg(*of), "rowId", "left")
    columns = {f"x{k}": F.lit(1.0) if c == INTERCEPT_ID else F.coalesce(f"x{k}", F.lit(0.0)) for k, c in enumerate(ids)}
    if weights is not None and not own:
        rows = rows.join(weights, "rowId", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    elif not own:
        rows = rows.withColumn("w", F.coalesce("weights", F.lit(1.0)) if "weights" in kept else F.lit(1.0))
    cw = F.coalesce("censorWeights", F.lit(1.0)) if "censorWeights" in kept else F.lit(1.0)
    by_row = data.model is Model.COX_RAW or (own and "rowId" in own.columns)
    used = ["stratumId", "time", "y", "offset", "cw", *columns, *(read if own else ["w"]), *(["rowId"] if by_row else [])]
    rows = rows.withColumns({**columns, "cw": cw}).select(*used).persist()
    return DenseRows(data, list(ids), rows, own, range_cuts(rows, ["stratumId"], ranges, untied=data.model is Model.COX_RAW) if data.model.survival else ())


def _products(columns: Sequence[Column], weight: Column) -> list[Column]:
    return [F.sum(weight * a * b) for k, a in enumerate(columns) for b in columns[k:]]


def dense_moments(dense: DenseRows, betas: Sequence[Mapping[int, float]], tasks: Sequence[int] | None = None, before: Sequence[Mapping[int, float]] | None = None, third: bool = False, score: bool = False) -> list[Moments]:
    """The moments at each set of coefficients, in one job. tasks: the numbers of the tasks whose own weights go with them; before: earlier
    coefficients, for ``moved`` and ``size``; third, score: whether these are wanted too."""
    data, p, spark = dense.data, len(dense.ids), dense.data.spark
    listed = lambda b: [float(b[c]) for c in dense.ids]
    values = [(t, tasks[t] if tasks else t, listed(b), listed((before or betas)[t])) for t, b in enumerate(betas)]
    coefs = F.broadcast(spark.createDataFrame(values, "task int, own int, b array<double>, before array<double>"))  # a row for each task
    numbers = F.sequence(F.lit(0), F.lit(len(values) - 1)) if len(values) > 1 else F.array(F.lit(0))
    rows = dense.rows.withColumn("task", F.explode(numbers)).join(coefs, "task")
    if dense.own:
        rows = rows.withColumn("w", dense.own.of(F.col("own")))
        if not data.model.stratified:  # rows without weight stand in their strata's sums
            rows = rows.filter("w <> 0")
    x = [F.col(f"x{k}") for k in range(p)]
    predictor = lambda b: sum((F.col(b)[k] * x[k] for k in range(p)), F.lit(0.0) if data.model.own_time else F.col("offset"))
    rows = rows.withColumn("xb", predictor("b"))
    y, w, xb = F.col("y"), F.col("w"), F.col("xb")
    more = {"score": w * y * xb} if score else {}
    if before is not None:
        rows = rows.withColumn("was", predictor("before"))
        more |= {"moved": w * F.abs(xb - F.col("was")), "size": w * F.abs(xb)}
    names = [*[f"g{k}" for k in range(p)], *[f"h{k}_{n}" for k in range(p) for n in range(k, p)]]
    if data.model in (Model.LS, Model.LR, Model.PR):
        if data.model is Model.LS:
            a, b, c, level = 2 * w * (y - xb), 2 * w, F.lit(0.0), -w * (y - xb) * (y - xb)
        elif data.model is Model.LR:
            mean = logistic(xb)
            a, b, c, level = w * (y - mean), w * mean * (1 - mean), w * mean * (1 - mean) * (1 - 2 * mean), w * (y * xb - softplus(xb))
        else:
            a, b, c, level = w * (y - F.exp(xb)), w * F.exp(xb), w * F.exp(xb), w * (y * xb - F.exp(xb) - log_factorial(y))
        more |= {"third": c * x[-1] * x[-1] * x[-1]} if third else {}
        rows = rows.select("task", *x, a.alias("a"), b.alias("b"), level.alias("level"), *[v.alias(n) for n, v in more.items()])
        sums = [F.sum(F.col("a") * v) for v in x] + _products(x, F.col("b"))
        out = rows.groupBy("task").agg(F.sum("level").alias("level"), *[s.alias(n) for s, n in zip(sums, names, strict=True)], *[F.sum(n).alias(n) for n in more])
        return _collected(out, len(values), p)
    groups, event = _strata(rows, data.model, x, more, third) if data.model.stratified else _times(rows, data.model, x, dense.cuts, more, third), F.col("n")
    mean = [F.col(f"s{k}") / F.col("D") for k in range(p)]
    # Groups without events add nothing but to sums over rows, and may have no one at risk.
    groups = groups if more else groups.filter("n <> 0 or level <> 0")
    some = lambda v: F.sum(F.when((event != 0) | (F.col("level") != 0), v).otherwise(0.0))
    sums = [some(F.col(f"e{k}") - event * mean[k]) for k in range(p)]
    sums += [some(event * (F.col(f"s{k}_{n}") / F.col("D") - mean[k] * mean[n])) for k in range(p) for n in range(k, p)]
    level = some(F.col("level") - event * (F.log("D") + F.col("top")))
    last = p - 1
    cubes = {"third": some(event * (F.col("st") / F.col("D") - 3 * F.col(f"s{last}_{last}") / F.col("D") * mean[last] + 2 * mean[last] * mean[last] * mean[last]))} if third else {}
    extra = {**{n: F.sum(n) for n in more}, **cubes}
    return _collected(groups.groupBy("task").agg(level.alias("level"), *[s.alias(n) for s, n in zip(sums, names, strict=True)], *[v.alias(n) for n, v in extra.items()]), len(values), p)


def _weighted(x: Sequence[Column], weight: Column, name: str, third: bool = False) -> list[Column]:
    """Sums of weight, weight * x and weight * x * x by the names of ``dense_moments``, and that of the last x's cubes."""
    p = len(x)
    out = [F.sum(weight).alias(name)] + [F.sum(weight * x[k]).alias(f"{name}{k}") for k in range(p)]
    out += [F.sum(weight * x[-1] * x[-1] * x[-1]).alias(f"{name}t")] if third else []
    return out + [F.sum(weight * x[k] * x[n]).alias(f"{name}{k}_{n}") for k in range(p) for n in range(k, p)]


def _strata(rows: DataFrame, model: Model, x: Sequence[Column], more: Mapping[str, Column], third: bool) -> DataFrame:
    """By task and stratum: n, D, top, level, and the sums s over the stratum and e over events. A shift of xb by a constant for each
    stratum cancels; the highest avoids overflow."""
    keys, y, w, xb = ["task", "stratumId"], F.col("y"), F.col("w"), F.col("xb")
    top = rows.groupBy(*keys).agg(F.max("xb").alias("top"))
    e = F.exp(xb - F.col("top")) * (F.col("time") if model is Model.SCCS else F.lit(1.0))
    level = w * y * xb
    if model is Model.SCCS:
        level = level + w * y * F.log("time")
    if model is Model.CPR:
        level = level - w * log_factorial(y)
    events = [F.sum(w * y * v).alias(f"e{k}") for k, v in enumerate(x)]
    out = rows.join(top, keys).withColumn("e", e).groupBy(*keys).agg(F.first("top").alias("top"), F.sum(y * w).alias("n"), F.sum(level).alias("level"), *events, *_weighted(x, F.col("e"), "s", third), *[F.sum(v).alias(n) for n, v in more.items()])
    return out.withColumnRenamed("s", "D")


def _times(rows: DataFrame, model: Model, x: Sequence[Column], cuts: Sequence[float], more: Mapping[str, Column], third: bool) -> DataFrame:
    """By task, stratum and distinct time: n, D, top, level, the sums s over those at risk and e over events."""
    keys, p = ["task", "stratumId"], len(x)
    event, rival = F.when(F.col("y") == 1, F.col("w")).otherwise(0.0), F.col("y") > 1
    rows = rows.withColumns({"r": F.col("w") * F.exp("xb"), "event": event})
    time = ["time", "rowId"] if model is Model.COX_RAW else ["time"]  # without ties: equal times go by rowId
    fine_gray = model is Model.FGR
    sums = [*_weighted(x, F.col("r"), "r", third), *[F.sum(v).alias(n) for n, v in more.items()], F.sum("event").alias("n"), F.sum(F.col("event") * F.col("xb")).alias("level"), *[F.sum(F.col("event") * v).alias(f"e{k}") for k, v in enumerate(x)], F.max("cw").alias("cw")]
    if fine_gray:
        sums += _weighted(x, F.when(rival, F.col("r") / F.col("cw")).otherwise(0.0), "c", third)
    times = rows.groupBy(*keys, *time).agg(*sums)
    parts = ["", *[str(k) for k in range(p)], *[f"{k}_{n}" for k in range(p) for n in range(k, p)], *(["t"] if third else [])]
    running = {f"s{i}": Running(f"r{i}") for i in parts} | ({f"q{i}": Running(f"c{i}", falling=False, own=False) for i in parts} if fine_gray else {})
    times = running_sums(times, keys, running, cuts, tie="rowId" if model is Model.COX_RAW else None)
    total = lambda i: (F.col(f"s{i}") + F.col("cw") * F.col(f"q{i}")) if fine_gray else F.col(f"s{i}")
    return times.select("task", "n", "level", F.lit(0.0).alias("top"), total("").alias("D"), *[total(i).alias(f"s{i}") for i in parts if i], *[f"e{k}" for k in range(p)], *more)


def _collected(sums: DataFrame, tasks: int, p: int) -> list[Moments]:
    out = [Moments(0.0, np.zeros(p), np.zeros((p, p)), 0.0, 0.0, 0.0, 0.0) for _ in range(tasks)]
    for r in sums.collect():  # a row for each task
        nan = lambda v: np.nan if v is None else v
        g = np.array([nan(r[f"g{k}"]) for k in range(p)], float)
        h = np.zeros((p, p))
        for k in range(p):
            for n in range(k, p):
                h[k, n] = h[n, k] = nan(r[f"h{k}_{n}"])
        out[r["task"]] = Moments(float(nan(r["level"])), g, h, **{n: float(nan(r[n])) for n in ("third", "score", "moved", "size") if n in sums.columns})
    return out


