"""Log-likelihood, gradient and information of all models at given coefficients, as aggregations.

For every model the gradient is a sum over rows of a weight times the row's entries, and the information is a sum over
rows of another weight times pairs of entries, less, for grouped models, a sum over groups (strata, risk sets) of the
group's events times the outer product of its mean. All tasks (sets of coefficients) go through one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import log_factorial, logistic, softplus
from ..plans.data import RegressionData, dealt
from ..plans.models import INTERCEPT_ID, Model
from .dense import TaskWeights
from .exact import exact_moments
from .gram import risk_set_products, weighted_products
from .score import linear_predictors
from .survival import Running, range_cuts, running_sums

#: How running sums over time are dealt: a number of ranges, the times at which they end, or None for as many as the times need.
Ranges = int | Sequence[float] | None
_GROUP = ["task", "stratumId"]
_TIME = ["task", "stratumId", "time"]
#: With so many covariates at most, products are columns of one aggregation; beyond, they are arrays by pairs of blocks.
FEW = 40


def weighted_rows(data: RegressionData, betas: DataFrame, tasks: int = 1, weights: DataFrame | TaskWeights | None = None) -> DataFrame:
    """Linear predictors with the weight w of each row: of weights (rowId, w), of the tasks' own, else of the data, else 1."""
    rows = linear_predictors(data, betas, tasks)
    if isinstance(weights, TaskWeights):
        rows = rows.withColumn("w", weights.of(F.col("task")))
    elif weights is not None:
        rows = rows.drop("w").join(weights, "rowId", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    elif "weights" in data.outcomes.columns:
        rows = rows.withColumn("w", F.coalesce("weights", F.lit(1.0)))
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    return rows


@dataclass(frozen=True)
class Terms:
    """rows: task, rowId, a (gradient weight), b (information weight) and ll (the rows' part of the log-likelihood).
    groups: task, stratumId[, time], n, and ll; means go with the rows' e. None for independent rows."""

    rows: DataFrame
    groups: DataFrame | None


def terms(data: RegressionData, rows: DataFrame, ranges: Ranges = None, predictive: bool = False, tasks: int | None = None) -> Terms:
    """The weights of the model at the linear predictors of rows (see weighted_rows). predictive: without terms in y alone.
    tasks: how many tasks rows have, if it is known."""
    model, y, xb, w = data.model, F.col("y"), F.col("xb"), F.col("w")
    fixed = F.lit(0.0) if predictive else log_factorial(y)
    if model is Model.LS:
        return Terms(rows.withColumns({"a": 2 * w * (y - xb), "b": 2 * w, "ll": -w * (y - xb) * (y - xb)}), None)
    if model is Model.LR:
        p = logistic(xb)
        return Terms(rows.withColumns({"a": w * (y - p), "b": w * p * (1 - p), "ll": w * (y * xb - softplus(xb))}), None)
    if model is Model.PR:
        return Terms(rows.withColumns({"a": w * (y - F.exp(xb)), "b": w * F.exp(xb), "ll": w * (y * xb - F.exp(xb) - fixed)}), None)
    if model.stratified:
        # A shift of xb by a constant for each stratum cancels; the highest avoids overflow.
        rows = dealt(rows, data.size * (tasks or 1), *_groups_of(tasks))
        top = rows.groupBy(*_GROUP).agg(F.max("xb").alias("top"), F.sum(y * w).alias("n"))
        e = F.exp(xb - F.col("top")) * (F.col("time") if model is Model.SCCS else F.lit(1.0))
        rows = rows.join(top, _GROUP).withColumn("e", e)
        groups = rows.groupBy(*_GROUP, "top", "n").agg(F.sum("e").alias("D"))
        groups = groups.withColumn("gll", -F.col("n") * (F.log("D") + F.col("top")))
        rows = rows.drop("top", "n").join(groups, _GROUP)
        ll = w * y * xb
        if model is Model.SCCS and not predictive:
            ll = ll + w * y * F.log("time")
        if model is Model.CPR:
            ll = ll - w * fixed
        share = F.col("n") * F.col("e") / F.col("D")
        return Terms(rows.withColumns({"a": w * y - share, "b": share, "ll": ll}), groups)
    return _risk_terms(data, rows, ranges, tasks)


def _groups_of(tasks: int | None) -> list[str]:
    """The columns that tell strata of tasks apart. Spark takes the constant of an only task out of keys, so that rows dealt by it
    would be dealt again."""
    return ["stratumId"] if tasks == 1 else _GROUP


def _cuts(data: RegressionData, ranges: Ranges) -> Sequence[float]:
    return range_cuts(data.outcomes, ["stratumId"], ranges, untied=data.model is Model.COX_RAW) if ranges is None or isinstance(ranges, int) else ranges


def _risk_terms(data: RegressionData, rows: DataFrame, ranges: Ranges, tasks: int | None) -> Terms:
    y, w = F.col("y"), F.col("w")
    event, rival = F.when(y == 1, w).otherwise(0.0), F.when(y > 1, w).otherwise(0.0)
    fine_gray = data.model is Model.FGR
    cw = F.coalesce("censorWeights", F.lit(1.0)) if fine_gray else F.lit(1.0)
    rows = rows.withColumns({"e": w * F.exp("xb"), "cw": cw})
    tie = "rowId" if data.model is Model.COX_RAW else None  # no ties: equal times go by rowId
    time = [*_TIME, *([tie] if tie else [])]
    size, by = data.size * (tasks or 1) if tie else 0, _groups_of(tasks)  # without ties there are fewer times than rows
    cuts = _cuts(data, ranges)
    competing = F.sum(F.when(y > 1, F.col("e") / F.col("cw")).otherwise(0.0)) if fine_gray else F.lit(0.0)
    times = rows.groupBy(*time).agg(F.sum("e").alias("E"), F.sum(event).alias("n"), competing.alias("C"), F.max("cw").alias("cwt"))
    times = running_sums(times, by, {"R": Running("E"), "Q": Running("C", falling=False, own=False)}, cuts, tie, size)
    times = times.withColumn("D", F.col("R") + F.col("cwt") * F.col("Q")).withColumns({"h": F.when(F.col("n") > 0, F.col("n") / F.col("D")).otherwise(0.0)})
    times = times.withColumn("hc", F.col("h") * F.col("cwt"))
    times = running_sums(times, by, {"hazard": Running("h", falling=False), "later": Running("hc", own=False)}, cuts, tie, size)
    groups = times.withColumn("gll", F.when(F.col("n") > 0, -F.col("n") * F.log("D")).otherwise(0.0))
    same = ["task", tie] if tie else time  # without ties a row is a time of its own, and rows stand by their ids
    rows = rows.join(groups.select(*same, "hazard", "later"), same)
    share = F.col("e") * (F.col("hazard") + (F.when(rival > 0, F.col("later") / F.col("cw")).otherwise(0.0) if fine_gray else F.lit(0.0)))
    return Terms(rows.withColumns({"a": event - share, "b": share, "ll": event * F.col("xb")}), groups)


def log_likelihood(data: RegressionData, betas: DataFrame, tasks: int = 1, weights: DataFrame | TaskWeights | None = None, predictive: bool = False, ranges: Ranges = None) -> DataFrame:
    """(task, value)."""
    if data.model is Model.CLR_EXACT:
        return _exact(data, betas, [], tasks, weights).filter("i is null").select("task", "value")
    t = terms(data, weighted_rows(data, betas, tasks, weights), ranges, predictive, tasks)
    parts = t.rows.groupBy("task").agg(F.sum("ll").alias("v"))
    if t.groups is not None:
        parts = parts.union(t.groups.groupBy("task").agg(F.sum("gll").alias("v")))
    return parts.groupBy("task").agg(F.sum("v").alias("value"))


def entries(data: RegressionData, covariates: list[int] | None = None) -> DataFrame:
    """(rowId, i, x): the rows' entries, with the intercept's; of the given covariates only."""
    rows = data.covariates.select("rowId", F.col("covariateId").alias("i"), F.col("covariateValue").alias("x"))
    if covariates is not None:
        rows = rows.filter(F.col("i").isin([int(c) for c in covariates]))
    if data.has_intercept and (covariates is None or INTERCEPT_ID in covariates):
        rows = rows.union(data.outcomes.select("rowId", F.lit(INTERCEPT_ID).cast("long"), F.lit(1.0)))
    return rows


def gradient(data: RegressionData, betas: DataFrame, tasks: int = 1, weights: DataFrame | TaskWeights | None = None, ranges: Ranges = None) -> DataFrame:
    """(task, i, value) for all covariates at once."""
    if data.model is Model.CLR_EXACT:
        ids = [r[0] for r in data.covariates.select("covariateId").distinct().collect()]  # its moments are arrays over the covariates
        return _exact(data, betas, ids, tasks, weights).filter("i is not null and j is null").select("task", "i", "value")
    t = terms(data, weighted_rows(data, betas, tasks, weights), ranges, tasks=tasks)
    return _gradient(t, entries(data))


def _gradient(t: Terms, x: DataFrame) -> DataFrame:
    return t.rows.select("task", "rowId", "a").join(x, "rowId").groupBy("task", "i").agg(F.sum(F.col("a") * F.col("x")).alias("value"))


def _vectors(x: DataFrame) -> DataFrame:
    """(rowId, xs): a row's entries, sorted by covariate; as many as the chosen covariates at most."""
    return x.groupBy("rowId").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("xs"))


def _pairs(rows: DataFrame, weight: Column, covariates: Sequence[int], vector: str = "xs") -> DataFrame:
    """(task, i, j, value) with i <= j: the sums of weight * x_i * x_j."""
    if len(covariates) > FEW:
        return weighted_products(rows, weight, covariates, vector)
    p = rows.select("task", weight.alias("__w"), F.explode(vector).alias("p"), vector).select("task", "__w", "p", F.explode(vector).alias("q")).filter("p.i <= q.i")
    return p.groupBy("task", F.col("p.i").alias("i"), F.col("q.i").alias("j")).agg(F.sum(F.col("__w") * F.col("p.x") * F.col("q.x")).alias("value"))


def _group_pairs(data: RegressionData, t: Terms, x: DataFrame, covariates: list[int], ranges: Ranges, tasks: int) -> DataFrame:
    """(task, i, j, value): minus the sums over groups of n * mean_i * mean_j."""
    if data.model.stratified:
        each = dealt(t.rows.select("task", "rowId", "stratumId", "e", "n", "D").join(x, "rowId"), data.size * tasks, *_groups_of(tasks))
        sums = each.groupBy(*_GROUP, "n", "D", "i").agg(F.sum(F.col("e") * F.col("x")).alias("s"))
        means = sums.groupBy(*_GROUP, "n").agg(F.collect_list(F.struct("i", (F.col("s") / F.col("D")).alias("x"))).alias("xs"))
        return _pairs(means, -F.col("n"), covariates)
    tie = ["rowId"] if data.model is Model.COX_RAW else []
    time = [*_TIME, *tie]
    if len(covariates) > FEW:
        e, fine_gray = F.col("e") * F.col("x"), data.model is Model.FGR
        rival = F.when(F.col("y") > 1, e / F.col("cw")).otherwise(0.0)
        each = t.rows.select(*_TIME, "rowId", "e", "y", "cw").join(x, "rowId").groupBy(*time, "i").agg(F.sum(e).alias("x"), F.sum(rival).alias("c"))
        each = each.groupBy(*time).agg(F.collect_list(F.struct("i", "x", "c")).alias("xs"))  # as many as covariates
        times = t.groups.select(*time, "n", "D", "cwt").join(each, time, "left")
        return risk_set_products(times, covariates, _cuts(data, ranges), *tie, fine_gray=fine_gray)
    names = {i: f"c{k}" for k, i in enumerate(covariates)}
    wide = t.rows.select(*_TIME, "rowId", "e", "y", "cw").join(x, "rowId")
    of = lambda i, v: F.sum(F.when(F.col("i") == i, v).otherwise(0.0))
    e, rival = F.col("e") * F.col("x"), F.when(F.col("y") > 1, F.col("e") * F.col("x") / F.col("cw")).otherwise(0.0)
    fine_gray = data.model is Model.FGR
    sums = wide.groupBy(*time).agg(*[of(i, e).alias(f"E{c}") for i, c in names.items()], *[of(i, rival).alias(f"C{c}") for i, c in names.items() if fine_gray])
    times = t.groups.select(*time, "n", "D", "cwt").join(sums, time, "left").na.fill(0.0)
    running = {f"R{c}": Running(f"E{c}") for c in names.values()} | ({f"Q{c}": Running(f"C{c}", falling=False, own=False) for c in names.values()} if fine_gray else {})
    times = running_sums(times, _GROUP, running, _cuts(data, ranges), *tie).filter("n > 0")
    mean = lambda c: (F.col(f"R{c}") + (F.col("cwt") * F.col(f"Q{c}") if fine_gray else F.lit(0.0))) / F.col("D")
    means = times.select("task", F.col("n").alias("w"), *[mean(c).alias(c) for c in names.values()])
    # One aggregation of all products, without a row for each pair.
    pairs = [(i, j) for i in covariates for j in covariates if i <= j]
    total = means.groupBy("task").agg(*[F.sum(-F.col("w") * F.col(names[i]) * F.col(names[j])).alias(f"p{k}") for k, (i, j) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col(f"p{k}").alias("value")) for k, (i, j) in enumerate(pairs)])
    return total.select("task", F.explode(each).alias("v")).select("task", "v.*")


def information(data: RegressionData, betas: DataFrame, covariates: list[int], tasks: int = 1, weights: DataFrame | TaskWeights | None = None, ranges: Ranges = None) -> DataFrame:
    """(task, i, j, value), i <= j: minus the matrix of second derivatives, over the given covariates (0: the intercept)."""
    t = terms(data, weighted_rows(data, betas, tasks, weights), ranges, tasks=tasks)
    return _information(data, t, covariates, ranges, tasks)


def _information(data: RegressionData, t: Terms, covariates: list[int], ranges: Ranges, tasks: int) -> DataFrame:
    covariates = sorted(covariates)
    x = entries(data, covariates)
    out = _pairs(t.rows.select("task", "rowId", "b").join(_vectors(x), "rowId"), F.col("b"), covariates)
    if t.groups is not None:
        out = out.union(_group_pairs(data, t, x, covariates, ranges, tasks)).groupBy("task", "i", "j").agg(F.sum("value").alias("value"))
    return out


def fit_moments(data: RegressionData, betas: DataFrame, covariates: list[int], tasks: int = 1, weights: DataFrame | TaskWeights | None = None, ranges: Ranges = None) -> DataFrame:
    """(task, i, j, value): log-likelihood (i, j null), gradient (j null) and information in one DataFrame."""
    if data.model is Model.CLR_EXACT:
        return _exact(data, betas, covariates, tasks, weights)
    t = terms(data, weighted_rows(data, betas, tasks, weights), ranges, tasks=tasks)
    null = F.lit(None).cast("long")
    level = t.rows.groupBy("task").agg(F.sum("ll").alias("value")).select("task", null.alias("i"), null.alias("j"), "value")
    if t.groups is not None:
        level = level.union(t.groups.groupBy("task").agg(F.sum("gll").alias("value")).select("task", null, null, "value"))
    slope = _gradient(t, entries(data, covariates)).select("task", "i", null.alias("j"), "value")
    return level.union(slope).union(_information(data, t, covariates, ranges, tasks))


def _exact(data: RegressionData, betas: DataFrame, covariates: Sequence[int], tasks: int, weights: DataFrame | TaskWeights | None) -> DataFrame:
    return exact_moments(weighted_rows(data, betas, tasks, weights), _vectors(entries(data, list(covariates))), covariates, size=data.size * tasks)


def convergence_sums(data: RegressionData, betas: DataFrame, before: DataFrame | None, tasks: int = 1, weights: DataFrame | TaskWeights | None = None) -> DataFrame:
    """(task, score, moved, size): the sums of w * y * xb, and with the coefficients before those of w * |xb - xb before| and w * |xb|."""
    rows = weighted_rows(data, betas, tasks, weights)
    moved = F.lit(None).cast("double")
    if before is not None:
        rows = rows.join(linear_predictors(data, before, tasks).select("task", "rowId", F.col("xb").alias("was")), ["task", "rowId"])
        moved = F.sum(F.col("w") * F.abs(F.col("xb") - F.col("was")))
    return rows.groupBy("task").agg(F.sum(F.col("w") * F.col("y") * F.col("xb")).alias("score"), moved.alias("moved"), F.sum(F.col("w") * F.abs("xb")).alias("size"))


def majorizer_moments(data: RegressionData, betas: DataFrame, covariates: list[int], tasks: int = 1, weights: DataFrame | TaskWeights | None = None, ranges: Ranges = None) -> DataFrame:
    """As fit_moments, with a diagonal matrix that bounds the information: the sums of a row's weight times its entry's size
    times the sum of its entries' sizes. Its cost grows with the entries, not with pairs of them."""
    t = terms(data, weighted_rows(data, betas, tasks, weights), ranges, tasks=tasks)
    null, x = F.lit(None).cast("long"), entries(data, covariates)
    level = t.rows.groupBy("task").agg(F.sum("ll").alias("value"))
    if t.groups is not None:
        level = level.union(t.groups.groupBy("task").agg(F.sum("gll").alias("value")))
    sizes = x.groupBy("rowId").agg(F.sum(F.abs("x")).alias("size"))
    rows = t.rows.select("task", "rowId", "a", "b").join(sizes, "rowId").join(x, "rowId")
    both = rows.groupBy("task", "i").agg(F.sum(F.col("a") * F.col("x")).alias("g"), F.sum(F.col("b") * F.abs("x") * F.col("size")).alias("h"))
    slope = both.select("task", "i", null.alias("j"), F.col("g").alias("value"))
    return level.select("task", null.alias("i"), null.alias("j"), "value").union(slope).union(both.select("task", "i", "i", "h"))
