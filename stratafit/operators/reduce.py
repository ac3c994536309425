"""Descriptive reductions of the covariates. Zeros are implicit: denominators count all rows."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.data import RegressionData
from .selection import exact_quantile


def _x() -> Column:
    return F.col("covariateValue")


def _power(power: int):
    if power not in (0, 1, 2):
        raise ValueError("power must be 0, 1 or 2")
    return F.count_if(_x() != 0).cast("double") if power == 0 else F.sum(F.pow(_x(), F.lit(power)).cast("double"))


def reduce_covariates(data: RegressionData, power: int = 1) -> DataFrame:
    """(covariateId, value): the count, sum or sum of squares of each covariate's entries."""
    return data.covariates.groupBy("covariateId").agg(_power(power).alias("value"))


def reduce_by_stratum(data: RegressionData, covariate: int, power: int = 1) -> DataFrame:
    """(stratumId, value) of one covariate, 0 for strata without an entry."""
    entries = data.covariates.filter(F.col("covariateId") == covariate)
    rows = data.outcomes.select("rowId", "stratumId").join(entries, "rowId", "left")
    return rows.groupBy("stratumId").agg(F.coalesce(_power(power), F.lit(0.0)).alias("value"))


def reduce_by_covariate(data: RegressionData, covariate: int, group: int, power: int = 1) -> DataFrame:
    """(grp, value) of one covariate over the rows without (0) and with (1) the indicator covariate group."""
    members = data.covariates.filter(F.col("covariateId") == group)
    if not members.filter("covariateValue <> 1").isEmpty():
        raise ValueError("grouping covariate must be an indicator")
    entries = data.covariates.filter(F.col("covariateId") == covariate)
    rows = data.outcomes.select("rowId").join(members.select("rowId", F.lit(1).alias("grp")), "rowId", "left").join(entries, "rowId", "left")
    return rows.groupBy(F.coalesce("grp", F.lit(0)).cast("long").alias("grp")).agg(F.coalesce(_power(power), F.lit(0.0)).alias("value"))


def kinds(data: RegressionData) -> DataFrame:
    """(covariateId, type): indicator if all entries are 1, else sparse."""
    return data.covariates.groupBy("covariateId").agg(F.when(F.bool_and(_x() == 1), "indicator").otherwise("sparse").alias("type"))


def summary(data: RegressionData) -> DataFrame:
    """(covariateId, nzCount, nzMean, nzVar, type) over each covariate's entries."""
    n, mean = F.count("*"), F.avg(_x())
    spread = F.greatest((F.sum(_x() * _x()) - n * mean * mean) / n, F.lit(0.0))
    return data.covariates.groupBy("covariateId").agg(n.alias("nzCount"), mean.alias("nzMean"), spread.alias("nzVar"), F.when(F.bool_and(_x() == 1), "indicator").otherwise("sparse").alias("type"))


def correlation(data: RegressionData, threshold: float = 0.0) -> DataFrame:
    """(covariateId, correlation) with y over all rows; NaN where a variance isn't positive. threshold: of absolute values."""
    if data.model.survival:
        raise ValueError("correlation is not available for survival models")
    y = data.outcomes.agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    sums = data.covariates.join(data.outcomes.select("rowId", "y"), "rowId").groupBy("covariateId").agg(F.sum(_x()).alias("sx"), F.sum(_x() * _x()).alias("sxx"), F.sum(_x() * F.col("y")).alias("sxy"))
    rows = sums.join(F.broadcast(y), F.lit(True))  # one row
    n = F.col("n")
    vx, vy = F.col("sxx") / n - F.pow(F.col("sx") / n, 2), F.col("syy") / n - F.pow(F.col("sy") / n, 2)
    value = F.when((vx <= 0) | (vy <= 0), F.lit(float("nan"))).otherwise((F.col("sxy") / n - F.col("sx") * F.col("sy") / n / n) / F.sqrt(vx * vy))
    out = rows.select("covariateId", value.alias("correlation"))
    return out.filter(F.abs("correlation") > threshold) if threshold > 0 else out


def separability(data: RegressionData) -> DataFrame:
    """(covariateId, separable): whether all or none of an indicator's rows have the outcome; never for other covariates."""
    rows = data.covariates.join(data.outcomes.select("rowId", "y"), "rowId")
    sums = rows.groupBy("covariateId").agg(F.sum(_x() * F.col("y")).alias("s"), F.count("*").alias("n"), F.bool_and(_x() == 1).alias("indicator"))
    return sums.select("covariateId", (F.col("indicator") & ((F.col("s") == 0) | (F.col("s") == F.col("n")))).alias("separable"))


def warn_unseparable(data: RegressionData) -> None:
    if not kinds(data).filter("type <> 'indicator'").isEmpty():
        warnings.warn("separability is only known for indicator and intercept covariates", stacklevel=2)


def counts(data: RegressionData) -> DataFrame:
    """One row: n_rows, n_covariates, n_strata, mean_offset."""
    out = data.outcomes.agg(F.count("*").alias("n_rows"), F.count_distinct("stratumId").alias("n_strata"), F.avg("offset").alias("mean_offset"))
    return out.join(F.broadcast(data.covariates.agg(F.count_distinct("covariateId").alias("n_covariates"))), F.lit(True))


def quantile(df: DataFrame, column: str, q: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The exact quantile with linear interpolation at (n - 1) q; the median is the mean of the middle two."""
    return exact_quantile(df, column, q, by)


def default_variance(data: RegressionData) -> float:
    """The prior variance to start a search from: the squares of all entries, over covariates and over rows."""
    row = data.covariates.agg((F.sum(_x() * _x()) / F.count_distinct("covariateId")).alias("v")).first()
    return row["v"] / data.outcomes.count()


#: Kinds of scales that are quantiles of the absolute entries.
_QUANTILES = {"median": 0.5, "q95": 0.95}


def scale_factors(data: RegressionData, kind: str = "stdev") -> DataFrame:
    """(covariateId, scale): what entries are multiplied by; 1 for indicators.

    stdev: one over the population standard deviation with all rows; max, median, q95: one over that of the absolute entries.
    """
    indicator = F.bool_and(_x() == 1)
    if kind in _QUANTILES:
        rows = data.covariates.select("covariateId", F.abs(_x()).alias("size"))
        found = quantile(rows, "size", _QUANTILES[kind], ("covariateId",))
        flags = data.covariates.groupBy("covariateId").agg(indicator.alias("indicator"))
        return found.join(flags, "covariateId").select("covariateId", F.when(F.col("indicator"), 1.0).otherwise(1 / F.col("value")).alias("scale"))
    n = data.outcomes.count()
    value = {"stdev": 1 / F.sqrt(F.sum(_x() * _x()) / n - F.pow(F.sum(_x()) / n, 2)), "max": 1 / F.max(F.abs(_x()))}[kind]
    return data.covariates.groupBy("covariateId").agg(F.when(indicator, 1.0).otherwise(value).alias("scale"))


def normalized(data: RegressionData, kind: str = "stdev") -> RegressionData:
    """data with scaled entries; scales of repeated calls multiply."""
    scales = scale_factors(data, kind)
    rows = data.covariates.join(scales, "covariateId").select("rowId", "covariateId", (_x() * F.col("scale")).alias("covariateValue"))
    if data.scales is not None:
        before = data.scales.withColumnRenamed("scale", "before")
        scales = scales.join(before, "covariateId").select("covariateId", (F.col("scale") * F.col("before")).alias("scale"))
    return replace(data, covariates=rows, scales=scales)
