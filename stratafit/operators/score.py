"""Scores: sums of coefficients times entries, and what models predict from them.

Coefficients are a DataFrame (task, covariateId, beta): tasks are fits that are evaluated side by side in one job (folds,
grid points, replicates). A single fit is task 0.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import logistic
from ..plans.data import RegressionData
from ..plans.models import INTERCEPT_ID, Model

BETA_DDL = "task int, covariateId long, beta double"
#: Coefficients that are broadcast, at most; more of them are joined as Spark sees fit.
BROADCAST = 500_000


def coefficients(spark: SparkSession, *tasks: Mapping[int, float]) -> DataFrame:
    """Coefficients from plain mappings, one for each task."""
    return spark.createDataFrame([(t, int(c), float(b)) for t, betas in enumerate(tasks) for c, b in betas.items()], BETA_DDL)


def _used(betas: DataFrame) -> DataFrame:
    """The coefficients of covariates that aren't zero. Few are broadcast: a shuffle by covariate would put all entries of one in one task."""
    used = betas.filter((F.col("beta") != 0) & (F.col("covariateId") != INTERCEPT_ID))
    return F.broadcast(used) if used.limit(BROADCAST + 1).count() <= BROADCAST else used


def linear_predictors(data: RegressionData, betas: DataFrame, tasks: int = 1) -> DataFrame:
    """The outcomes of each task, with xb: intercept, offset and the sum of entry * beta; rows without entries have no sum."""
    rows = data.outcomes.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))) if tasks > 1 else data.outcomes.withColumn("task", F.lit(0))
    sums = data.covariates.join(_used(betas), "covariateId").groupBy("task", "rowId").agg(F.sum(F.col("covariateValue") * F.col("beta")).alias("s"))
    rows = rows.join(sums, ["task", "rowId"], "left")
    xb = F.coalesce("s", F.lit(0.0))
    if not data.model.own_time:
        xb = xb + F.col("offset")
    if data.has_intercept:
        constant = betas.filter(F.col("covariateId") == INTERCEPT_ID).select("task", F.col("beta").alias("b0"))
        rows = rows.join(constant, "task", "left")
        xb = xb + F.coalesce("b0", F.lit(0.0))
    return rows.withColumn("xb", xb).drop("s", "b0")


def _response(model: Model, xb: Column) -> Column:
    if model is Model.LR:
        return logistic(xb)
    return F.exp(xb) if model is Model.PR else xb


def predict(data: RegressionData, betas: DataFrame) -> DataFrame:
    """(rowId, value): probabilities of lr, expected counts of pr, linear predictors of the others."""
    return linear_predictors(data, betas).select("rowId", _response(data.model, F.col("xb")).alias("value"))


def predict_new(outcomes: DataFrame, covariates: DataFrame, betas: DataFrame, model: str = "lr") -> DataFrame:
    """(rowId, value) for other tables: counts of pr are rates times the rows' time. Works on streams of outcomes whose
    covariates are static. Not for cox, clr and cpr, whose scores have no level."""
    model = Model(model)
    if model in (Model.COX, Model.CLR, Model.CPR):
        raise ValueError(f"prediction for new data is not available for model {model}")
    sums = covariates.join(_used(betas.select("covariateId", "beta")), "covariateId").groupBy("rowId").agg(F.sum(F.col("covariateValue") * F.col("beta")).alias("s"))
    constant = betas.filter(F.col("covariateId") == INTERCEPT_ID).agg(F.coalesce(F.sum("beta"), F.lit(0.0)).alias("b0"))
    rows = outcomes.join(sums, "rowId", "left").join(F.broadcast(constant), F.lit(True))  # one row
    xb = F.coalesce("s", F.lit(0.0)) + F.col("b0")
    value = F.exp(xb) * F.col("time") if model is Model.PR else _response(model, xb)
    return rows.select("rowId", value.alias("value"))


def mean_linear_predictor(data: RegressionData, betas: DataFrame) -> DataFrame:
    """One row, value: the linear predictor at the covariates' means over all rows, without intercept and offset."""
    n = data.outcomes.agg(F.count("*").alias("n"))
    sums = data.covariates.groupBy("covariateId").agg(F.sum("covariateValue").alias("s"))
    return sums.join(betas, "covariateId").join(F.broadcast(n), F.lit(True)).agg(F.coalesce(F.sum(F.col("s") / F.col("n") * F.col("beta")), F.lit(0.0)).alias("value"))
