"""Scores of a stream of outcomes, row by row: the operator is stateless."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import logistic
from ..plans.models import INTERCEPT_ID, Model


def score_stream(rows: DataFrame, betas: Mapping[int, float], model: str = "lr", entries: str = "covariates") -> DataFrame:
    """rows with a column value. Each row carries its entries as an array of (covariateId, covariateValue)."""
    known = F.create_map(*[F.lit(x) for c, b in betas.items() if c != INTERCEPT_ID for x in (int(c), float(b))]) if any(c != INTERCEPT_ID for c in betas) else None
    start = F.lit(float(betas.get(INTERCEPT_ID, 0.0)))
    weight = lambda c: F.coalesce(F.try_element_at(known, c), F.lit(0.0)) if known is not None else F.lit(0.0)
    xb: Column = F.aggregate(F.coalesce(entries, F.array().cast("array<struct<covariateId:int,covariateValue:double>>")), start, lambda a, e: a + e["covariateValue"] * weight(e["covariateId"].cast("int")))
    model = Model(model)
    value = logistic(xb) if model is Model.LR else F.exp(xb) if model is Model.PR else xb
    return rows.withColumn("value", value)
