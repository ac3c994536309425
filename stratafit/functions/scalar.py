"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_factorial(y: Column) -> Column:
    """ln y! for whole y >= 0; Spark's own factorial ends at 20."""
    terms = F.aggregate(F.sequence(F.lit(2), F.greatest(y.cast("int"), F.lit(2))), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))
    return F.when(y > 1, terms).otherwise(F.lit(0.0))


def logistic(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero: sums differ in their last digits with their order."""
    return F.round(x, digits) + F.lit(0.0)


def lambda_to_variance(lam: float, n: int) -> float:
    """The Laplace variance of an elastic-net lambda over n rows."""
    return 2.0 / (n * lam) ** 2


def variance_to_lambda(variance: float, n: int) -> float:
    return (2.0 / variance) ** 0.5 / n
