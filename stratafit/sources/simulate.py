"""Simulated data sets and the intervals of exposure histories."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Simulation:
    outcomes: DataFrame
    covariates: DataFrame
    effects: DataFrame
    intercepts: DataFrame


def _uniform(*parts) -> object:
    """Uniform on (0, 1), a function of its arguments only: the same whatever the partitions."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + 0.5) / float(1 << 53)


def _normal(*parts) -> object:
    return F.sqrt(-2 * F.log(_uniform(*parts, F.lit("radius")))) * F.cos(2 * F.pi() * _uniform(*parts, F.lit("angle")))


def simulate(spark: SparkSession, strata: int = 200, rows: int = 10_000, covariates: int = 20, effect_sd: float = 1.0, zero_effects: float = 0.9, per_row: int = 5, model: str = "logistic", seed: int = 1) -> Simulation:
    """Sparse indicator covariates, log-normal effects of which most are nothing, and outcomes of the model: survival
    (exponential times, censored), logistic or poisson."""
    s = F.lit(seed)
    effects = spark.range(1, covariates + 1).select(F.col("id").alias("covariateId"), F.when(_uniform("id", s, F.lit("zero")) < zero_effects, 0.0).otherwise(_normal("id", s, F.lit("effect")) * effect_sd).alias("logRr"))
    effects = effects.withColumn("rr", F.exp("logRr"))
    base = spark.range(1, strata + 1).select(F.col("id").alias("stratumId"), (_uniform("id", s, F.lit("stratum")) * 0.09 + 0.01).alias("prob")).withColumn("logProb", F.log("prob"))
    row = spark.range(1, rows + 1).select(F.col("id").alias("rowId"), (F.pmod(F.xxhash64("id", s, F.lit("deal")), F.lit(strata)) + 1).alias("stratumId"))
    drawn = row.select("rowId", F.explode(F.sequence(F.lit(1), F.lit(max(1, 2 * per_row - 1)))).alias("k"))
    drawn = drawn.filter(_uniform("rowId", "k", s, F.lit("has")) < 0.55).select("rowId", (F.pmod(F.xxhash64("rowId", "k", s), F.lit(covariates)) + 1).alias("covariateId")).distinct().withColumn("covariateValue", F.lit(1.0))
    sums = drawn.join(F.broadcast(effects), "covariateId").groupBy("rowId").agg(F.sum("logRr").alias("sum"))
    out = row.join(sums, "rowId", "left").join(base, "stratumId").withColumn("rate", F.exp(F.coalesce("sum", F.lit(0.0)) + F.col("logProb")))
    u = _uniform("rowId", s, F.lit("outcome"))
    if model == "survival":
        out = out.withColumns({"timeToOutcome": F.ceil(-F.log(u) / F.col("rate")).cast("double"), "timeToCensor": F.ceil(-F.log(_uniform("rowId", s, F.lit("censor"))) / 0.01).cast("double")})
        out = out.withColumns({"time": F.least("timeToOutcome", "timeToCensor"), "y": (F.col("timeToOutcome") <= F.col("timeToCensor")).cast("double")})
    elif model == "logistic":
        out = out.withColumns({"time": F.lit(1.0), "y": (u < F.col("rate") / (1 + F.col("rate"))).cast("double")})
    elif model == "poisson":
        time = F.floor(_uniform("rowId", s, F.lit("time")) * 1000) + 1
        mean = F.col("rate") * time / 1000
        term = lambda m: F.aggregate(F.sequence(F.lit(0), F.lit(40)), F.struct(F.exp(-m).alias("p"), F.exp(-m).alias("c"), F.lit(0.0).alias("y")), lambda a, k: F.struct((a["p"] * m / (k + 1)).alias("p"), (a["c"] + a["p"] * m / (k + 1)).alias("c"), (a["y"] + F.when(u > a["c"], 1.0).otherwise(0.0)).alias("y")))["y"]
        out = out.withColumns({"time": (time / 1000).cast("double"), "y": term(mean)})
    else:
        raise ValueError("model must be survival, logistic or poisson")
    return Simulation(out.drop("sum", "prob", "logProb"), drawn, effects, base)


def exposure_intervals(histories: DataFrame, age_cuts: Sequence[int], risk_from: int, risk_to: int) -> DataFrame:
    """Follow-up cut at ages and at the borders of the time after an exposure: (indiv, start, stop, event, exgr, agegr,
    loginterval), from (indiv, start, stop, exposure, event_day)."""
    points = F.array_sort(F.array_distinct(F.filter(F.concat(F.array("start", "stop", F.col("exposure") + risk_from - 1, F.col("exposure") + risk_to), F.array(*map(F.lit, age_cuts))), lambda x: (x >= F.col("start")) & (x <= F.col("stop")))))
    pairs = F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b"))
    rows = histories.withColumn("p", points).select("indiv", "exposure", "event_day", F.explode(pairs).alias("i")).select("indiv", "exposure", "event_day", F.col("i.a").alias("start"), F.col("i.b").alias("stop"))
    inside = lambda x: (x > F.col("start")) & (x <= F.col("stop"))
    group = sum((F.when(F.col("stop") > c, 1).otherwise(0) for c in age_cuts), F.lit(0))
    exposed = (F.col("stop") > F.col("exposure") + risk_from - 1) & (F.col("stop") <= F.col("exposure") + risk_to)
    return rows.select("indiv", "start", "stop", F.coalesce(inside(F.col("event_day")), F.lit(False)).cast("int").alias("event"), F.coalesce(exposed, F.lit(False)).cast("int").alias("exgr"), group.alias("agegr"), F.log((F.col("stop") - F.col("start")).cast("double")).alias("loginterval"))
