"""Risk sets, censoring weights, episodes and residuals: sums over time within strata.

Running sums go over distinct times, not rows. Where one stratum holds most of the times, they go in two levels: times are
dealt to ranges, summed by range, and the running totals of the few ranges are added to those inside each; no task then
sorts a whole stratum.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.data import dealt, numbered


@dataclass(frozen=True)
class Running:
    """A running sum of a column: from the latest time down or from the earliest up, with or without the own time."""

    column: str
    falling: bool = True
    own: bool = True


#: One task sums so many distinct times of a stratum; strata with more are cut into ranges.
RANGE_TIMES = 100_000


def range_cuts(rows: DataFrame, keys: Sequence[str], ranges: int | None = None, time: str = "time", untied: bool = False) -> list[float]:
    """Where to cut the times of rows into ranges: nowhere if no stratum has more than RANGE_TIMES distinct times; ranges gives a
    number of ranges instead. untied: each row has a time of its own, even if it equals others'. The cuts decide how the work is
    dealt, never the result."""
    if ranges is None:
        times = rows.select(*keys, time)
        most = (times if untied else times.distinct()).groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        ranges = -(-most // RANGE_TIMES)
    if ranges <= 1:
        return []
    return sorted(set(rows.approxQuantile(time, [i / ranges for i in range(1, ranges)], min(0.005, 0.2 / ranges))))


def running_sums(times: DataFrame, keys: Sequence[str], sums: Mapping[str, Running], cuts: Sequence[float] | int | None = (), tie: str | None = None, size: int = 0) -> DataFrame:
    """times (one row for each keys and time, or time and tie) with the columns sums. cuts: times at which ranges end, for two levels;
    a number of ranges, or None for as many as the times need. Equal times with a tie go by it, upwards, where sums fall. size: about how many times there
    are, if it is known, see ``dealt``."""
    cuts = range_cuts(times, keys, cuts, untied=tie is not None) if cuts is None or isinstance(cuts, int) else cuts

    def over(part: Sequence[str], by: str, falling: bool, own: bool):
        w = Window.partitionBy(*part).orderBy(F.desc(by) if falling else F.asc(by), *([F.asc(tie) if falling else F.desc(tie)] if tie and by == "time" else []))
        return w.rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)

    zero = lambda c: F.coalesce(c, F.lit(0.0))
    if not cuts:
        return times.withColumns({n: zero(F.sum(r.column).over(over(keys, "time", r.falling, r.own))) for n, r in sums.items()})
    bounds = F.array(*[F.lit(float(c)) for c in cuts])
    ranged = dealt(times.withColumn("__range", F.size(F.filter(bounds, lambda x: x < F.col("time")))), size, *keys, "__range")
    totals = ranged.groupBy(*keys, "__range").agg(*[F.sum(r.column).alias(f"__{n}") for n, r in sums.items()])
    totals = totals.select(*keys, "__range", *[zero(F.sum(f"__{n}").over(over(keys, "__range", r.falling, False))).alias(f"__{n}") for n, r in sums.items()])
    inner = ranged.withColumns({n: zero(F.sum(r.column).over(over([*keys, "__range"], "time", r.falling, r.own))) for n, r in sums.items()})
    joined = inner.join(totals, [*keys, "__range"])
    return joined.select(*times.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def at_risk(rows: DataFrame, keys: Sequence[str] = ("stratumId",), weight: Column | None = None, ranges: int | None = None) -> DataFrame:
    """rows (keys, time, xb) with denominator: the sum of weight * exp(xb) over the rows of its keys with time at or after
    its own (ties by Breslow)."""
    e = F.exp("xb") * (weight if weight is not None else F.lit(1.0))
    times = rows.groupBy(*keys, "time").agg(F.sum(e).alias("e"))
    sums = running_sums(times, keys, {"denominator": Running("e")}, ranges)
    return rows.join(sums.select(*keys, "time", "denominator"), [*keys, "time"])


def at_risk_untied(rows: DataFrame, keys: Sequence[str] = ("stratumId",), ranges: int | None = None) -> DataFrame:
    """As at_risk for data without ties: the rows at or before it in falling time; rows with equal times go by rowId."""
    return running_sums(rows.withColumn("__e", F.exp("xb")), keys, {"denominator": Running("__e")}, ranges, tie="rowId").drop("__e")


def censoring_weights(rows: DataFrame, time: str = "time", status: str = "status", censor: object = 0, fail: object = 1, ranges: int | None = None) -> DataFrame:
    """rows with y (1: failure, 0: censored, 2: anything else) and censorWeights, the left-continuous Kaplan-Meier estimate of
    staying uncensored until just before the row's time."""
    if not rows.filter(F.col(time) < 0).isEmpty():
        raise ValueError("times must not be negative")
    y = F.when(F.col(status) == fail, 1.0).when(F.col(status) == censor, 0.0).otherwise(2.0)
    coded = rows.withColumn("y", y)
    times = coded.groupBy(F.col(time).cast("double").alias("time")).agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("y") == 0).cast("double").alias("c"))
    times = times.withColumn("one", F.lit(""))
    cuts = range_cuts(times, ["one"], ranges)
    times = running_sums(times, ["one"], {"risk": Running("n")}, cuts)
    # An event at a time of censoring stands before it: its row is still at risk, as are the censored. The product of what stays is
    # the exponential of a sum; from a time on at which all are censored it is nothing.
    stay = 1 - F.col("c") / F.col("risk")
    times = times.withColumns({"log_stay": F.when(stay > 0, F.log(stay)).otherwise(0.0), "gone": F.when(stay > 0, 0.0).otherwise(1.0)})
    times = running_sums(times, ["one"], {"stayed": Running("log_stay", falling=False, own=False), "ended": Running("gone", falling=False, own=False)}, cuts)
    weights = times.select(F.col("time").alias("__time"), F.when(F.col("ended") > 0, 0.0).otherwise(F.exp("stayed")).alias("censorWeights"))
    return coded.join(weights, F.col(time).cast("double") == F.col("__time")).drop("__time")


def split_time(outcomes: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Outcomes (rowId, y, time) cut at the given times: a row for each episode, with stratumId (number of the episode),
    subjectId (the old rowId), rowId (the old one in the first episode, new ones after), y and time (in the episode)."""
    edges = F.array(F.lit(0.0), *[F.lit(float(c)) for c in sorted(cuts)])
    rows = outcomes.select(F.col("rowId").alias("subjectId"), F.col("y").alias("__y"), F.col("time").cast("double").alias("__time"), F.posexplode(edges).alias("k", "start")).filter(F.col("start") < F.col("__time"))
    stop = F.least(F.coalesce(F.get(edges, F.col("k") + 1), F.col("__time")), F.col("__time"))
    rows = rows.select((F.col("k") + 1).cast("long").alias("stratumId"), "subjectId", F.when(stop == F.col("__time"), F.col("__y")).otherwise(0).cast("double").alias("y"), (stop - F.col("start")).alias("time"))
    # New ids: after the highest, episode by episode and by subject.
    later = numbered(rows.filter("stratumId > 1"), [F.col("stratumId"), F.col("subjectId")], "place")
    highest = outcomes.agg(F.max("rowId").alias("highest"))
    later = later.join(F.broadcast(highest), F.lit(True)).withColumn("rowId", F.col("highest") + F.col("place"))  # one row
    both = rows.filter("stratumId = 1").withColumn("rowId", F.col("subjectId")).unionByName(later.select(*rows.columns, "rowId"))
    return both.select("stratumId", "subjectId", F.col("rowId").cast("long").alias("rowId"), "y", "time")


def time_varying(episodes: DataFrame, covariates: DataFrame, varying: Sequence[int]) -> DataFrame:
    """Covariates (rowId, covariateId, covariateValue) of the rows of split outcomes: those in ``varying`` get an id of their
    own in each episode after the first, the others keep theirs."""
    highest = covariates.agg(F.max("covariateId")).first()[0] or 0
    order = sorted(varying)
    own = F.array_position(F.array(*[F.lit(int(v)).cast("long") for v in order]), F.col("covariateId")) if order else F.lit(0)
    rows = covariates.withColumnRenamed("rowId", "subjectId").join(episodes.select("subjectId", "stratumId", "rowId"), "subjectId")
    changed = F.when((F.col("stratumId") > 1) & (own > 0), F.lit(highest) + len(order) * (F.col("stratumId") - 2) + own).otherwise(F.col("covariateId"))
    return rows.select("rowId", changed.cast("long").alias("covariateId"), "covariateValue")


def baseline_survival(rows: DataFrame, mean_xb: float, ranges: int | None = None) -> DataFrame:
    """(time, n_risk, n_event, surv): the Breslow estimate at the mean linear predictor, over all strata together, from
    rows (time, y, xb)."""
    times = rows.groupBy("time").agg(F.sum(F.exp("xb")).alias("e"), F.count_if(F.col("y") == 1).cast("double").alias("n_event"), F.count("*").cast("double").alias("n"))
    times = times.withColumn("one", F.lit(""))
    times = running_sums(times, ["one"], {"denominator": Running("e"), "n_risk": Running("n")}, ranges)
    times = times.withColumn("step", F.col("n_event") / F.col("denominator"))
    times = running_sums(times, ["one"], {"hazard": Running("step", falling=False)}, ranges)
    return times.select("time", F.col("n_risk").cast("long").alias("n_risk"), F.col("n_event").cast("long").alias("n_event"), F.exp(-F.col("hazard") * F.exp(F.lit(mean_xb))).alias("surv"))


def schoenfeld(rows: DataFrame, entries: DataFrame, ranges: int | None = None) -> DataFrame:
    """(rowId, stratumId, time, residual) for each event: its covariate less the mean over its risk set.

    rows: rowId, stratumId, time, y, xb; entries: rowId, covariateValue of the one covariate.
    """
    x = rows.join(entries.select("rowId", F.col("covariateValue").alias("x")), "rowId", "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    keys = ["stratumId"]
    times = x.groupBy(*keys, "time").agg(F.sum(F.exp("xb")).alias("e"), F.sum(F.exp("xb") * F.col("x")).alias("ex"))
    times = running_sums(times, keys, {"d": Running("e"), "n1": Running("ex")}, ranges)
    events = x.filter("y = 1").join(times.select(*keys, "time", "d", "n1"), [*keys, "time"])
    return events.select("rowId", "stratumId", "time", (F.col("x") - F.col("n1") / F.col("d")).alias("residual"))


TRANSFORMS = ("identity", "log", "rank", "km")


def proportionality(rows: DataFrame, entries: DataFrame, transform: str | Callable[[Column], Column] = "identity", ranges: int | None = None) -> DataFrame:
    """One row (u, h11, h12, h22, chisq, df): the score test that the covariate's effect changes with transformed time, at
    the fitted xb. The transformed times of events are centred at their mean."""
    if not callable(transform) and transform not in TRANSFORMS:
        raise ValueError(f"transform must be one of {TRANSFORMS}, or a function of the time column")
    x = rows.join(entries.select("rowId", F.col("covariateValue").alias("x")), "rowId", "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    keys, e = ["stratumId"], F.exp("xb")
    times = x.groupBy(*keys, "time").agg(F.sum(e).alias("e"), F.sum(e * F.col("x")).alias("ex"), F.sum(e * F.col("x") * F.col("x")).alias("exx"), F.sum(F.when(F.col("y") == 1, 1.0).otherwise(0.0)).alias("d"), F.sum(F.when(F.col("y") == 1, F.col("x")).otherwise(0.0)).alias("sx"))
    times = running_sums(times, keys, {"at_risk": Running("e"), "n1": Running("ex"), "n2": Running("exx")}, ranges).filter("d > 0")
    g = F.col("time")
    if callable(transform):
        g = transform(F.col("time")).cast("double")
    elif transform == "log":
        g = F.log("time")
    elif transform != "identity":
        per_time = x.groupBy("time").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("y") == 1).cast("double").alias("k")).withColumn("one", F.lit(""))
        per_time = running_sums(per_time, ["one"], {"risk": Running("n"), "before": Running("k", falling=False, own=False)}, ranges)
        if transform == "km":
            left = 1 - F.col("k") / F.col("risk")
            per_time = per_time.withColumn("log_left", F.when(left > 0, F.log(left)).otherwise(0.0))  # nothing is left only after the last time
            per_time = running_sums(per_time, ["one"], {"stayed": Running("log_left", falling=False, own=False)}, ranges)
            per_time = per_time.select("time", (1 - F.exp("stayed")).alias("g"))
        else:
            per_time = per_time.select("time", (F.col("before") + (F.col("k") + 1) / 2).alias("g"))
        times, g = times.join(per_time, "time"), F.col("g")
    times = times.withColumn("g", g)
    centre = times.agg((F.sum(F.col("g") * F.col("d")) / F.sum("d")).alias("gbar"))
    times = times.join(F.broadcast(centre), F.lit(True)).withColumn("c", F.col("g") - F.col("gbar"))  # one row
    m = F.col("n1") / F.col("at_risk")
    v = F.col("n2") / F.col("at_risk") - m * m
    sums = times.agg(F.sum(F.col("c") * (F.col("sx") - F.col("d") * m)).alias("u"), F.sum(F.col("d") * v).alias("h11"), F.sum(F.col("c") * F.col("d") * v).alias("h12"), F.sum(F.col("c") * F.col("c") * F.col("d") * v).alias("h22"))
    chisq = F.col("u") * F.col("u") * F.col("h11") / (F.col("h11") * F.col("h22") - F.col("h12") * F.col("h12"))
    return sums.withColumns({"chisq": chisq, "df": F.lit(1)})
