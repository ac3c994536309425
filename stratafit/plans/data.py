"""The two-table data model: outcomes (one row for each observation) and covariates (long, sparse)."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.paths import written
from .models import INTERCEPT_ID, INTERCEPT_NAME, Model

OUTCOME_COLUMNS = {"rowId": "long", "stratumId": "long", "y": "double", "time": "double", "weights": "double", "censorWeights": "double", "subjectId": "long"}
_COVARIATE_COLUMNS = {"rowId": "long", "covariateId": "long", "covariateValue": "double"}


@dataclass(frozen=True)
class RegressionData:
    """outcomes: rowId, stratumId, y, time, offset and, where given, weights, censorWeights, subjectId.
    covariates: rowId, covariateId, covariateValue, unique by row and covariate, without zeros. The intercept is never a row.
    size: about how many outcomes there are, 0 if nobody knows; it decides how the work is dealt, never the result."""

    model: Model
    outcomes: DataFrame
    covariates: DataFrame
    has_intercept: bool = False
    has_offset: bool = False
    names: Mapping[int, str] = field(default_factory=dict)
    scales: DataFrame | None = None
    finalized: bool = True
    size: int = 0

    @property
    def spark(self) -> SparkSession:
        return self.outcomes.sparkSession

    def name_of(self, covariate: int) -> str:
        return self.names.get(covariate, INTERCEPT_NAME if covariate == INTERCEPT_ID else str(covariate))

    def ids_of(self, covariates: Sequence[int | str]) -> list[int]:
        """Ids from ids and names; an error names those that the data don't have."""
        by_name = {name: c for c, name in self.names.items()} | ({INTERCEPT_NAME: INTERCEPT_ID} if self.has_intercept else {})
        wanted = [by_name.get(c, c) if isinstance(c, str) else int(c) for c in covariates]
        wanted = [int(c) if isinstance(c, str) and c.lstrip("-").isdigit() else c for c in wanted]
        ids = [c for c in wanted if not isinstance(c, str)]
        chosen = self.covariates.filter(F.col("covariateId").isin(ids)).select("covariateId").distinct()
        known = {r[0] for r in chosen.collect()} | ({INTERCEPT_ID} if self.has_intercept else set())
        if missing := [c for c in wanted if c not in known]:
            raise ValueError(f"the data have no covariates {missing}")
        return ids


def _typed(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items() if c in df.columns])


def matching_rows(covariates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Covariates whose row is among the outcomes."""
    return covariates.join(outcomes.select("rowId"), "rowId", "left_semi")


def with_time_and_outcome(covariates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Covariates of the rows among the outcomes, with their time and y."""
    return covariates.join(outcomes.select("rowId", "time", "y"), "rowId")


def check_unique(covariates: DataFrame) -> None:
    """A row has a covariate at most once."""
    if not covariates.groupBy("rowId", "covariateId").count().filter("count > 1").isEmpty():
        raise ValueError("a row has the same covariate twice or more")


#: Rows of a partition where rows are dealt out by their number.
DEALT_ROWS = 250_000


def dealt(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """df dealt by keys to as many partitions as ``size`` rows need, so that the share of a task stays the same as rows grow, whatever
    the session's number of partitions. df itself where all cores have less than that."""
    parts = -(-size // DEALT_ROWS)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def from_tables(outcomes: DataFrame, covariates: DataFrame, model: str | Model = "lr", add_intercept: bool = True, check_row_ids: bool = True, normalize: str | None = None, time_effects: DataFrame | None = None, checked: bool = True, size: int = 0) -> RegressionData:
    """The data object from the two tables, with the model's rules.

    Counts need a positive time, Cox models at most two outcomes; conditional and survival models have no intercept; lr, pr
    and ls ignore strata, survival models without any have one. Time is a log offset of pr and cpr. checked: whether
    the rules that need a pass over the data are tested. size: see ``RegressionData``.
    """
    model = Model(model)
    out = _typed(outcomes, OUTCOME_COLUMNS)
    cov = _typed(covariates, _COVARIATE_COLUMNS)
    if model.counts or model.own_time:
        if "time" not in out.columns:
            raise ValueError(f"model {model} needs a column time")
    if model.counts and checked and not out.filter("time is null or time <= 0").isEmpty():
        raise ValueError(f"model {model} needs times above zero in all rows")
    if model in (Model.COX, Model.COX_RAW, Model.COX_TIME) and checked and out.select("y").distinct().limit(3).count() > 2:
        raise ValueError(f"model {model} takes outcomes 0 and 1 only; for competing events use fgr")
    if model.stratified and "stratumId" not in out.columns:
        raise ValueError(f"model {model} needs a column stratumId")
    if add_intercept and not model.intercept:
        if not model.survival:
            warnings.warn(f"model {model} conditions on its strata, so it goes without an intercept", stacklevel=2)
        add_intercept = False
    if model.intercept or "stratumId" not in out.columns:
        out = out.withColumn("stratumId", F.lit(0).cast("long"))
    if check_row_ids:
        cov = matching_rows(cov, out)
    cov = cov.filter("covariateValue <> 0")
    if checked:
        check_unique(cov)
    if "time" not in out.columns:
        out = out.withColumn("time", F.lit(None).cast("double"))
    out = out.withColumn("offset", F.log("time") if model.counts else F.lit(0.0))
    data = RegressionData(model, out, cov, add_intercept, model.counts, size=size)
    if time_effects is not None:
        data = with_time_effects(data, time_effects)
    if normalize:
        from ..operators.reduce import normalized

        data = normalized(data, normalize)
    return data


def sorted_tables(data: RegressionData) -> tuple[DataFrame, DataFrame]:
    """Outcomes and covariates in the model's order: by row, by stratum and row, or by stratum and falling time."""
    if data.model.intercept:
        return data.outcomes.orderBy("rowId"), data.covariates.orderBy("covariateId", "rowId")
    if data.model.stratified:
        keys = data.outcomes.select("rowId", "stratumId")
        return data.outcomes.orderBy("stratumId", "rowId"), data.covariates.join(keys, "rowId").orderBy("covariateId", "stratumId", "rowId")
    keys = data.outcomes.select("rowId", "stratumId", "time", "y")
    order = ["stratumId", F.desc("time"), "y", *(["subjectId"] if "subjectId" in data.outcomes.columns else []), "rowId"]
    return data.outcomes.orderBy(*order), data.covariates.join(keys, "rowId").orderBy("covariateId", "stratumId", F.desc("time"), "y", "rowId")


#: Rows that one task sorts, and the fewest that are worth one.
RANGE_ROWS, LEAST_ROWS = 1_000_000, 25_000
#: Bits of a place within its range.
_PLACE_BITS = 33


def in_order(df: DataFrame, keys: Sequence[Column], name: str = "order") -> DataFrame:
    """df, written, with __at, which rises with the keys: rows are dealt to ranges of the keys, as many as their number needs, and sorted
    there; the range's number and the place in it make up __at. Equal keys are in one range, so keys should tell rows apart."""
    rows = df.count()
    parts = max(1, min(df.sparkSession.sparkContext.defaultParallelism, rows // LEAST_ROWS), -(-rows // RANGE_ROWS))
    return written(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), name)


def _range() -> Column:
    return F.shiftright("__at", _PLACE_BITS)


def numbered(df: DataFrame, keys: Sequence[Column], name: str) -> DataFrame:
    """df with the place of each row, from 1, in the rising order of keys: rows of the ranges before, by a count of each range, and
    the place within the range, so that no task sorts all rows."""
    dealt = in_order(df, keys)
    sizes = dealt.groupBy(_range().alias("__range")).count()  # a row for each range
    before = F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__range", before.alias("__before"))
    place = F.col("__before") + F.col("__at") - F.shiftleft("__range", _PLACE_BITS) + 1
    return dealt.withColumn("__range", _range()).join(F.broadcast(sizes), "__range").select(*df.columns, place.cast("long").alias(name))


def is_sorted(df: DataFrame, columns: Sequence[str], ascending: Sequence[bool], position: str) -> bool:
    """Whether the rows, in the order of the column position, are sorted by columns in the given directions.

    Neighbours are compared within ranges of position, and the last row of each range with the first of the next.
    """
    wrong, equal = F.lit(False), F.lit(True)
    for c, up in zip(columns, ascending, strict=True):
        last = F.col(f"before.{c}")
        wrong = wrong | (equal & ((F.col(f"row.{c}") < last) if up else (F.col(f"row.{c}") > last)))
        equal = equal & (F.col(f"row.{c}") == last)
    rows = in_order(df.select(*dict.fromkeys([position, *columns])), [F.col(position)]).select(_range().alias("__range"), F.col("__at").alias("at"), F.struct(*columns).alias("row"))
    within = rows.select("row", F.lag("row").over(Window.partitionBy("__range").orderBy("at")).alias("before"))
    if not within.filter(wrong).isEmpty():
        return False
    edges = rows.groupBy("__range").agg(F.min_by("row", "at").alias("row"), F.max_by("row", "at").alias("last"))
    edges = edges.select("row", F.lag("last").over(Window.orderBy("__range")).alias("before"))  # a row for each range
    return edges.filter(wrong).isEmpty()


def empty(spark: SparkSession, model: str | Model = "lr") -> RegressionData:
    """A data object without rows, to append to."""
    out = spark.createDataFrame([], ", ".join(f"{c} {OUTCOME_COLUMNS[c]}" for c in ("rowId", "stratumId", "y", "time")))
    cov = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in _COVARIATE_COLUMNS.items()))
    return from_tables(out, cov, model, add_intercept=Model(model).intercept, checked=False)


def appended(data: RegressionData, outcomes: DataFrame, covariates: DataFrame, checked: bool = True) -> RegressionData:
    """data with a further chunk of both tables. checked: whether its rows must be new ones."""
    more = from_tables(outcomes, covariates, data.model, data.has_intercept, checked=checked)
    if checked and not more.outcomes.join(data.outcomes.select("rowId"), "rowId", "left_semi").isEmpty():
        raise ValueError("rows of the chunk are in the data already")
    return replace(data, outcomes=data.outcomes.unionByName(more.outcomes, allowMissingColumns=True), covariates=data.covariates.unionByName(more.covariates))


def with_offset(data: RegressionData, covariate: int | str, logged: bool = False) -> RegressionData:
    """data with a covariate taken out and used as the offset of all rows: its logarithm, or the value itself if it is logged
    already. Rows without an entry have the value 0, so they need logged."""
    (found,) = data.ids_of([covariate])
    values = data.covariates.filter(F.col("covariateId") == found).select("rowId", F.col("covariateValue").alias("__value"))
    rows = data.outcomes.join(values, "rowId", "left").withColumn("__value", F.coalesce("__value", F.lit(0.0)))
    if not logged and not rows.filter("__value <= 0").isEmpty():
        raise ValueError("an offset that isn't logged must be above zero in all rows")
    value = F.col("__value") if logged else F.log("__value")
    rest = data.covariates.filter(F.col("covariateId") != found)
    return replace(data, outcomes=rows.withColumn("offset", value).drop("__value"), covariates=rest, has_offset=True, names={c: n for c, n in data.names.items() if c != found})


def with_covariates(data: RegressionData, values: DataFrame, names: Mapping[int, str] | None = None) -> RegressionData:
    """data with many more covariates, from (rowId, covariateId[, covariateValue]); ids must be new ones."""
    value = F.col("covariateValue") if "covariateValue" in values.columns else F.lit(1.0)
    rows = _typed(values.withColumn("covariateValue", value), _COVARIATE_COLUMNS)
    if not rows.select("covariateId").distinct().join(data.covariates.select("covariateId").distinct(), "covariateId", "left_semi").isEmpty():
        raise ValueError("some of the new covariates are in the data already")
    rows = matching_rows(rows, data.outcomes).filter("covariateValue <> 0")
    check_unique(rows)
    return replace(data, covariates=data.covariates.unionByName(rows), names={**data.names, **(names or {})})


def with_covariate(data: RegressionData, covariate: int, values: DataFrame, name: str | None = None) -> RegressionData:
    """data with one more covariate, from (rowId[, covariateValue]); without values it is an indicator."""
    if not data.covariates.filter(F.col("covariateId") == covariate).isEmpty():
        raise ValueError(f"there is a covariate {covariate} in the data")
    value = F.col("covariateValue") if "covariateValue" in values.columns else F.lit(1.0)
    rows = values.select(F.col("rowId").cast("long"), F.lit(covariate).cast("long").alias("covariateId"), value.cast("double").alias("covariateValue"))
    rows = matching_rows(rows, data.outcomes).filter("covariateValue <> 0")
    check_unique(rows)
    return replace(data, covariates=data.covariates.unionByName(rows), names={**data.names, **({covariate: name} if name else {})})


def with_time_effects(data: RegressionData, time_effects: DataFrame) -> RegressionData:
    """A copy of the chosen covariates (covariateId) for each stratum but the first, under new ids after the others."""
    chosen = time_effects.select(F.col("covariateId").cast("long").alias("covariateId")).distinct()
    highest = data.covariates.agg(F.max("covariateId")).first()[0] or 0
    rank = chosen.withColumn("i", F.dense_rank().over(Window.orderBy("covariateId")))  # the chosen few
    strata = numbered(data.outcomes.select("stratumId").distinct(), [F.col("stratumId")], "s")
    k = rank.count()
    rows = data.covariates.join(F.broadcast(rank), "covariateId").join(data.outcomes.select("rowId", "stratumId"), "rowId").join(strata, "stratumId").filter("s > 1")
    fresh = rows.select("rowId", (F.lit(highest) + k * (F.col("s") - 2) + F.col("i")).cast("long").alias("covariateId"), "covariateValue")
    return replace(data, covariates=data.covariates.unionByName(fresh))


def multitype(outcomes: DataFrame, covariates: DataFrame, type_col: str = "type") -> tuple[DataFrame, DataFrame]:
    """Outcomes of several types: each covariate is replicated for each type, under ids covariate * types + type."""
    types = outcomes.select(type_col).distinct().withColumn("t", F.dense_rank().over(Window.orderBy(type_col)) - 1)
    count = types.count()
    rows = covariates.join(outcomes.select("rowId", type_col), "rowId").join(F.broadcast(types), type_col)
    return outcomes, rows.select("rowId", (F.col("covariateId") * count + F.col("t")).cast("long").alias("covariateId"), "covariateValue")


def from_columns(df: DataFrame, y: str, dense: Sequence[str] = (), factors: Sequence[str] = (), indicators: Sequence[str] = (), row_id: str = "rowId", stratum: str | None = None, time: str | None = None, start: str | None = None, offset: str | None = None, weights: str | None = None, model: str = "lr", intercept: bool = True) -> RegressionData:
    """The data object from a wide table, as from a formula: numeric columns, factors (an indicator for each level but the
    first), 0/1 columns. start: with time, rows cover (start, time]; offset: on the log scale, as given."""
    if offset and time and not Model(model).own_time:
        raise ValueError("time and offset exclude each other here")
    if start and not time:
        raise ValueError("start needs time")
    levels = {f: [r[0] for r in df.select(f).distinct().orderBy(f).collect()] for f in factors}
    entries, names, next_id = [], {}, 1
    for c in [*dense, *indicators]:
        entries.append((next_id, F.col(c).cast("double")))
        names[next_id] = c
        next_id += 1
    for f, values in levels.items():
        for v in values[1:]:
            entries.append((next_id, (F.col(f) == F.lit(v)).cast("double")))
            names[next_id] = f"{f}{v}"
            next_id += 1
    pairs = F.array(*[F.struct(F.lit(i).cast("long").alias("covariateId"), e.alias("covariateValue")) for i, e in entries])
    long = df.select(F.col(row_id).cast("long").alias("rowId"), F.explode(pairs).alias("p")).select("rowId", "p.*")
    columns = {"rowId": F.col(row_id), "y": F.col(y)}
    columns |= {"stratumId": F.col(stratum)} if stratum else {}
    columns |= {"time": F.col(time) - F.col(start) if start else F.col(time)} if time else {}
    columns |= {"weights": F.col(weights)} if weights else {}
    wide = df.select(*[e.alias(c) for c, e in columns.items()], *([F.col(offset).cast("double").alias("__offset")] if offset else []))
    if offset and "time" not in columns and Model(model).counts:
        wide = wide.withColumn("time", F.exp("__offset"))
    data = from_tables(wide, long, model, intercept)
    if offset and not Model(model).counts:
        offs = wide.select(F.col("rowId").cast("long"), F.col("__offset").alias("offset"))
        data = replace(data, outcomes=data.outcomes.drop("offset").join(offs, "rowId"), has_offset=True)
    return replace(data, names=names)


_TERM = re.compile(r"^(?:(factor|strata|offset)\((\w+)\)|(\w+))$")


def from_formula(df: DataFrame, formula: str, sparse: Sequence[str] = (), indicators: Sequence[str] = (), type_col: str | None = None, normalize: str | None = None, **options: object) -> RegressionData:
    """The data object from a wide table and a formula such as ``y ~ x + factor(g) + strata(s) + offset(o)``; of counting-process
    data the left side is ``Surv(start, stop, y)``, of survival data ``Surv(time, y)``. ``- 1`` leaves the intercept out.

    sparse, indicators: further columns, the latter 0/1. type_col: outcomes of several types; each covariate has an id for each type,
    see ``multitype``.
    """
    left, tilde, right = (x.strip() for x in formula.partition("~"))
    if not tilde:
        raise ValueError("a formula has an outcome, ~ and terms")
    surv = re.fullmatch(r"Surv\((.*)\)", left)
    parts = [x.strip() for x in surv[1].split(",")] if surv else [left]
    times = dict(zip({2: ("time",), 3: ("start", "time")}.get(len(parts), ()), parts, strict=False))
    found: dict[str, list[str]] = {"factor": [], "strata": [], "offset": [], "": []}
    plain = re.sub(r"-\s*1\b", "", right)
    for term in (x.strip() for x in plain.split("+")):
        if term in ("", "1"):
            continue
        m = _TERM.match(term)
        if not m:
            raise ValueError(f"the term {term!r} isn't understood")
        found[m[1] or ""].append(m[2] or m[3])
    if len(found["strata"]) > 1 or len(found["offset"]) > 1:
        raise ValueError("a formula has one strata() and one offset() at most")
    options = {"intercept": plain == right, **options}
    data = from_columns(df, parts[-1], [*found[""], *sparse], found["factor"], indicators, stratum=next(iter(found["strata"]), None), offset=next(iter(found["offset"]), None), **times, **options)
    if type_col:
        types = df.select(F.col(str(options.get("row_id", "rowId"))).cast("long").alias("rowId"), F.col(type_col).alias("type"))
        typed = data.outcomes.join(types, "rowId")
        count = typed.select("type").distinct().count()
        _, cov = multitype(typed, data.covariates, "type")
        values = [r[0] for r in typed.select("type").distinct().orderBy("type").collect()]
        data = replace(data, covariates=cov, names={c * count + t: f"{n}:{v}" for c, n in data.names.items() for t, v in enumerate(values)})
    if normalize:
        from ..operators.reduce import normalized

        data = normalized(data, normalize)
    return data
