"""The registered queries of the engine over the business tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import rounded
from .operators import likelihood, reduce, score, survival
from .plans import tables as t
from .plans.data import appended, from_columns, from_tables, is_sorted, matching_rows, multitype, numbered, with_covariate, with_time_and_outcome, with_time_effects
from .plans.fit import Control, fit, fit_path
from .plans.inference import baseline, coverage, mse, profile_intervals, profile_likelihood, residuals, standard_errors, test_proportionality, wald_intervals
from .plans.priors import Laplace, make_prior, parameterized
from .plans.resample import Search, bootstrap, cross_validated, folds
from .plans.wide import fit_table
from .sources.paths import new_folder
from .sources.simulate import exposure_intervals
from .sources.text import matrix_market, read_text
from .streaming.score import score_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Registers a query under its name. sql follows the common table expressions of the data (base)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"{t.SQL if base else ''}{sql}"
        return f

    return add


def _r(name: str, digits: int = 6) -> Column:
    return rounded(F.col(name), digits).alias(name)


def _sql_r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 as {name}"


# --- loading -------------------------------------------------------------------------------------------------------------


@query(" select rowId, cast(0 as bigint) as stratumId, y, time from outcomes")
def load_outcomes(spark, sf_dir):
    return t.data(spark, sf_dir).outcomes.select("rowId", "stratumId", "y", "time")


@query(f" select c.rowId, c.covariateId, {_sql_r('c.covariateValue', 'covariateValue')} from covariates c where c.rowId in (select rowId from outcomes where y = 1)")
def load_covariates_of_rows(spark, sf_dir):
    """Covariates of rows that aren't among the outcomes (here: those without the event) are left out."""
    out = t.outcomes(spark, sf_dir).filter("y = 1")
    return from_tables(out, t.covariates(spark, sf_dir), checked=False).covariates.select("rowId", "covariateId", _r("covariateValue"))


@query(f" select c.rowId, c.covariateId, {_sql_r('c.covariateValue', 'covariateValue')} from covariates c where c.rowId in (select rowId from outcomes)")
def load_covariates(spark, sf_dir):
    return t.data(spark, sf_dir).covariates.select("rowId", "covariateId", _r("covariateValue"))


@query(" select c.covariateId, count(*) as n from covariates c semi join (select rowId from outcomes where y = 1) o on c.rowId = o.rowId group by c.covariateId")
def semi_join_rows(spark, sf_dir):
    return matching_rows(t.covariates(spark, sf_dir), t.outcomes(spark, sf_dir).filter("y = 1")).groupBy("covariateId").agg(F.count("*").alias("n"))


@query(" select c.covariateId, cast(sum(o.time) as bigint) as total_time, cast(sum(o.y) as bigint) as total_y from covariates c join outcomes o on c.rowId = o.rowId group by c.covariateId")
def attach_time_and_outcome(spark, sf_dir):
    rows = with_time_and_outcome(t.covariates(spark, sf_dir), t.outcomes(spark, sf_dir))
    return rows.groupBy("covariateId").agg(F.sum("time").cast("long").alias("total_time"), F.sum("y").cast("long").alias("total_y"))


@query(
    """select l_orderkey as rowId, cast(date_diff('day', o_orderdate, l_shipdate) as double) as time, round(l_quantity, 4) + 0.0 as quantity
from lineitem join orders on l_orderkey = o_orderkey where l_shipdate > o_orderdate and l_linenumber = 1
qualify row_number() over (partition by l_orderkey order by l_shipdate, l_quantity) = 1""",
    base=False,
)
def counting_process_time(spark, sf_dir):
    """Rows cover the days from an order to the shipping of its first line."""
    rows = t.table(spark, sf_dir, "lineitem").join(t.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate > o_orderdate and l_linenumber = 1")
    rows = rows.groupBy(F.col("l_orderkey").alias("rowId")).agg(F.min(F.struct("l_shipdate", "l_quantity")).alias("first"), F.first("o_orderdate").alias("o_orderdate"))
    day = lambda c: F.datediff(c, F.lit("1970-01-01")).cast("double")
    wide = rows.select("rowId", day("o_orderdate").alias("start"), day("first.l_shipdate").alias("stop"), F.lit(1.0).alias("y"), F.col("first.l_quantity").alias("quantity"))
    data = from_columns(wide, "y", ["quantity"], time="stop", start="start", model="cox")
    out = data.outcomes.join(data.covariates, "rowId", "left")
    return out.select("rowId", "time", rounded(F.coalesce("covariateValue", F.lit(0.0)), 4).alias("quantity"))


@query(" select covariateId, count(*) as n, round(sum(covariateValue), 4) + 0.0 as total from covariates c semi join outcomes o on c.rowId = o.rowId group by covariateId")
def append_chunks(spark, sf_dir):
    out, cov = t.outcomes(spark, sf_dir), t.covariates(spark, sf_dir)
    half = lambda df, odd: df.filter(F.col("rowId") % 2 == odd)
    data = appended(from_tables(half(out, 0), half(cov, 0), checked=False), half(out, 1), half(cov, 1))
    return data.covariates.groupBy("covariateId").agg(F.count("*").alias("n"), rounded(F.sum("covariateValue"), 4).alias("total"))


@query(
    """ select covariateId, count(*) as n, round(sum(covariateValue), 4) + 0.0 as total from (
  select covariateId, covariateValue from covariates c semi join outcomes o on c.rowId = o.rowId
  union all select cast(900 as bigint), round(o_totalprice, 2) from orders where o_totalprice > 200000) group by covariateId"""
)
def add_covariate(spark, sf_dir):
    price = t.table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("rowId"), F.round("o_totalprice", 2).alias("covariateValue"))
    data = with_covariate(t.data(spark, sf_dir), 900, price)
    return data.covariates.groupBy("covariateId").agg(F.count("*").alias("n"), rounded(F.sum("covariateValue"), 4).alias("total"))


@query(
    """, ranked as (select rowId, dense_rank() over (order by s) as s from (select rowId, stratumId % 5 as s from outcomes)),
fresh as (select c.rowId, 501 + 2 * (r.s - 2) + case when c.covariateId = 101 then 1 else 2 end as covariateId from covariates c join ranked r on c.rowId = r.rowId where c.covariateId in (101, 102) and r.s > 1)
select covariateId, count(*) as n from (select covariateId from covariates union all select covariateId from fresh) group by covariateId"""
)
def stratum_time_effects(spark, sf_dir):
    chosen = spark.createDataFrame([(101,), (102,)], "covariateId long")
    data = with_time_effects(t.data(spark, sf_dir, "cox_time"), chosen)
    return data.covariates.groupBy("covariateId").agg(F.count("*").alias("n"))


@query(f" select rowId, {_sql_r('ln(time)', 'log_offset')} from outcomes")
def offset_column(spark, sf_dir):
    return t.data(spark, sf_dir, "pr").outcomes.select("rowId", rounded(F.col("offset")).alias("log_offset"))


@query(
    """, r as (select rowId, stratumId % 5 as s, time, y from outcomes)
select rowId, row_number() over (order by s, time desc, y, rowId) as place from r"""
)
def survival_order_all(spark, sf_dir):
    rows = t.data(spark, sf_dir, "cox").outcomes.select("rowId", "stratumId", "time", "y")
    return numbered(rows, [F.col("stratumId"), -F.col("time"), F.col("y"), F.col("rowId")], "place").select("rowId", "place")


@query(ORACLE_SQL["survival_order_all"], base=False)
def survival_order(spark, sf_dir):
    return survival_order_all(spark, sf_dir)


@query(
    """, r as (select rowId, stratumId, time, lag(rowId) over w as r0, lag(stratumId) over w as s0, lag(time) over w as t0 from outcomes window w as (order by rowId))
select bool_and(r0 is null or rowId >= r0) as by_row, bool_and(s0 is null or stratumId > s0 or (stratumId = s0 and time <= t0)) as by_time from r"""
)
def sortedness(spark, sf_dir):
    rows = t.outcomes(spark, sf_dir)
    flags = [is_sorted(rows, ["rowId"], [True], "rowId"), is_sorted(rows, ["stratumId", "time"], [True, False], "rowId")]
    return spark.createDataFrame([tuple(flags)], "by_row boolean, by_time boolean")


@query(" select covariateId * 3 + o.status as covariateId, count(*) as n from covariates c join outcomes o on c.rowId = o.rowId group by 1")
def multitype_covariates(spark, sf_dir):
    out = t.outcomes(spark, sf_dir)
    _, cov = multitype(out, t.covariates(spark, sf_dir), "status")
    return cov.groupBy("covariateId").agg(F.count("*").alias("n"))


@query(f" select o.rowId, o.stratumId, o.y, count(c.covariateId) as n, {_sql_r('coalesce(sum(c.covariateValue), 0)', 'total', 4)} from outcomes o left join covariates c on o.rowId = c.rowId group by o.rowId, o.stratumId, o.y")
def read_text_rows(spark, sf_dir):
    entries = t.covariates(spark, sf_dir).groupBy("rowId").agg(F.array_sort(F.collect_list(F.concat_ws(":", "covariateId", F.col("covariateValue").cast("string")))).alias("entries"))
    lines = t.outcomes(spark, sf_dir).join(entries, "rowId", "left").select(F.concat_ws(" ", "rowId", "stratumId", F.col("y").cast("int"), F.array_join(F.coalesce("entries", F.array().cast("array<string>")), " ")).alias("value"))
    path = new_folder(spark, "text")
    lines.write.text(path)
    data = read_text(spark, path, "clr", row_label=True, stratum_label=True)
    sums = data.covariates.groupBy("rowId").agg(F.count("*").alias("n"), F.sum("covariateValue").alias("total"))
    return data.outcomes.join(sums, "rowId", "left").select("rowId", "stratumId", "y", F.coalesce("n", F.lit(0)).alias("n"), rounded(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


@query(
    """, v as (select rowId, covariateId, round(covariateValue, 6) + 0.0 as covariateValue from covariates),
o as (select rowId, row_number() over (order by rowId) as r from outcomes), k as (select covariateId, row_number() over (order by covariateId) as c from (select distinct covariateId from v)),
e as (select r, c, covariateValue from v join o on v.rowId = o.rowId join k on v.covariateId = k.covariateId)
select '%%MatrixMarket matrix coordinate real general' as value union all select (select count(*) from o) || ' ' || (select count(*) from k) || ' ' || (select count(*) from e)
union all select r || ' ' || c || ' ' || cast(cast(covariateValue as double) as varchar) from e"""
)
def matrix_market_all(spark, sf_dir):
    data = from_tables(t.outcomes(spark, sf_dir), t.covariates(spark, sf_dir).select("rowId", "covariateId", _r("covariateValue")), checked=False)
    return matrix_market(data).select("value")


@query(ORACLE_SQL["matrix_market_all"], base=False)
def matrix_market_lines(spark, sf_dir):
    return matrix_market_all(spark, sf_dir)


@query(
    """with h as (select user_id as indiv, min(case when event_type = 'click' then cast(date_diff('day', cast('2024-01-01' as timestamp), ts) as int) + 1 end) as exposure,
 min(case when event_type = 'purchase' then cast(date_diff('day', cast('2024-01-01' as timestamp), ts) as int) + 1 end) as event_day from events group by user_id),
p as (select distinct indiv, exposure, event_day, unnest([0, 31, exposure + 1, exposure + 5, 10, 20]) as pt from h),
q as (select * from p where pt between 0 and 31),
i as (select indiv, exposure, event_day, pt as start, lead(pt) over (partition by indiv order by pt) as stop from q)
select indiv, start, stop, case when event_day > start and event_day <= stop then 1 else 0 end as event,
 case when stop > exposure + 1 and stop <= exposure + 5 then 1 else 0 end as exgr,
 case when stop > 20 then 2 when stop > 10 then 1 else 0 end as agegr, round(ln(stop - start), 6) + 0.0 as loginterval from i where stop is not null""",
    base=False,
)
def exposure_history_intervals(spark, sf_dir):
    day = F.datediff("ts", F.lit("2024-01-01")) + 1
    histories = t.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("indiv")).agg(F.lit(0).alias("start"), F.lit(31).alias("stop"), F.min(F.when(F.col("event_type") == "click", day)).alias("exposure"), F.min(F.when(F.col("event_type") == "purchase", day)).alias("event_day"))
    return exposure_intervals(histories, [10, 20], 2, 5).select("indiv", "start", "stop", "event", "exgr", "agegr", _r("loginterval"))


# --- reductions ----------------------------------------------------------------------------------------------------------


@query(" select covariateId, cast(count(*) as double) as power0, round(sum(covariateValue), 4) + 0.0 as power1, round(sum(covariateValue * covariateValue), 3) + 0.0 as power2 from covariates group by covariateId")
def reduce_powers(spark, sf_dir):
    data = t.data(spark, sf_dir)
    parts = [reduce.reduce_covariates(data, p).withColumnRenamed("value", f"power{p}") for p in (0, 1, 2)]
    return parts[0].join(parts[1], "covariateId").join(parts[2], "covariateId").select("covariateId", "power0", _r("power1", 4), _r("power2", 3))


@query(f" select o.stratumId, {_sql_r('coalesce(sum(c.covariateValue), 0)', 'value', 4)} from outcomes o left join (select * from covariates where covariateId = 500) c on o.rowId = c.rowId group by o.stratumId")
def reduce_by_stratum(spark, sf_dir):
    return reduce.reduce_by_stratum(t.data(spark, sf_dir, "clr", add_intercept=False), 500).select("stratumId", _r("value", 4))


@query(
    f""" select case when g.rowId is null then cast(0 as bigint) else 1 end as grp, {_sql_r('sum(coalesce(c.covariateValue, 0))', 'value', 4)} from outcomes o
left join (select rowId from covariates where covariateId = 101) g on o.rowId = g.rowId left join (select * from covariates where covariateId = 500) c on o.rowId = c.rowId group by 1"""
)
def reduce_by_covariate(spark, sf_dir):
    return reduce.reduce_by_covariate(t.data(spark, sf_dir), 500, 101).select("grp", _r("value", 4))


@query(
    f""" select covariateId, count(*) as nzCount, {_sql_r('avg(covariateValue)', 'nzMean')}, {_sql_r('greatest((sum(covariateValue * covariateValue) - count(*) * avg(covariateValue) * avg(covariateValue)) / count(*), 0.0)', 'nzVar')},
case when bool_and(covariateValue = 1) then 'indicator' else 'sparse' end as type from covariates group by covariateId"""
)
def covariate_summary(spark, sf_dir):
    return reduce.summary(t.data(spark, sf_dir)).select("covariateId", "nzCount", _r("nzMean"), _r("nzVar"), "type")


@query(
    f""", y as (select cast(count(*) as double) as n, sum(y) as sy, sum(y * y) as syy from outcomes),
s as (select covariateId, sum(covariateValue) as sx, sum(covariateValue * covariateValue) as sxx, sum(covariateValue * y) as sxy from covariates c join outcomes o on c.rowId = o.rowId group by covariateId)
select covariateId, {_sql_r('(sxy / n - sx * sy / n / n) / sqrt((sxx / n - (sx / n) * (sx / n)) * (syy / n - (sy / n) * (sy / n)))', 'correlation')} from s, y"""
)
def univariable_correlation(spark, sf_dir):
    return reduce.correlation(t.data(spark, sf_dir)).select("covariateId", _r("correlation"))


@query(" select covariateId, bool_and(covariateValue = 1) and (sum(covariateValue * y) = 0 or sum(covariateValue * y) = count(*)) as separable from covariates c join outcomes o on c.rowId = o.rowId group by covariateId")
def univariable_separability(spark, sf_dir):
    return reduce.separability(t.data(spark, sf_dir))


@query(" select count(*) as n_rows, count(distinct stratumId) as n_strata, round(avg(ln(time)), 6) + 0.0 as mean_offset, (select count(distinct covariateId) from covariates) as n_covariates from outcomes")
def data_counts(spark, sf_dir):
    return reduce.counts(t.data(spark, sf_dir, "cpr", add_intercept=False)).select("n_rows", "n_strata", _r("mean_offset"), "n_covariates")


@query(f" select covariateId, {_sql_r('quantile_cont(covariateValue, 0.5)', 'median')}, {_sql_r('quantile_cont(covariateValue, 0.95)', 'q95')} from covariates group by covariateId")
def covariate_quantiles(spark, sf_dir):
    rows = t.covariates(spark, sf_dir)
    half, high = reduce.quantile(rows, "covariateValue", 0.5, ("covariateId",)), reduce.quantile(rows, "covariateValue", 0.95, ("covariateId",))
    return half.withColumnRenamed("value", "median").join(high.withColumnRenamed("value", "q95"), "covariateId").select("covariateId", _r("median"), _r("q95"))


@query(" select round((select sum(covariateValue * covariateValue) / count(distinct covariateId) from covariates) / count(*), 4) + 0.0 as variance from outcomes")
def default_prior_variance(spark, sf_dir):
    return spark.createDataFrame([(reduce.default_variance(t.data(spark, sf_dir)),)], "variance double").select(_r("variance", 4))


_ABS = "abs(covariateValue)"


@query(
    f""", n as (select cast(count(*) as double) as n from outcomes)
select covariateId, case when bool_and(covariateValue = 1) then 1.0 else round(1 / sqrt(sum(covariateValue * covariateValue) / any_value(n) - pow(sum(covariateValue) / any_value(n), 2)), 8) end as stdev,
case when bool_and(covariateValue = 1) then 1.0 else round(1 / max({_ABS}), 8) end as max, case when bool_and(covariateValue = 1) then 1.0 else round(1 / quantile_cont({_ABS}, 0.5), 8) end as median,
case when bool_and(covariateValue = 1) then 1.0 else round(1 / quantile_cont({_ABS}, 0.95), 8) end as q95 from covariates, n group by covariateId"""
)
def normalization_scales(spark, sf_dir):
    data = t.data(spark, sf_dir)
    out = None
    for kind in ("stdev", "max", "median", "q95"):
        one = reduce.scale_factors(data, kind).select("covariateId", rounded(F.col("scale"), 8).alias(kind))
        out = one if out is None else out.join(one, "covariateId")
    return out


@query(" select covariateId, round(sum(covariateValue) / max(covariateValue), 4) + 0.0 as total from covariates group by covariateId")
def normalized_covariates(spark, sf_dir):
    data = reduce.normalized(t.data(spark, sf_dir), "max")
    return data.covariates.groupBy("covariateId").agg(rounded(F.sum("covariateValue"), 4).alias("total"))


@query(
    f"""with e as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding) as v from embeddings)
select cast(i as bigint) as covariateId, count(*) as nzCount, {_sql_r('avg(cast(v as double))', 'nzMean')} from e where v <> 0 group by i""",
    base=False,
)
def dense_covariate_summary(spark, sf_dir):
    e = t.table(spark, sf_dir, "embeddings")
    cov = e.select(F.col("vec_id").alias("rowId"), F.posexplode("embedding").alias("p", "v")).select("rowId", (F.col("p") + 1).cast("long").alias("covariateId"), F.col("v").cast("double").alias("covariateValue"))
    out = e.select(F.col("vec_id").alias("rowId"), (F.col("label") == 0).cast("double").alias("y"))
    return reduce.summary(from_tables(out, cov, checked=False)).select("covariateId", "nzCount", _r("nzMean"))


# --- scores --------------------------------------------------------------------------------------------------------------


def _betas(spark):
    return score.coefficients(spark, t.BETA)


def _predict(model: str):
    def run(spark, sf_dir):
        out = score.predict_new(t.outcomes(spark, sf_dir), t.covariates(spark, sf_dir), _betas(spark), model)
        return out.select("rowId", _r("value"))

    return run


for _model, _link in {"lr": "1 / (1 + exp(-(xb0 - 0.5)))", "pr": "exp(xb0 - 0.5) * time / 1000", "ls": "xb0 - 0.5"}.items():
    _run = _predict(_model)
    if _model == "pr":
        _run = lambda spark, sf_dir: score.predict_new(t.outcomes(spark, sf_dir).withColumn("time", F.col("time") / 1000), t.covariates(spark, sf_dir), _betas(spark), "pr").select("rowId", _r("value"))
    QUERIES[f"predict_new_{_model}"], ORACLE_SQL[f"predict_new_{_model}"] = _run, f"{t.SQL} select rowId, {_sql_r(_link, 'value')} from xbs"


@query(f" select rowId, {_sql_r('xb0', 'value')} from xbs")
def predict_training_cox(spark, sf_dir):
    return score.predict(t.data(spark, sf_dir, "cox"), _betas(spark)).select("rowId", _r("value"))


@query(f" select rowId, {_sql_r('1 / (1 + exp(-(xb0 - 0.5)))', 'value')} from xbs")
def predict_entries_lr(spark, sf_dir):
    """The row-wise form that also scores streams."""
    entries = t.covariates(spark, sf_dir).groupBy("rowId").agg(F.collect_list(F.struct("covariateId", "covariateValue")).alias("covariates"))
    rows = t.outcomes(spark, sf_dir).select("rowId").join(entries, "rowId", "left")
    return score_stream(rows, t.BETA).select("rowId", _r("value"))


@query(f" select {_sql_r('sum(c.covariateValue * b.beta) / (select count(*) from outcomes)', 'value')} from covariates c join betas b on c.covariateId = b.covariateId")
def mean_linear_predictor(spark, sf_dir):
    return score.mean_linear_predictor(t.data(spark, sf_dir), _betas(spark)).select(_r("value"))


_RISK = """, r as (select rowId, stratumId % 5 as s, time, y, status, xb0 as xb, exp(xb0) as e from xbs)"""


@query(
    _RISK
    + """, g as (select time, sum(e) as e, count(*) as n, sum(y) as d from r group by time),
h as (select time, d, sum(e) over w as den, sum(n) over w as n_risk from g window w as (order by time desc)),
k as (select time, n_risk, d, sum(d / den) over (order by time) as hazard from h),
m as (select sum(c.covariateValue * b.beta) / (select count(*) from outcomes) as m from covariates c join betas b on c.covariateId = b.covariateId)
select time, cast(n_risk as bigint) as n_risk, cast(d as bigint) as n_event, round(exp(-hazard * exp(m)), 6) + 0.0 as surv from k, m"""
)
def baseline_survival(spark, sf_dir):
    data = t.data(spark, sf_dir, "cox")
    betas = _betas(spark)
    mean = score.mean_linear_predictor(data, betas).first()["value"]
    rows = survival.baseline_survival(score.linear_predictors(data, betas), mean, ranges=16)
    return rows.select("time", "n_risk", "n_event", _r("surv"))


# --- risk sets -----------------------------------------------------------------------------------------------------------


@query(_RISK + f" select rowId, {_sql_r('sum(e) over (partition by s order by time desc range between unbounded preceding and current row)', 'denominator', 4)} from r")
def risk_set_denominator(spark, sf_dir):
    rows = score.linear_predictors(t.data(spark, sf_dir, "cox"), _betas(spark))
    return survival.at_risk(rows).select("rowId", _r("denominator", 4))


@query(_RISK + f" select rowId, {_sql_r('sum(e) over (order by time desc range between unbounded preceding and current row)', 'denominator', 4)} from r")
def risk_set_denominator_one_stratum(spark, sf_dir):
    rows = score.linear_predictors(t.data(spark, sf_dir, "cox"), _betas(spark)).withColumn("stratumId", F.lit(0))
    return survival.at_risk(rows, ranges=32).select("rowId", _r("denominator", 4))


@query(_RISK + f" select rowId, {_sql_r('sum(e) over (partition by s order by time desc, rowId rows between unbounded preceding and current row)', 'denominator', 4)} from r")
def risk_set_untied(spark, sf_dir):
    rows = score.linear_predictors(t.data(spark, sf_dir, "cox_raw"), _betas(spark))
    return survival.at_risk_untied(rows).select("rowId", _r("denominator", 4))


@query(
    """, g as (select time, count(*) as n, sum(case when status = 0 then 1 else 0 end) as c from outcomes group by time),
h as (select time, 1 - cast(c as double) / sum(n) over (order by time desc) as stay from g),
k as (select time, coalesce(product(stay) over (order by time rows between unbounded preceding and 1 preceding), 1.0) as cw from h)
select o.rowId, cast(o.status as double) as y, round(cw, 6) + 0.0 as censorWeights from outcomes o join k on o.time = k.time"""
)
def fine_gray_weights(spark, sf_dir):
    return survival.censoring_weights(t.outcomes(spark, sf_dir)).select("rowId", "y", _r("censorWeights"))


@query(
    """, c as (select rowId, y, time, unnest([0.0, 600.0, 1200.0, 1800.0]) as start, unnest([1, 2, 3, 4]) as k, unnest([600.0, 1200.0, 1800.0, 1e9]) as stop from outcomes),
e as (select cast(k as bigint) as stratumId, rowId as subjectId, case when time <= stop then y else 0.0 end as y, cast(least(time, stop) - start as double) as time from c where start < time),
n as (select *, row_number() over (order by stratumId, subjectId) as p from e where stratumId > 1)
select stratumId, subjectId, subjectId as rowId, y, time from e where stratumId = 1 union all
select stratumId, subjectId, (select max(rowId) from outcomes) + p as rowId, y, time from n"""
)
def split_time_episodes(spark, sf_dir):
    return survival.split_time(t.outcomes(spark, sf_dir), [600, 1200, 1800])


@query(
    """, c as (select rowId, time, unnest([0.0, 600.0, 1200.0, 1800.0]) as start, unnest([1, 2, 3, 4]) as k from outcomes),
e as (select k, rowId from c where start < time)
select cast(case when k > 1 and covariateId in (101, 102) then 501 + 2 * (k - 2) + covariateId - 100 else covariateId end as bigint) as covariateId, count(*) as n from covariates v join e on v.rowId = e.rowId group by 1"""
)
def time_varying_covariates(spark, sf_dir):
    episodes = survival.split_time(t.outcomes(spark, sf_dir), [600, 1200, 1800])
    return survival.time_varying(episodes, t.covariates(spark, sf_dir), [101, 102]).groupBy("covariateId").agg(F.count("*").alias("n"))


_ONE_X = """, r as (select o.rowId, o.stratumId % 5 as s, o.time, o.y, coalesce(c.covariateValue, 0.0) as x, exp(coalesce(c.covariateValue, 0.0) * 0.002) as e from outcomes o left join (select * from covariates where covariateId = 500) c on o.rowId = c.rowId)"""


def _one_x(spark, sf_dir):
    data = t.data(spark, sf_dir, "cox")
    return score.linear_predictors(data, score.coefficients(spark, {500: 0.002})), data.covariates.filter("covariateId = 500")


@query(_ONE_X + f" select rowId, s as stratumId, time, {_sql_r('residual', 'residual')} from (select rowId, s, time, y, x - sum(e * x) over w / sum(e) over w as residual from r window w as (partition by s order by time desc range between unbounded preceding and current row)) where y = 1")
def schoenfeld_residuals(spark, sf_dir):
    rows, x = _one_x(spark, sf_dir)
    return survival.schoenfeld(rows, x).select("rowId", "stratumId", "time", _r("residual"))


@query(
    _ONE_X
    + """, q as (select s, time, y, x, sum(e) over w as d0, sum(e * x) over w as n1, sum(e * x * x) over w as n2 from r window w as (partition by s order by time desc range between unbounded preceding and current row)),
v as (select time, x - n1 / d0 as res, n2 / d0 - (n1 / d0) * (n1 / d0) as var, time - avg(time) over () as c from q where y = 1),
z as (select sum(c * res) as u, sum(var) as h11, sum(c * var) as h12, sum(c * c * var) as h22 from v)
select round(u * u * h11 / (h11 * h22 - h12 * h12), 5) + 0.0 as chisq, 1 as df from z"""
)
def proportionality_score(spark, sf_dir):
    rows, x = _one_x(spark, sf_dir)
    return survival.proportionality(rows, x).select(_r("chisq", 5), "df")


# --- likelihoods at fixed coefficients -----------------------------------------------------------------------------------

_IDS = [101, 102, 103, 500, 501]
_X0 = "(xb0 - 0.5)"
_LOGFACT = "0.0"  # outcomes are 0 or 1
_FG = """, f as (select rowId, stratumId % 5 as s, time, status as y, 1 - time / 5000 as cw, exp(xb0) as e, xb0 as xb from xbs),
fg as (select s, time, sum(e) as e, sum(case when y = 1 then 1.0 else 0.0 end) as n, sum(case when y = 2 then e / cw else 0.0 end) as c, max(cw) as cw from f group by s, time),
fd as (select s, time, n, cw, sum(e) over (partition by s order by time desc) + cw * coalesce(sum(c) over (partition by s order by time rows between unbounded preceding and 1 preceding), 0) as d from fg)"""
_COX = _RISK + """, g as (select s, time, sum(e) as e, sum(y) as n from r group by s, time), d as (select s, time, n, sum(e) over (partition by s order by time desc) as d from g)"""
_RAW = _RISK + """, d as (select s, time, y as n, sum(e) over (partition by s order by time desc, rowId rows between unbounded preceding and current row) as d from r)"""
_CLR = """, g as (select stratumId, sum(y) as n, sum(exp(xb0)) as d, sum(y * xb0) as num, sum(time * exp(xb0)) as dt, sum(y * ln(time)) as offs, sum(exp(xb0 + ln(time))) as dp, sum(y * (xb0 + ln(time))) as nump from xbs group by stratumId)"""
_EVENTS = "(select sum(y * xb) from r)"
_LEVELS = {
    "ls": f"{t.SQL} select round(sum(-(y - {_X0}) * (y - {_X0})), 3) + 0.0 as value from xbs",
    "pr": f"{t.SQL} select round(sum(y * ({_X0} + ln(time)) - exp({_X0} + ln(time))), 3) + 0.0 as value from xbs",
    "lr": f"{t.SQL} select round(sum(y * {_X0} - ln(1 + exp({_X0}))), 3) + 0.0 as value from xbs",
    "clr": f"{t.SQL}{_CLR} select round(sum(num - n * ln(d)), 3) + 0.0 as value from g",
    "clr_efron": f"{t.SQL}{_CLR} select round(sum(num - n * ln(d)), 3) + 0.0 as value from g",
    "cpr": f"{t.SQL}{_CLR} select round(sum(nump - n * ln(dp)), 3) + 0.0 as value from g",
    "sccs": f"{t.SQL}{_CLR} select round(sum(num - n * ln(dt) + offs), 3) + 0.0 as value from g",
    "cox": f"{t.SQL}{_COX} select round({_EVENTS} - (select sum(n * ln(d)) from d), 3) + 0.0 as value",
    "cox_time": f"{t.SQL}{_COX} select round({_EVENTS} - (select sum(n * ln(d)) from d), 3) + 0.0 as value",
    "cox_raw": f"{t.SQL}{_RAW} select round({_EVENTS} - (select sum(n * ln(d)) from d), 3) + 0.0 as value",
    "fgr": f"{t.SQL}{_FG} select round((select sum(case when y = 1 then xb else 0.0 end) from f) - (select sum(n * ln(d)) from fd), 3) + 0.0 as value",
}


def _level(model: str):
    def run(spark, sf_dir):
        data = t.data(spark, sf_dir, model, **({} if model in ("ls", "pr", "lr") else {"add_intercept": False}))
        return likelihood.log_likelihood(data, _betas(spark)).select(rounded(F.col("value"), 3).alias("value"))

    return run


for _model, _statement in _LEVELS.items():
    QUERIES[f"log_likelihood_{_model}"] = _level(_model)
    ORACLE_SQL[f"log_likelihood_{_model}"] = _statement


_SLOPES = {
    "ls": f" select rowId, 2 * (y - {_X0}) as a from xbs",
    "pr": f" select rowId, y - exp({_X0} + ln(time)) as a from xbs",
    "lr": f" select rowId, y - 1 / (1 + exp(-{_X0})) as a from xbs",
    "clr": " select rowId, y - exp(xb0) * sum(y) over (partition by stratumId) / sum(exp(xb0)) over (partition by stratumId) as a from xbs",
    "cpr": " select rowId, y - exp(xb0) * time * sum(y) over (partition by stratumId) / sum(exp(xb0) * time) over (partition by stratumId) as a from xbs",
    "sccs": " select rowId, y - exp(xb0) * time * sum(y) over (partition by stratumId) / sum(exp(xb0) * time) over (partition by stratumId) as a from xbs",
    "cox": " select rowId, y - e * h as a from r join (select s, time, sum(n / d) over (partition by s order by time) as h from d) k using (s, time)",
    "cox_time": " select rowId, y - e * h as a from r join (select s, time, sum(n / d) over (partition by s order by time) as h from d) k using (s, time)",
    "cox_raw": """ select rowId, y - e * sum(y / d) over (partition by s order by time, rowId desc rows between unbounded preceding and current row) as a from
 (select rowId, s, time, y, e, sum(e) over (partition by s order by time desc, rowId rows between unbounded preceding and current row) as d from r)""",
    "fgr": """ select rowId, case when y = 1 then 1.0 else 0.0 end - e * (h + case when y = 2 then m / cw else 0.0 end) as a from f join
 (select s, time, sum(n / d) over (partition by s order by time) as h, coalesce(sum(n * cw / d) over (partition by s order by time desc rows between unbounded preceding and 1 preceding), 0.0) as m from fd) k using (s, time)""",
}


def _slope(model: str):
    def run(spark, sf_dir):
        data = t.data(spark, sf_dir, model, add_intercept=False) if model not in ("ls", "pr", "lr") else t.data(spark, sf_dir, model)
        return likelihood.gradient(data, _betas(spark)).filter("i > 0").select(F.col("i").alias("covariateId"), rounded(F.col("value"), 3).alias("value"))

    return run


for _model, _body in _SLOPES.items():
    QUERIES[f"gradient_{_model}"] = _slope(_model)
    ORACLE_SQL[f"gradient_{_model}"] = f"{t.SQL}{ {'cox': _COX, 'cox_time': _COX, 'cox_raw': _RISK, 'fgr': _FG}.get(_model, '')}, a as ({_body}) select covariateId, round(sum(a * covariateValue), 3) + 0.0 as value from a join covariates c on a.rowId = c.rowId group by covariateId"


@query(
    """, b as (select rowId, exp(-(xb0 - 0.5)) / pow(1 + exp(-(xb0 - 0.5)), 2) as b from xbs)
select c.covariateId as i, d.covariateId as j, round(sum(b * c.covariateValue * d.covariateValue), 3) + 0.0 as value from b join covariates c on b.rowId = c.rowId join covariates d on c.rowId = d.rowId and c.covariateId <= d.covariateId
where c.covariateId in (101, 102, 103, 500, 501) and d.covariateId in (101, 102, 103, 500, 501) group by 1, 2"""
)
def information_lr(spark, sf_dir):
    got = likelihood.information(t.data(spark, sf_dir), _betas(spark), _IDS)
    return got.select("i", "j", rounded(F.col("value"), 3).alias("value"))


@query(
    """, k as (select c.rowId, covariateId, covariateValue from covariates c where covariateId in (101, 102, 103, 500, 501)),
g as (select stratumId, sum(y) as n, sum(exp(xb0)) as d from xbs group by stratumId),
p as (select x.stratumId, c.covariateId as i, e.covariateId as j, sum(exp(xb0) * c.covariateValue * e.covariateValue) as n2 from xbs x join k c on x.rowId = c.rowId join k e on c.rowId = e.rowId and c.covariateId <= e.covariateId group by 1, 2, 3),
m as (select x.stratumId, covariateId as i, sum(exp(xb0) * covariateValue) as n1 from xbs x join k on x.rowId = k.rowId group by 1, 2),
u as (select i, j, n * n2 / d as v from p join g on p.stratumId = g.stratumId union all select a.i, b.i, -n * (a.n1 / d) * (b.n1 / d) from m a join m b on a.stratumId = b.stratumId and a.i <= b.i join g on a.stratumId = g.stratumId)
select i, j, round(sum(v), 3) + 0.0 as value from u group by i, j"""
)
def information_clr(spark, sf_dir):
    got = likelihood.information(t.data(spark, sf_dir, "clr", add_intercept=False), _betas(spark), _IDS)
    return got.select("i", "j", rounded(F.col("value"), 3).alias("value"))


def _information(model: str, ids: list[int], digits: int = 3):
    def run(spark, sf_dir):
        got = likelihood.information(t.data(spark, sf_dir, model, add_intercept=False), _betas(spark), ids)
        return got.select("i", "j", rounded(F.col("value"), digits).alias("value"))

    return run


for _model in ("cpr", "sccs"):
    QUERIES[f"information_{_model}"] = _information(_model, _IDS)
    ORACLE_SQL[f"information_{_model}"] = ORACLE_SQL["information_clr"].replace("exp(xb0)", "exp(xb0) * time")
QUERIES["information_fgr"] = _information("fgr", [101, 500], 2)
ORACLE_SQL["information_fgr"] = f"""{t.SQL}, f as (select x.rowId, stratumId % 5 as s, time, status as y, 1 - time / 5000 as cw, exp(xb0) as e, coalesce(a.covariateValue, 0.0) as a, coalesce(b.covariateValue, 0.0) as b from xbs x
 left join (select * from covariates where covariateId = 101) a on x.rowId = a.rowId left join (select * from covariates where covariateId = 500) b on x.rowId = b.rowId),
g as (select s, time, max(cw) as cw, sum(case when y = 1 then 1.0 else 0.0 end) as n, {", ".join(f"sum(e * {m}) as r{k}, sum(case when y = 2 then e * {m} / cw else 0.0 end) as c{k}" for k, m in enumerate(("1", "a", "b", "a * a", "a * b", "b * b")))} from f group by s, time),
z as (select n, {", ".join(f"sum(r{k}) over (partition by s order by time desc) + cw * coalesce(sum(c{k}) over (partition by s order by time rows between unbounded preceding and 1 preceding), 0) as s{k}" for k in range(6))} from g)
select cast(101 as bigint) as i, cast(101 as bigint) as j, round(sum(n * (s3 / s0 - s1 * s1 / s0 / s0)), 2) + 0.0 as value from z union all
select cast(101 as bigint), cast(500 as bigint), round(sum(n * (s4 / s0 - s1 * s2 / s0 / s0)), 2) + 0.0 from z union all
select cast(500 as bigint), cast(500 as bigint), round(sum(n * (s5 / s0 - s2 * s2 / s0 / s0)), 2) + 0.0 from z"""


@query(
    _COX
    + """, k as (select rowId, covariateId, covariateValue from covariates where covariateId in (101, 500)),
h as (select s, time, sum(n / d) over (partition by s order by time) as h from d),
f as (select c.covariateId as i, e.covariateId as j, sum(r.e * h.h * c.covariateValue * e.covariateValue) as v from r join h using (s, time) join k c on r.rowId = c.rowId join k e on c.rowId = e.rowId and c.covariateId <= e.covariateId group by 1, 2),
w as (select r.s, r.time, sum(case when k.covariateId = 101 then e * covariateValue else 0.0 end) as a, sum(case when k.covariateId = 500 then e * covariateValue else 0.0 end) as b from r join k on r.rowId = k.rowId group by 1, 2),
z as (select d.s, d.time, n, d, sum(coalesce(a, 0)) over o / d as a, sum(coalesce(b, 0)) over o / d as b from d left join w on d.s = w.s and d.time = w.time window o as (partition by d.s order by d.time desc)),
u as (select * from f union all select 101, 101, -sum(n * a * a) from z union all select 101, 500, -sum(n * a * b) from z union all select 500, 500, -sum(n * b * b) from z)
select cast(i as bigint) as i, cast(j as bigint) as j, round(sum(v), 2) + 0.0 as value from u group by 1, 2"""
)
def information_cox(spark, sf_dir):
    got = likelihood.information(t.data(spark, sf_dir, "cox"), _betas(spark), [101, 500])
    return got.select("i", "j", rounded(F.col("value"), 2).alias("value"))


def _sizes(spark, sf_dir, model):
    """An indicator of each size of part in an order as its quantity in hundreds: fifty covariates, and their coefficients."""
    data = t.data(spark, sf_dir, model)
    lines = t.table(spark, sf_dir, "lineitem").join(t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    cov = lines.groupBy(F.col("l_orderkey").alias("rowId"), (1000 + F.col("p_size")).cast("long").alias("covariateId")).agg((F.sum("l_quantity") / 100).alias("covariateValue"))
    betas = spark.range(1001, 1051).select(F.lit(0).alias("task"), F.col("id").alias("covariateId"), (F.col("id") % 5 / 10.0).alias("beta"))
    return replace(data, covariates=cov), betas


_SIZES = """, k as (select l_orderkey as rowId, cast(1000 + p_size as bigint) as i, sum(l_quantity) / 100 as x from lineitem join part on p_partkey = l_partkey group by 1, 2),
xs as (select rowId, sum(x * (i % 5) / 10.0) as xb from k group by rowId), r as (select o.rowId, o.stratumId % 5 as s, o.time, o.y, o.status, coalesce(xs.xb, 0.0) as xb from outcomes o left join xs on o.rowId = xs.rowId)"""
_SIZES_END = " select i, j, round(sum(v), 3) + 0.0 as value from u group by i, j"


def _many(model):
    def run(spark, sf_dir):
        data, betas = _sizes(spark, sf_dir, model)
        got = likelihood.information(data, betas, list(range(1001, 1051)))
        return got.select("i", "j", rounded(F.col("value"), 3).alias("value"))

    return run


QUERIES["information_lr_many"] = _many("lr")
ORACLE_SQL["information_lr_many"] = t.SQL + _SIZES + ", u as (select a.i, b.i as j, a.x * b.x * exp(-xb) / (1 + exp(-xb)) / (1 + exp(-xb)) as v from r join k a on r.rowId = a.rowId join k b on r.rowId = b.rowId and a.i <= b.i)" + _SIZES_END
#: Of cox and fgr: sums by time, running sums of all covariates at all times, and the sums over rows less those over times with events.
for _model in ("cox", "fgr"):
    _fg = _model == "fgr"
    QUERIES[f"information_{_model}_many"] = _many(_model)
    ORACLE_SQL[f"information_{_model}_many"] = (
        t.SQL
        + _SIZES
        + f""", q as (select *, exp(xb) as e, {"case when status = 1 then 1.0 else 0.0 end" if _fg else "y"} as ev, {"1 - time / 5000" if _fg else "1.0"} as cw, {"case when status = 2 then 1.0 else 0.0 end" if _fg else "0.0"} as rival from r),
g as (select s, time, max(cw) as cw, sum(e) as e, sum(ev) as n, sum(rival * e / cw) as c from q group by s, time),
d as (select s, time, n, cw, sum(e) over (partition by s order by time desc) + cw * coalesce(sum(c) over (partition by s order by time rows between unbounded preceding and 1 preceding), 0) as d from g),
h as (select s, time, sum(n / d) over (partition by s order by time) as h, coalesce(sum(cw * n / d) over (partition by s order by time desc rows between unbounded preceding and 1 preceding), 0) as later from d),
w as (select q.s, q.time, k.i, sum(e * x) as ex, sum(rival * e * x / cw) as cx from q join k on q.rowId = k.rowId group by 1, 2, 3),
z as (select d.s, d.time, d.n, c.i, (sum(coalesce(ex, 0)) over (partition by d.s, c.i order by d.time desc) + d.cw * coalesce(sum(coalesce(cx, 0)) over (partition by d.s, c.i order by d.time rows between unbounded preceding and 1 preceding), 0)) / d.d as m
 from d cross join (select distinct i from k) c left join w on d.s = w.s and d.time = w.time and c.i = w.i),
u as (select a.i, b.i as j, a.x * b.x * q.e * (h.h + q.rival * h.later / q.cw) as v from q join h on q.s = h.s and q.time = h.time join k a on q.rowId = a.rowId join k b on q.rowId = b.rowId and a.i <= b.i
 union all select a.i, b.i, -a.n * a.m * b.m from (select * from z where n > 0) a join (select * from z where n > 0) b on a.s = b.s and a.time = b.time and a.i <= b.i)"""
        + _SIZES_END
    )


@query(_CLR.replace("sum(y) as n", "sum(case when rowId % 2 = 0 then y else 0 end) as n").replace("sum(y * xb0) as num", "sum(case when rowId % 2 = 0 then y * xb0 else 0 end) as num") + " select round(sum(num - n * ln(d)), 3) + 0.0 as value from g")
def predictive_log_likelihood(spark, sf_dir):
    data = t.data(spark, sf_dir, "clr", add_intercept=False)
    held = data.outcomes.select("rowId", (1 - F.col("rowId") % 2).cast("double").alias("w"))
    return likelihood.log_likelihood(data, _betas(spark), weights=held, predictive=True).select(rounded(F.col("value"), 3).alias("value"))


@query(
    _RISK
    + """, h as (select * from r where rowId % 2 = 0), g as (select s, time, sum(e) as e, sum(y) as n from h group by s, time),
d as (select n, sum(e) over (partition by s order by time desc) as d from g) select round((select sum(y * xb) from h) - (select sum(n * ln(d)) from d), 3) + 0.0 as value"""
)
def predictive_log_likelihood_cox(spark, sf_dir):
    """Held-out rows make risk sets of their own."""
    data = t.data(spark, sf_dir, "cox")
    held = data.outcomes.select("rowId", (1 - F.col("rowId") % 2).cast("double").alias("w"))
    return likelihood.log_likelihood(data, _betas(spark), weights=held, predictive=True).select(rounded(F.col("value"), 3).alias("value"))


def _proportionality_sql(g: str) -> str:
    return (
        _ONE_X
        + f""", k as (select time, sum(y) as k, count(*) as n from r group by time), ranks as (select time, sum(k) over (order by time) - k + (k + 1) / 2 as rank from k),
q as (select s, time, y, x, sum(e) over w as d0, sum(e * x) over w as n1, sum(e * x * x) over w as n2 from r window w as (partition by s order by time desc range between unbounded preceding and current row)),
v as (select x - n1 / d0 as res, n2 / d0 - (n1 / d0) * (n1 / d0) as var, {g} - avg({g}) over () as c from q join ranks using (time) where y = 1),
z as (select sum(c * res) as u, sum(var) as h11, sum(c * var) as h12, sum(c * c * var) as h22 from v)
select round(u * u * h11 / (h11 * h22 - h12 * h12), 5) + 0.0 as chisq, 1 as df from z"""
    )


@query(_proportionality_sql("rank"))
def proportionality_rank(spark, sf_dir):
    rows, x = _one_x(spark, sf_dir)
    return survival.proportionality(rows, x, "rank").select(_r("chisq", 5), "df")


@query(_proportionality_sql("sqrt(time)"))
def proportionality_of_a_function(spark, sf_dir):
    rows, x = _one_x(spark, sf_dir)
    return survival.proportionality(rows, x, lambda time: F.sqrt(time)).select(_r("chisq", 5), "df")


# --- fits ----------------------------------------------------------------------------------------------------------------


def _few(spark, sf_dir, model, ids=(500,)):
    """The data with few covariates, the quantity in hundreds."""
    out, cov = t.outcomes(spark, sf_dir), t.covariates(spark, sf_dir).filter(F.col("covariateId").isin(*ids))
    if model in ("cox", "cox_time", "cox_raw", "fgr"):
        out = out.withColumn("stratumId", F.col("stratumId") % 5)
    if model == "fgr":
        out = out.withColumns({"y": F.col("status").cast("double"), "censorWeights": 1 - F.col("time") / 5000})
    cov = cov.withColumn("covariateValue", F.when(F.col("covariateId") == 500, F.col("covariateValue") / 100).otherwise(F.col("covariateValue")))
    return from_tables(out, cov, model, checked=False, add_intercept=model in ("ls", "lr", "pr"), size=t.size(spark, sf_dir))


def _estimates(spark, betas):
    return spark.createDataFrame([(int(c), float(b)) for c, b in betas.items()], "covariateId long, estimate double").select("covariateId", rounded(F.col("estimate"), 5).alias("estimate"))


_FEW = """, d as (select o.y, o.stratumId, o.time, coalesce(c.covariateValue, 0.0) / 100 as x from outcomes o left join (select * from covariates where covariateId = 500) c on o.rowId = c.rowId)"""


@query(_FEW + ", f as (select regr_slope(y, x) as b, regr_intercept(y, x) as a from d) select cast(0 as bigint) as covariateId, round(a, 5) + 0.0 as estimate from f union all select cast(500 as bigint), round(b, 5) + 0.0 from f")
def fit_ls(spark, sf_dir):
    return _estimates(spark, fit(_few(spark, sf_dir, "ls")).betas)


def _newton_sql(mean: str, slope: str, start: str = "(select avg(y) from d) / (1 - (select avg(y) from d))") -> str:
    """Eight Newton steps for an intercept and one coefficient."""
    out, previous = _FEW + f", n0 as (select cast(ln({start}) as double) as a, cast(0.0 as double) as b)", "n0"
    for i in range(1, 9):
        s = f"select sum(y - {mean}) as g0, sum((y - {mean}) * x) as g1, sum({slope}) as h00, sum({slope} * x) as h01, sum({slope} * x * x) as h11 from d, {previous}"
        out += f", s{i} as ({s}), n{i} as (select a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as b from {previous}, s{i})"
        previous = f"n{i}"
    return out + f" select cast(0 as bigint) as covariateId, round(a, 5) + 0.0 as estimate from {previous} union all select cast(500 as bigint), round(b, 5) + 0.0 from {previous}"


_P = "1 / (1 + exp(-(a + b * x)))"


@query(_newton_sql(_P, f"({_P}) * (1 - {_P})"))
def fit_lr(spark, sf_dir):
    return _estimates(spark, fit(_few(spark, sf_dir, "lr")).betas)


@query(_newton_sql("time * exp(a + b * x)", "time * exp(a + b * x)", "(select sum(y) / sum(time) from d)"))
def fit_pr(spark, sf_dir):
    """With the logarithm of time as offset."""
    return _estimates(spark, fit(_few(spark, sf_dir, "pr")).betas)


def _newton_clr_sql() -> str:
    out, previous = _FEW + ", n0 as (select cast(0.0 as double) as b)", "n0"
    for i in range(1, 7):
        out += f", s{i} as (select stratumId, sum(y) as n, sum(y * x) as yx, sum(exp(b * x)) as d, sum(x * exp(b * x)) as n1, sum(x * x * exp(b * x)) as n2 from d, {previous} group by stratumId), n{i} as (select b + (select sum(yx - n * n1 / d) / sum(n * (n2 / d - (n1 / d) * (n1 / d))) from s{i}) as b from {previous})"
        previous = f"n{i}"
    return out + f" select cast(500 as bigint) as covariateId, round(b, 5) + 0.0 as estimate from {previous}"


@query(_newton_clr_sql())
def fit_clr(spark, sf_dir):
    return _estimates(spark, fit(_few(spark, sf_dir, "clr")).betas)


def _fit_strata(model: str):
    return lambda spark, sf_dir: _estimates(spark, fit(_few(spark, sf_dir, model)).betas)


for _model in ("cpr", "sccs", "clr_efron"):
    QUERIES[f"fit_{_model}"] = _fit_strata(_model)
    ORACLE_SQL[f"fit_{_model}"] = ORACLE_SQL["fit_clr"] if _model == "clr_efron" else ORACLE_SQL["fit_clr"].replace("exp(b * x)", "time * exp(b * x)")


def _newton_exact_sql(steps: int = 5) -> str:
    """Newton steps with the sums over subsets of each stratum's rows, made row by row: after r rows a holds the sums over subsets of
    k - 1 of them, a1 and a2 their derivatives."""
    out = _FEW.replace("select o.y,", "select o.rowId, o.y,")
    out += """, ranked as (select stratumId, x, y, row_number() over (partition by stratumId order by rowId) as r, sum(y) over (partition by stratumId) as m, count(*) over (partition by stratumId) as n from d),
told as (select stratumId, x, y, r, cast(m as integer) as m, n from ranked where m > 0 and m < n), n0 as (select cast(0.0 as double) as b)"""
    at = lambda a, k: f"coalesce(p.{a}[{k}], 0.0)"
    each = lambda e: f"list_transform(range(1, q.m + 2), lambda k: {e})"
    new = f"{at('a', 'k')} + exp(b * q.x) * {at('a', 'k - 1')}"
    new1 = f"{at('a1', 'k')} + exp(b * q.x) * ({at('a1', 'k - 1')} + q.x * {at('a', 'k - 1')})"
    new2 = f"{at('a2', 'k')} + exp(b * q.x) * ({at('a2', 'k - 1')} + 2 * q.x * {at('a1', 'k - 1')} + q.x * q.x * {at('a', 'k - 1')})"
    mean, square = "p.a1[q.m + 1] / p.a[q.m + 1]", "p.a2[q.m + 1] / p.a[q.m + 1]"
    for i in range(1, steps + 1):
        out += f""", p{i} as (select distinct stratumId, cast(0 as bigint) as r, [cast(1.0 as double)] as a, [cast(0.0 as double)] as a1, [cast(0.0 as double)] as a2 from told
 union all select p.stratumId, p.r + 1, {each(new)}, {each(new1)}, {each(new2)} from p{i} p join told q on p.stratumId = q.stratumId and q.r = p.r + 1, n{i - 1}),
n{i} as (select b + (select sum(q.yx - {mean}) / sum({square} - ({mean}) * ({mean})) from p{i} p join (select stratumId, m, n, sum(y * x) as yx from told group by stratumId, m, n) q on p.stratumId = q.stratumId and p.r = q.n) as b from n{i - 1})"""
    return out + f" select cast(500 as bigint) as covariateId, round(b, 5) + 0.0 as estimate from n{steps}"


@query(_newton_exact_sql())
def fit_clr_exact(spark, sf_dir):
    """All strata as they are, with all their cases."""
    return _estimates(spark, fit(_few(spark, sf_dir, "clr_exact")).betas)


ORACLE_SQL["fit_clr_exact"] = ORACLE_SQL["fit_clr_exact"].replace("with ", "with recursive ", 1)


_TWO = """, f as (select o.rowId, o.stratumId % 5 as s, o.time, {y} as y, o.status, {cw} as cw, coalesce(a.covariateValue, 0.0) as a, coalesce(b.covariateValue, 0.0) / 100 as b from outcomes o
 left join (select * from covariates where covariateId = 101) a on o.rowId = a.rowId left join (select * from covariates where covariateId = 500) b on o.rowId = b.rowId)"""
_MOMENTS = ("1", "a", "b", "a * a", "a * b", "b * b")


def _newton_cox_sql(model: str, steps: int = 7) -> str:
    """Newton steps for the coefficients u of 101 and v of 500."""
    fine_gray, raw = model == "fgr", model == "cox_raw"
    out = _TWO.format(y="cast(case when o.status = 1 then 1 else 0 end as double)" if fine_gray else "o.y", cw="1 - o.time / 5000") + ", n0 as (select cast(0.0 as double) as u, cast(0.0 as double) as v)"
    keys, order, rising = ("s, time, rowId", "time desc, rowId", "time, rowId desc") if raw else ("s, time", "time desc", "time")
    for i in range(1, steps + 1):
        sums = ", ".join(f"sum(exp(u * a + v * b) * {m}) as r{k}" + (f", sum(case when status = 2 then exp(u * a + v * b) * {m} / cw else 0.0 end) as c{k}" if fine_gray else "") for k, m in enumerate(_MOMENTS))
        total = lambda k: f"sum(r{k}) over (partition by s order by {order} rows between unbounded preceding and current row)" + (f" + cw * coalesce(sum(c{k}) over (partition by s order by {rising} rows between unbounded preceding and 1 preceding), 0)" if fine_gray else "")
        out += f""", g{i} as (select {keys}, max(cw) as cw, sum(y) as n, sum(y * a) as ya, sum(y * b) as yb, {sums} from f, n{i - 1} group by {keys}),
z{i} as (select n, ya, yb, {", ".join(f"{total(k)} as s{k}" for k in range(6))} from g{i}),
h{i} as (select sum(ya - n * s1 / s0) as ga, sum(yb - n * s2 / s0) as gb, sum(n * (s3 / s0 - s1 * s1 / s0 / s0)) as haa, sum(n * (s4 / s0 - s1 * s2 / s0 / s0)) as hab, sum(n * (s5 / s0 - s2 * s2 / s0 / s0)) as hbb from z{i}),
n{i} as (select u + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) as u, v + (haa * gb - hab * ga) / (haa * hbb - hab * hab) as v from n{i - 1}, h{i})"""
    return out + f" select cast(101 as bigint) as covariateId, round(u, 5) + 0.0 as estimate from n{steps} union all select cast(500 as bigint), round(v, 5) + 0.0 from n{steps}"


def _fit_times(model: str):
    def run(spark, sf_dir):
        return _estimates(spark, fit(_few(spark, sf_dir, model, (101, 500))).betas)

    return run


for _model in ("cox", "cox_time", "cox_raw", "fgr"):
    QUERIES[f"fit_{_model}"] = _fit_times(_model)
    ORACLE_SQL[f"fit_{_model}"] = t.SQL + _newton_cox_sql(_model)


@query()
def fit_lr_laplace_all(spark, sf_dir):
    return _estimates(spark, fit(t.data(spark, sf_dir, "lr", normalize="stdev"), make_prior("laplace", 0.01)).betas)


@query()
def fit_lr_active_set(spark, sf_dir):
    return _estimates(spark, fit(t.data(spark, sf_dir, "lr", normalize="stdev"), make_prior("laplace", 0.01), Control(active_set=True)).betas)


def _residuals(fitted, variances: float | dict[int, float]) -> DataFrame:
    """(covariateId, residual): how far the gradient at the fit, evaluated anew over all rows and covariates, is from what the Laplace
    prior with the variance asks for: its rate, with the coefficient's sign, or up to it at zero; nothing for the intercept."""
    spark, variance = fitted.data.spark, (lambda c: variances if isinstance(variances, float) else variances[c])
    told = spark.createDataFrame([(c, b, 0.0 if c == 0 else (2 / variance(c)) ** 0.5) for c, b in fitted.betas.items()], "i long, beta double, rate double")
    rows = likelihood.gradient(fitted.data, fitted.frame()).join(F.broadcast(told), "i")  # a row for each covariate of the fit
    off = F.when(F.col("beta") != 0, F.abs(F.col("value") - F.signum("beta") * F.col("rate"))).otherwise(F.greatest(F.abs("value") - F.col("rate"), F.lit(0.0)))
    return rows.select(F.col("i").alias("covariateId"), rounded(off, 2).alias("residual"))


_ALL = " select distinct covariateId, cast(0.0 as double) as residual from covariates"
_ALL_AND_INTERCEPT = _ALL + " union all select cast(0 as bigint), cast(0.0 as double)"


@query(_ALL_AND_INTERCEPT)
def optimality_lr_laplace_all(spark, sf_dir):
    """Nine covariates and the intercept."""
    return _residuals(fit(t.data(spark, sf_dir, "lr", normalize="stdev"), make_prior("laplace", 0.01), Control(tolerance=1e-12)), 0.01)


@query(_ALL_AND_INTERCEPT)
def optimality_lr_active_set(spark, sf_dir):
    """As before on an active set, with variances of some covariates' own."""
    prior = replace(make_prior("laplace", 0.0005), own={101: Laplace(0.1), 500: Laplace(0.00002)})
    fitted = fit(t.data(spark, sf_dir, "lr", normalize="stdev"), prior, Control(active_set=True, tolerance=1e-12))
    return _residuals(fitted, {c: prior.of(c).variance if c else 1.0 for c in fitted.betas})


@query(_ALL_AND_INTERCEPT + _ALL_AND_INTERCEPT.replace(" select distinct", " union all select distinct") * 2)
def optimality_lr_path(spark, sf_dir):
    """Three variances, one after another, screened by the strong rule."""
    fits = fit_path(t.data(spark, sf_dir, "lr", normalize="stdev"), make_prior("laplace"), [0.00001, 0.0005, 0.05], Control(tolerance=1e-12))
    first, *rest = [_residuals(f, f.prior.default.variance) for f in fits]
    for r in rest:
        first = first.union(r)
    return first


def _optimality(model: str, prior: str = "none"):
    def run(spark, sf_dir):
        data = t.data(spark, sf_dir, model)
        cov = data.covariates.withColumn("covariateValue", F.when(F.col("covariateId") == 500, F.col("covariateValue") / 100).otherwise(F.col("covariateValue")))
        if model == "fgr":
            data = replace(data, outcomes=survival.censoring_weights(data.outcomes.withColumn("status", F.col("y")).drop("censorWeights", "y")).drop("status"))
        return _residuals(fit(replace(data, covariates=cov), prior, Control(tolerance=1e-12)), 1e300)

    return run


for _model in ("ls", "lr", "pr", "clr", "cpr", "sccs", "clr_exact", "cox", "cox_raw", "fgr"):
    QUERIES[f"optimality_{_model}"] = _optimality(_model)
    ORACLE_SQL[f"optimality_{_model}"] = t.SQL + (_ALL_AND_INTERCEPT if _model in ("ls", "lr", "pr") else _ALL)


def _optimality_parts(kind: str, variance: float):
    """Orders by the parts they contain, as many covariates as there are parts (their numbers plus one, as one is 0): coefficients are a table, and so are the residuals."""

    def run(spark, sf_dir):
        parts = t.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rowId"), (F.col("l_partkey") + 1).alias("covariateId")).distinct()
        data = from_tables(t.outcomes(spark, sf_dir), parts.withColumn("covariateValue", F.lit(1.0)), "lr", checked=False)
        fitted = fit_table(data, make_prior(kind, variance), Control(tolerance=1e-14, max_iterations=300))
        rows = likelihood.gradient(data, fitted.frame()).withColumnRenamed("i", "covariateId").join(fitted.coefficients, "covariateId")
        b, g, penalised = F.col("beta"), F.col("value"), F.col("covariateId") != 0
        if kind == "normal":
            off = F.abs(g - F.when(penalised, b / variance).otherwise(0.0))
        else:
            rate = F.when(penalised, (2 / variance) ** 0.5).otherwise(0.0)
            off = F.when(b != 0, F.abs(g - F.signum(b) * rate)).otherwise(F.greatest(F.abs(g) - rate, F.lit(0.0)))
        return rows.select("covariateId", rounded(off, 2).alias("residual"))

    return run


for _kind, _variance in (("normal", 0.2), ("laplace", 0.05)):
    QUERIES[f"optimality_lr_parts_{_kind}"] = _optimality_parts(_kind, _variance)
    ORACLE_SQL[f"optimality_lr_parts_{_kind}"] = "select distinct l_partkey + 1 as covariateId, cast(0.0 as double) as residual from lineitem union all select cast(0 as bigint), cast(0.0 as double)"


def _penalised_sql(slope: str, curve: str) -> str:
    """Newton steps of a logistic model with an intercept, as in _newton_sql, with the prior's slope and curvature at b."""
    out, previous = _FEW + f", free as ({_newton_sql(_P, f'({_P}) * (1 - {_P})').split(' select cast(0 as bigint)')[0].split(', n0 as ')[1].join(['with n0 as ', ''])} select a, b from n8), n0 as (select a, b from free)", "n0"
    for i in range(1, 13):
        s = f"select sum(y - {_P}) as g0, sum((y - {_P}) * x) + any_value({slope}) as g1, sum(({_P}) * (1 - {_P})) as h00, sum(({_P}) * (1 - {_P}) * x) as h01, sum(({_P}) * (1 - {_P}) * x * x) + any_value({curve}) as h11 from d, {previous}"
        out += f", s{i} as ({s}), n{i} as (select a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as b from {previous}, s{i})"
        previous = f"n{i}"
    return out + f" select cast(0 as bigint) as covariateId, round(a, 4) + 0.0 as estimate from {previous} union all select cast(500 as bigint), round(b, 4) + 0.0 from {previous}"


def _with_prior(prior):
    def run(spark, sf_dir):
        betas = fit(_few(spark, sf_dir, "lr"), prior, Control(tolerance=1e-12)).betas
        return spark.createDataFrame([(int(c), float(b)) for c, b in betas.items()], "covariateId long, estimate double").select("covariateId", _r("estimate", 4))

    return run


#: Slope and curvature of minus the logarithm of the prior, at b; those of laplace with the sign of the free estimate.
for _name, _prior, _g, _h in (
    ("normal", make_prior("normal", 0.01), "-b / 0.01", "1 / 0.01"),
    ("laplace", make_prior("laplace", 0.5), "-sqrt(2 / 0.5) * sign(b)", "0.0"),
    ("parameterized", parameterized(lambda theta: {500: (theta[0], theta[1])}, (0.5, 0.02), "normal"), "-(b - 0.5) / 0.02", "1 / 0.02"),
):
    QUERIES[f"fit_lr_{_name}"] = _with_prior(_prior)
    ORACLE_SQL[f"fit_lr_{_name}"] = t.SQL + _penalised_sql(_g, _h)


@query(
    """, x as (select o.y, case when c.rowId is null then 0 else 1 end as x from outcomes o left join (select rowId from covariates where covariateId = 103) c on o.rowId = c.rowId),
m as (select cast(sum(x) as double) as n1, cast(sum(1 - x) as double) as n0, sum(y * x) as s1, sum(y * (1 - x)) as s0 from x),
p as (select (s1 + 0.5) / (n1 + 1) as p1, (s0 + s1 - n1 * (s1 + 0.5) / (n1 + 1)) / n0 as p0 from m)
select cast(0 as bigint) as covariateId, round(ln(p0 / (1 - p0)), 4) + 0.0 as estimate from p union all select cast(103 as bigint), round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 4) + 0.0 from p"""
)
def fit_lr_jeffreys(spark, sf_dir):
    betas = fit(_few(spark, sf_dir, "lr", (103,)), "jeffreys", Control(tolerance=1e-13)).betas
    return spark.createDataFrame([(int(c), float(b)) for c, b in betas.items()], "covariateId long, estimate double").select("covariateId", _r("estimate", 4))


def _jeffreys_cox_sql(steps: int = 30) -> str:
    """Steps of the penalised score by the information, with sums over risk sets; x is an indicator, so its powers are itself."""
    out = """, f as (select o.stratumId % 5 as s, o.time, o.y, case when c.rowId is null then 0.0 else 1.0 end as x from outcomes o left join (select rowId from covariates where covariateId = 103) c on o.rowId = c.rowId), n0 as (select cast(0.0 as double) as b)"""
    for i in range(1, steps + 1):
        out += f""", g{i} as (select s, time, sum(exp(b * x)) as e, sum(x * exp(b * x)) as ex, sum(y) as n, sum(y * x) as yx from f, n{i - 1} group by s, time),
z{i} as (select n, yx, sum(ex) over (partition by s order by time desc) / sum(e) over (partition by s order by time desc) as m from g{i}),
h{i} as (select sum(yx - n * m) as g, sum(n * m * (1 - m)) as h, sum(n * m * (1 - m) * (1 - 2 * m)) as t from z{i}), n{i} as (select b + (g + t / (2 * h)) / h as b from n{i - 1}, h{i})"""
    return out + f" select cast(103 as bigint) as covariateId, round(b, 5) + 0.0 as estimate from n{steps}"


@query(_jeffreys_cox_sql(8))
def fit_cox_jeffreys(spark, sf_dir):
    return _estimates(spark, fit(_few(spark, sf_dir, "cox", (103,)), "jeffreys", Control(tolerance=1e-13)).betas)


#: Least squares with two covariates and no intercept: p = x102, q = x500 / 100.
_PAIR = """, x as (select o.y, coalesce(a.covariateValue, 0.0) as p, coalesce(b.covariateValue, 0.0) / 100 as q from outcomes o left join (select * from covariates where covariateId = 102) a on o.rowId = a.rowId
 left join (select * from covariates where covariateId = 500) b on o.rowId = b.rowId), m as (select 2 * sum(p * p) as pp, 2 * sum(p * q) as pq, 2 * sum(q * q) as qq, 2 * sum(p * y) as py, 2 * sum(q * y) as qy from x)"""


def _solved(pp: str, pq: str, qq: str, py: str, qy: str) -> str:
    det = f"(({pp}) * ({qq}) - ({pq}) * ({pq}))"
    return f", b as (select (({qq}) * ({py}) - ({pq}) * ({qy})) / {det} as b1, (({pp}) * ({qy}) - ({pq}) * ({py})) / {det} as b2 from m) select cast(102 as bigint) as covariateId, round(b1, 5) + 0.0 as estimate from b union all select cast(500 as bigint), round(b2, 5) + 0.0 from b"


def _fit_pair(spark, sf_dir, prior):
    data = _few(spark, sf_dir, "ls", (102, 500))
    return _estimates(spark, fit(replace(data, has_intercept=False), prior, Control(tolerance=1e-13)).betas)


@query(_PAIR + _solved("pp + 1 / 0.001 - (1 / 0.001) * (1 / 0.001) / (2 / 0.001 + 1 / 0.002)", "pq - (1 / 0.001) * (1 / 0.001) / (2 / 0.001 + 1 / 0.002)", "qq + 1 / 0.001 - (1 / 0.001) * (1 / 0.001) / (2 / 0.001 + 1 / 0.002)", "py", "qy"))
def fit_ls_hierarchical(spark, sf_dir):
    return _fit_pair(spark, sf_dir, make_prior("normal", [0.001, 0.002], parents={102: 1, 500: 1}))


@query(_PAIR + ", free as (select (qq * py - pq * qy) / (pp * qq - pq * pq) as f1, (pp * qy - pq * py) / (pp * qq - pq * pq) as f2 from m), m1 as (select m.*, sign(f1) as s1, sign(f2) as s2, sign(f1 - f2) as s12 from m, free)" + _solved("pp", "pq", "qq", "py - sqrt(2 / 0.1) * s1 - sqrt(2 / 0.2) * s12", "qy - sqrt(2 / 0.1) * s2 + sqrt(2 / 0.2) * s12").replace("from m) select", "from m1) select"))
def fit_ls_fused(spark, sf_dir):
    return _fit_pair(spark, sf_dir, make_prior("laplace", [0.1, 0.2], neighbours={102: [500], 500: [102]}))


@query(_PAIR + ", free as (select (qq * py - pq * qy) / (pp * qq - pq * pq) as f1, (pp * qy - pq * py) / (pp * qq - pq * pq) as f2 from m)" + "".join(f", r{i} as (select (qq * (py - 0.01 / f1) - pq * (qy - 0.01 / f2)) / (pp * qq - pq * pq) as f1, (pp * (qy - 0.01 / f2) - pq * (py - 0.01 / f1)) / (pp * qq - pq * pq) as f2 from m, {'free' if i == 1 else f'r{i - 1}'})" for i in range(1, 25)) + " select cast(102 as bigint) as covariateId, round(f1, 5) + 0.0 as estimate from r24 union all select cast(500 as bigint), round(f2, 5) + 0.0 from r24")
def fit_ls_barupdate(spark, sf_dir):
    """The fixed point at which each coefficient's gradient is the inverse of its variance times itself."""
    return _fit_pair(spark, sf_dir, make_prior("barupdate", 100.0))


@query(_FEW + ", m as (select count(*) as n, sum(x) as s, sum(x * x) as q from d), v as (select q / (n * q - s * s) / 2 as a, n / (n * q - s * s) / 2 as b from m) select cast(0 as bigint) as covariateId, round(sqrt(a), 6) + 0.0 as se from v union all select cast(500 as bigint), round(sqrt(b), 6) + 0.0 from v")
def standard_errors_ls(spark, sf_dir):
    got = standard_errors(fit(_few(spark, sf_dir, "ls")))
    return spark.createDataFrame([(int(c), s) for c, s in got.items()], "covariateId long, se double").select("covariateId", _r("se"))


@query()
def confidence_intervals(spark, sf_dir):
    fitted = fit(_few(spark, sf_dir, "lr"))
    wald, profile = wald_intervals(fitted), profile_intervals(fitted, [500])
    rows = [("wald", int(c), *v) for c, v in wald.items()] + [("profile", int(c), *v) for c, v in profile.items()]
    return spark.createDataFrame(rows, "kind string, covariateId long, lower double, upper double").select("kind", "covariateId", _r("lower", 2), _r("upper", 2))


@query(
    _newton_sql(_P, f"({_P}) * (1 - {_P})").replace(" select cast(0 as bigint) as covariateId, round(a, 5)", f""", h as (select sum(({_P}) * (1 - {_P})) as h00, sum(({_P}) * (1 - {_P}) * x) as h01, sum(({_P}) * (1 - {_P}) * x * x) as h11 from d, n8),
w as (select cast(0 as bigint) as covariateId, a as beta, sqrt(h11 / (h00 * h11 - h01 * h01)) as se from n8, h union all select cast(500 as bigint), b, sqrt(h00 / (h00 * h11 - h01 * h01)) from n8, h)
select covariateId, round(beta - 1.959963984540054 * se, 4) + 0.0 as lower, round(beta + 1.959963984540054 * se, 4) + 0.0 as upper from w -- """)
)
def wald_intervals_lr(spark, sf_dir):
    got = wald_intervals(fit(_few(spark, sf_dir, "lr")))
    return spark.createDataFrame([(int(c), *v) for c, v in got.items()], "covariateId long, lower double, upper double").select("covariateId", _r("lower", 4), _r("upper", 4))


_COX_ONE = """, f as (select o.rowId, o.stratumId % 5 as s, o.time, o.y, coalesce(c.covariateValue, 0.0) / 100 as x from outcomes o left join (select * from covariates where covariateId = 500) c on o.rowId = c.rowId)"""


def _cox_level_sql(points: str, number: int | str) -> str:
    """g, z and v: (point, level, slope) of the log-likelihood at points (point)."""
    return f""", g{number} as (select point, s, time, sum(exp(point * x)) as e, sum(x * exp(point * x)) as ex, sum(y) as n, sum(y * x) as yx from f, {points} group by point, s, time),
z{number} as (select point, n, yx, sum(e) over (partition by point, s order by time desc) as d, sum(ex) over (partition by point, s order by time desc) as n1 from g{number}),
v{number} as (select point, sum(yx) * point - sum(n * ln(d)) as level, sum(yx - n * n1 / d) as slope from z{number} group by point)"""


@query(_COX_ONE + ", points as (select unnest([-0.2, -0.1, 0.0, 0.1, 0.2]) as point)" + _cox_level_sql("points", 0) + " select cast(point as double) as point, round(level, 3) + 0.0 as value from v0")
def profile_points(spark, sf_dir):
    fitted = fit(_few(spark, sf_dir, "cox"))
    return profile_likelihood(fitted, 500, [-0.2, -0.1, 0.0, 0.1, 0.2]).select("point", _r("value", 3))


def _profile_interval_sql() -> str:
    """The mode by Newton steps on the slope by differences of nearby points, then both ends by Newton steps on the level."""
    out, last = _COX_ONE + ", b0 as (select cast(0.0 as double) as point)", "b0"
    for i in range(1, 7):
        out += f", e{i} as (select point - 1e-4 as point from {last} union all select point + 1e-4 from {last})" + _cox_level_sql(f"e{i}", f"m{i}")
        out += f", b{i} as (select point - (select avg(slope) from vm{i}) * 2e-4 / (select max_by(slope, point) - min_by(slope, point) from vm{i}) as point from {last})"
        last = f"b{i}"
    out += _cox_level_sql(last, "top") + f", c0 as (select side, (select point from {last}) + side * 1.96 / sqrt(-(select (max_by(slope, point) - min_by(slope, point)) / 2e-4 from vm6)) as point from (select unnest([-1, 1]) as side))"
    for i in range(1, 5):
        out += _cox_level_sql(f"c{i - 1}", f"c{i}") + f", c{i} as (select side, c.point - (v.level - (select level from vtop) + 1.9207294103470618) / v.slope as point from c{i - 1} c join vc{i} v on c.point = v.point)"
    return out + " select cast(500 as bigint) as covariateId, round(max(case when side < 0 then point end), 2) + 0.0 as lower, round(max(case when side > 0 then point end), 2) + 0.0 as upper from c4"


@query(_profile_interval_sql())
def profile_interval_cox(spark, sf_dir):
    got = profile_intervals(fit(_few(spark, sf_dir, "cox")), [500], tolerance=1e-4)
    return spark.createDataFrame([(int(c), *v) for c, v in got.items()], "covariateId long, lower double, upper double").select("covariateId", _r("lower", 2), _r("upper", 2))


@query()
def cox_diagnostics(spark, sf_dir):
    fitted = fit(_few(spark, sf_dir, "cox"))
    z = test_proportionality(fitted, "rank")
    total = residuals(fitted).agg(rounded(F.sum("residual"), 2).alias("residual_sum"))
    return total.withColumns({"chisq": F.round(F.lit(float(z["chisq"])), 4), "curve_points": F.lit(baseline(fitted).count())})


@query(" select rowId, cast(rowId % 5 as int) as fold from outcomes")
def folds_by_id(spark, sf_dir):
    return folds(t.data(spark, sf_dir), 5, deterministic=True)


@query(" select count(*) as n, cast(5 as bigint) as folds, true as even from outcomes")
def folds_by_hash(spark, sf_dir):
    sizes = folds(t.data(spark, sf_dir), 5, seed=3).groupBy("fold").count()
    return sizes.agg(F.sum("count").alias("n"), F.count("*").alias("folds"), (F.max("count") - F.min("count") <= 1).alias("even"))


@query()
def cross_validation(spark, sf_dir):
    search = Search(kind="grid", fold=5, lower=0.01, upper=1.0, grid_steps=3, deterministic=True)
    got = cross_validated(_few(spark, sf_dir, "lr", (101, 102, 500)), make_prior("laplace"), search)
    return spark.createDataFrame([(float(v), float(s)) for v, s in got.cross_validation["points"].items()], "variance double, value double").select(_r("variance"), _r("value", 3))


def _cross_validation_sql() -> str:
    """Newton steps of a logistic model with a normal prior for each variance and fold, on weighted rows; then the rows left out."""
    out = _FEW.replace("select o.y,", "select o.rowId % 5 as fold, cast(1 + o.rowId % 3 as double) as w, o.y,")
    out += ", tasks as (select k, v from (select unnest([0, 1, 2, 3, 4]) as k), (select cast(unnest([0.01, 0.1, 1.0]) as double) as v)), n0 as (select k, v, cast(ln((select avg(y) from d) / (1 - (select avg(y) from d))) as double) as a, cast(0.0 as double) as b from tasks)"
    for i in range(1, 10):
        out += f""", s{i} as (select k, v, any_value(a) as a, any_value(b) as b, sum(w * (y - {_P})) as g0, sum(w * (y - {_P}) * x) - any_value(b / v) as g1, sum(w * {_P} * (1 - {_P})) as h00, sum(w * {_P} * (1 - {_P}) * x) as h01, sum(w * {_P} * (1 - {_P}) * x * x) + any_value(1 / v) as h11
 from d, n{i - 1} where fold <> k group by k, v), n{i} as (select k, v, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as b from s{i})"""
    out += ", held as (select k, v, sum(w * (y * (a + b * x) - ln(1 + exp(a + b * x)))) as value from d, n9 where fold = k group by k, v)"
    return out + " select round(v, 6) + 0.0 as variance, round(avg(value), 3) + 0.0 as value from held group by v"


@query(_cross_validation_sql())
def cross_validation_weighted(spark, sf_dir):
    """With the users' weights in and out of the folds."""
    data = _few(spark, sf_dir, "lr")
    data = replace(data, outcomes=data.outcomes.withColumn("weights", (1 + F.col("rowId") % 3).cast("double")))
    search = Search(kind="grid", fold=5, lower=0.01, upper=1.0, grid_steps=3, deterministic=True)
    got = cross_validated(data, make_prior("normal"), search, Control(tolerance=1e-12))
    return spark.createDataFrame([(float(v), float(s)) for v, s in got.cross_validation["points"].items()], "variance double, value double").select(_r("variance"), _r("value", 3))


@query()
def bootstrap_summary(spark, sf_dir):
    got, _ = bootstrap(fit(_few(spark, sf_dir, "lr")), 20, seed=5)
    return spark.createDataFrame([(int(c), *map(float, s.values())) for c, s in got.items()], "covariateId long, original double, bias double, std_err double, bpi_lower double, bpi_upper double")


_MEANS = "select covariateId, avg(covariateValue) as m, 1.96 * stddev_samp(covariateValue) / sqrt(count(*)) as half, quantile_cont(covariateValue, 0.5) as truth from covariates where covariateId >= 500 group by covariateId"


@query(f" select round(avg(pow(m - truth, 2)), 6) + 0.0 as value, round(avg(case when truth between m - half and m + half then 1.0 else 0.0 end), 6) + 0.0 as covered from ({_MEANS})")
def simulation_metrics(spark, sf_dir):
    """Means as estimates of medians, with their intervals."""
    rows = t.covariates(spark, sf_dir).filter("covariateId >= 500").groupBy("covariateId")
    value = F.col("covariateValue")
    rows = rows.agg(F.avg(value).alias("estimate"), (1.96 * F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("half"), F.percentile(value, F.lit(0.5)).alias("logRr"))
    truth, intervals = rows.select("covariateId", "logRr"), rows.select("covariateId", (F.col("estimate") - F.col("half")).alias("lower"), (F.col("estimate") + F.col("half")).alias("upper"))
    return mse(rows.select("covariateId", "estimate"), truth).select(_r("value")).join(coverage(intervals, truth).select(rounded(F.col("value")).alias("covered")), F.lit(True))  # one row each
