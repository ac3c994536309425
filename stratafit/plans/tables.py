"""The business tables as outcomes and covariates: what the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .data import RegressionData, dealt, from_tables

BETA = {0: -0.5, 101: 0.1, 102: -0.2, 103: 0.05, 500: 0.002, 501: 0.3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size(spark: SparkSession, sf_dir: str) -> int:
    """The number of orders, as the file's footers have it."""
    return table(spark, sf_dir, "orders").count()


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a row: its customer the stratum, high priority the outcome, days since the start of 1995 the time."""
    o = dealt(table(spark, sf_dir, "orders"), size(spark, sf_dir), "o_orderkey")
    return o.select(
        F.col("o_orderkey").alias("rowId"),
        F.col("o_custkey").alias("stratumId"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("double").alias("y"),
        (F.datediff("o_orderdate", F.lit("1995-01-01")) + 1).cast("double").alias("time"),
        F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("status"),
    )


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of an order's line numbers, and the sums of its quantities (500) and discounts (501), in one aggregation. Lines are
    dealt as orders are, so that the two meet where they stand."""
    li = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), size(spark, sf_dir), "l_orderkey")
    rows = li.groupBy(F.col("l_orderkey").alias("rowId")).agg(F.collect_set("l_linenumber").alias("lines"), F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("d"))
    entry = lambda i, v: F.struct(F.lit(i).cast("long").alias("covariateId"), v.alias("covariateValue"))
    lines = F.transform("lines", lambda n: F.struct((n + 100).cast("long").alias("covariateId"), F.lit(1.0).alias("covariateValue")))
    return rows.select("rowId", F.explode(F.concat(lines, F.array(entry(500, F.col("q")), entry(501, F.col("d"))))).alias("e")).select("rowId", "e.*").filter("covariateValue <> 0")


def data(spark: SparkSession, sf_dir: str, model: str = "lr", **options: object) -> RegressionData:
    """The data object; survival models are stratified by customer group (id modulo 5) so that risk sets are large."""
    out = outcomes(spark, sf_dir)
    if model in ("cox", "cox_raw", "cox_time", "fgr"):
        out = out.withColumn("stratumId", F.col("stratumId") % 5)
    if model == "fgr":
        out = out.withColumns({"y": F.col("status").cast("double"), "censorWeights": 1 - F.col("time") / 5000})
    return from_tables(out, covariates(spark, sf_dir), model, checked=False, size=size(spark, sf_dir), **options)


#: The same in SQL, as the first common table expressions of the oracles.
SQL = """with outcomes as (select o_orderkey as rowId, o_custkey as stratumId,
  cast(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end as double) as y,
  cast(date_diff('day', cast('1995-01-01' as timestamp), o_orderdate) + 1 as double) as time,
  case when o_orderstatus = 'O' then 0 when o_orderstatus = 'F' then 1 else 2 end as status from orders),
covariates as (select rowId, covariateId, covariateValue from (
  select distinct l_orderkey as rowId, cast(100 + l_linenumber as bigint) as covariateId, cast(1.0 as double) as covariateValue from lineitem
  union all select l_orderkey, cast(500 as bigint), sum(l_quantity) from lineitem group by l_orderkey
  union all select l_orderkey, cast(501 as bigint), sum(l_discount) from lineitem group by l_orderkey) where covariateValue <> 0),
betas as (select * from (values """ + ", ".join(f"(cast({c} as bigint), cast({b} as double))" for c, b in BETA.items()) + """) as t(covariateId, beta)),
sums as (select c.rowId, sum(c.covariateValue * b.beta) as s from covariates c join betas b on c.covariateId = b.covariateId group by c.rowId),
xbs as (select o.*, coalesce(s.s, 0.0) as xb0 from outcomes o left join sums s on o.rowId = s.rowId)"""
