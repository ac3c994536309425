"""The text format of rows with sparse entries, MatrixMarket output, and tables of results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.data import RegressionData, from_tables, numbered
from .paths import new_folder

OPTIONS = ("row_label", "stratum_label", "weight", "offset", "bbr_outcome", "log_offset", "add_intercept", "indicator_only", "sparse", "dense")


def read_text(spark: SparkSession, path: str, model: str = "lr", **defaults: bool) -> RegressionData:
    """Rows ``[row] [stratum] [weight] [time] outcome [offset] id:value ...`` separated by white space.

    A first line starting with # names the options in force (the first line of the first file by name); else they are the keyword
    arguments. Other lines starting with # are an error. Survival models have the time before the outcome. Entries without a value are
    indicators; outcomes of -1 count as 0 with bbr_outcome. Rows without a label get an id from their place, and are written to the
    shared folder with it, so that both tables agree on it whatever is run again.
    """
    raw = spark.read.text(path)
    first = spark.read.text(sorted(raw.inputFiles())[0]).head(1) if raw.inputFiles() else []
    header = first[0]["value"].strip() if first and first[0]["value"].startswith("#") else ""
    lines = raw.withColumn("value", F.trim("value")).filter("value <> ''")
    if lines.filter(F.col("value").startswith("#")).limit(2).count() > bool(header):
        raise ValueError("only the first line may start with #")
    said = header.lstrip("#").split()
    options = {o: (o in said) if header else bool(defaults.get(o)) for o in OPTIONS}
    cells = lines.filter(~F.col("value").startswith("#")).select(F.split("value", r"\s+").alias("c"))
    fields = [f for f in ("row_label", "stratum_label", "weight") if options[f]]
    fields += ["time"] if model in ("cox", "cox_raw", "cox_time", "fgr", "sccs") else []
    fields += ["outcome"] + ["offset"] * options["offset"]
    cell = {f: F.get("c", F.lit(i)) for i, f in enumerate(fields)}
    row_id = cell["row_label"].cast("long") if "row_label" in cell else F.monotonically_increasing_id()
    y = cell["outcome"].cast("double")
    rows = cells.select(
        row_id.alias("rowId"),
        (cell["stratum_label"].cast("long") if "stratum_label" in cell else F.lit(0).cast("long")).alias("stratumId"),
        (F.when(y > 0, y).otherwise(0.0) if options["bbr_outcome"] else y).alias("y"),
        (cell["time"].cast("double") if "time" in cell else cell["offset"].cast("double") if "offset" in cell else F.lit(1.0)).alias("time"),
        *([cell["weight"].cast("double").alias("weights")] if "weight" in cell else []),
        F.slice("c", len(fields) + 1, F.greatest(F.size("c"), F.lit(1))).alias("entries"),
    )
    if "row_label" not in cell:
        folder = new_folder(spark, "rows")
        rows.write.parquet(folder)
        rows = spark.read.schema(rows.schema).parquet(folder)
    pair = F.split("entry", ":")
    long = rows.select("rowId", F.explode("entries").alias("entry")).filter("entry <> ''")
    long = long.select("rowId", pair[0].cast("long").alias("covariateId"), F.coalesce(F.get(pair, F.lit(1)).cast("double"), F.lit(1.0)).alias("covariateValue"))
    return from_tables(rows.drop("entries"), long, model, options["add_intercept"], check_row_ids=False)


def matrix_market(data: RegressionData) -> DataFrame:
    """(place, value): lines of a MatrixMarket coordinate file, rows and columns numbered by id; write value in order of place."""
    row = numbered(data.outcomes.select("rowId"), [F.col("rowId")], "r")
    column = numbered(data.covariates.select("covariateId").distinct(), [F.col("covariateId")], "c")
    entries = data.covariates.join(row, "rowId").join(column, "covariateId")
    body = entries.select((F.col("c") * (1 << 40) + F.col("r")).alias("place"), F.concat_ws(" ", "r", "c", F.col("covariateValue").cast("string")).alias("value"))
    n = entries.agg(F.count("*").alias("nnz")).join(row.agg(F.count("*").alias("rows")), F.lit(True)).join(column.agg(F.count("*").alias("cols")), F.lit(True))
    head = n.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit("%%MatrixMarket matrix coordinate real general").alias("value")), F.struct(F.lit(1).cast("long").alias("place"), F.concat_ws(" ", "rows", "cols", "nnz").alias("value")))).alias("l")).select("l.*")
    return head.union(body)


def write_results(spark: SparkSession, path: str, estimates: Mapping[int, float], errors: Mapping[int, float] | None = None) -> None:
    """label, estimate[, standard error] as CSV."""
    rows = [(c, b, *([errors[c]] if errors else [])) for c, b in estimates.items()]
    spark.createDataFrame(rows, "label long, estimate double" + ", ase double" * bool(errors)).coalesce(1).write.option("header", True).csv(path, mode="overwrite")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """rowId, value as CSV, in as many files as there are partitions."""
    predictions.select("rowId", "value").write.option("header", True).csv(path, mode="overwrite")


def write_diagnostics(spark: SparkSession, path: str, fitted: object) -> None:
    """One row of what a fit says of itself as CSV: model, flag, iterations, likelihood, prior, and the hyperparameters."""
    row = {"model": str(fitted.data.model), "return_flag": fitted.return_flag, "iterations": fitted.iterations, "log_likelihood": float(fitted.log_likelihood), "log_prior": float(fitted.log_prior), **fitted.prior.variances}
    kinds = {str: "string", int: "long", float: "double"}
    spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items())).write.option("header", True).csv(path, mode="overwrite")
