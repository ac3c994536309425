"""Fits from the command line, under spark-submit: a text file of rows in, a CSV of estimates out."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .operators.score import predict
from .plans.fit import Control, fit
from .plans.inference import profile_intervals, standard_errors
from .plans.models import Model
from .plans.priors import make_prior
from .plans.resample import Search, bootstrap, cross_validated
from .sources.text import read_text, write_diagnostics, write_predictions, write_results


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__)
    out.add_argument("input")
    out.add_argument("output")
    out.add_argument("--model", choices=[m.value for m in Model], default="sccs")
    out.add_argument("--prior", choices=["none", "laplace", "normal", "barupdate", "jeffreys"], default="laplace")
    out.add_argument("--variance", type=float, nargs="+", default=[1.0], help="two for fused and hierarchical priors")
    out.add_argument("--parents", help="a CSV of covariateId,parent for a hierarchical normal prior")
    out.add_argument("--exclude", type=int, nargs="*", default=[], help="covariates without a prior")
    out.add_argument("--bootstrap", type=int, default=0, help="replicates, written beside the estimates")
    out.add_argument("--profile", type=int, nargs="*", default=[], help="covariates whose profile intervals are written")
    out.add_argument("--tolerance", type=float, default=1e-8)
    out.add_argument("--iterations", type=int, default=100)
    out.add_argument("--ase", action="store_true", help="standard errors too")
    out.add_argument("--cv", choices=["auto", "grid"], help="choose the variance by cross-validation")
    out.add_argument("--fold", type=int, default=10)
    out.add_argument("--lower", type=float, default=0.01)
    out.add_argument("--upper", type=float, default=20.0)
    out.add_argument("--grid-size", type=int, default=10)
    out.add_argument("--seed", type=int, default=0)
    return out


def main(argv: Sequence[str] | None = None) -> None:
    """Writes estimates to the output folder; predictions, diagnostics, and what else is asked for to folders named after it."""
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    data = read_text(spark, args.input, args.model)
    parents = {r[0]: r[1] for r in spark.read.csv(args.parents, "covariateId long, parent long").collect()} if args.parents else None
    variance = args.variance if parents else args.variance[0]
    prior = make_prior(args.prior, variance, exclude=args.exclude, parents=parents, cross_validate=bool(args.cv))
    control = Control(max_iterations=args.iterations, tolerance=args.tolerance)
    if args.cv:
        search = Search(args.cv, args.fold, args.lower, args.upper, args.grid_size, seed=args.seed)
        fitted = cross_validated(data, prior, search, control)
    else:
        fitted = fit(data, prior, control)
    write_results(spark, args.output, fitted.betas, standard_errors(fitted) if args.ase else None)
    write_predictions(predict(data, fitted.frame()), f"{args.output}-predictions")
    write_diagnostics(spark, f"{args.output}-diagnostics", fitted)
    if args.bootstrap:
        table, _ = bootstrap(fitted, args.bootstrap, args.seed)
        rows = [(int(c), *map(float, v.values())) for c, v in table.items()]
        spark.createDataFrame(rows, "covariateId long, original double, bias double, std_err double, bpi_lower double, bpi_upper double").write.option("header", True).csv(f"{args.output}-bootstrap", mode="overwrite")
    if args.profile:
        rows = [(int(c), *v) for c, v in profile_intervals(fitted, args.profile, allow_regularized=True).items()]
        spark.createDataFrame(rows, "covariateId long, lower double, upper double").write.option("header", True).csv(f"{args.output}-intervals", mode="overwrite")


if __name__ == "__main__":
    main()
