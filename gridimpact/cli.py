"""Commands: dataset (the training table from stage tables), models (predictions of leave-one-out folds), evaluate (metrics)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from gridimpact.ml.events import prepared
from gridimpact.ml.metrics import all_models
from gridimpact.ml.models import MODELS, TARGET, leave_one_out, model_of
from gridimpact.operators.assemble import median_filled, training_table
from gridimpact.session import ship
from gridimpact.sources.tables import require, write_stage

STAGES = ("wind", "admin", "impact", "rain", "storms", "history", "static")


def dataset(spark: SparkSession, inputs: str, output: str, join_on: str) -> None:
    """Reads the stage tables of a folder and writes the training table, a partition for each country."""
    stage = {name: spark.read.parquet(f"{inputs}/{name}") for name in STAGES}
    rows = training_table(*(stage[name] for name in STAGES), join_on=join_on)
    if "shdi" in rows.columns:
        rows = median_filled(rows, "shdi")
    write_stage(rows, output, ["iso3"])


def models(spark: SparkSession, training: str, regions: str, reports: str, output: str, name: str, strategy: str, cells: bool) -> None:
    """Writes a partition of predictions for each event, all folds in one run."""
    table: DataFrame = spark.read.parquet(training)
    named = require(spark.read.parquet(regions), ["iso3", "region"])
    rows = prepared(table, named, spark.read.parquet(reports), aggregate=not cells)
    write_stage(leave_one_out(rows, model_of(name), strategy, method=name), output, ["method", "event"])


def evaluate(spark: SparkSession, predictions: str, output: str) -> None:
    write_stage(all_models(spark.read.parquet(predictions), TARGET, "prediction_perc"), output)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("dataset")
    p.add_argument("inputs")
    p.add_argument("output")
    p.add_argument("--join-on", choices=["id", "admin"], default="id")
    p = commands.add_parser("models")
    for x in ("training", "regions", "reports", "output"):
        p.add_argument(x)
    p.add_argument("--model", choices=list(MODELS), default="2-stage-XGBoost")
    p.add_argument("--strategy", choices=["global", "walk_forward", "geo_constrained"], default="global")
    p.add_argument("--cells", action="store_true", help="train on cells instead of first-level regions")
    p = commands.add_parser("evaluate")
    p.add_argument("predictions")
    p.add_argument("output")
    a = parser.parse_args(args)
    spark = ship(SparkSession.builder.appName("gridimpact").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    if a.command == "dataset":
        dataset(spark, a.inputs, a.output, a.join_on)
    elif a.command == "models":
        models(spark, a.training, a.regions, a.reports, a.output, a.model, a.strategy, a.cells)
    else:
        evaluate(spark, a.predictions, a.output)


if __name__ == "__main__":
    main()
