"""What the jobs share: settings, the command line, logging, partitioned writes."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults, with the values of a JSON file over them; the file may lie wherever Spark reads. An unknown name is an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {unknown}")
    return defaults | given


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write df below path, a folder for each value of the named columns; folders of values that df doesn't hold stay. A repeated write gives the same files' rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def main(description: str, run: Callable[..., dict], argv: list[str] | None = None, checkpoint: bool = False) -> int:
    """Parse the command line, make a session, run, and stop the session."""
    p = argparse.ArgumentParser(description=description)
    p.add_argument("--input", required=True, help="folder of the given tables (NAME.parquet), local or remote")
    p.add_argument("--output", required=True, help="folder of the results, local or remote")
    if checkpoint:
        p.add_argument("--checkpoint", required=True, help="folder in which the stream notes what it has taken")
    p.add_argument("--config", help="JSON file of settings")
    p.add_argument("--master", help="Spark master; by default that of spark-submit, else all local cores")
    args = vars(p.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder, master = SparkSession.builder.appName(run.__module__), args.pop("master")
    builder = builder.config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(master) if master else builder).getOrCreate()
    try:
        args["config"] = settings(spark, args.pop("config"), run.defaults)
        run(spark, args.pop("input"), args.pop("output"), **args)
    finally:
        spark.stop()
    return 0
