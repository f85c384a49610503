"""Compare prior and posterior forecasts with what was observed, metric by metric.

    python -m jobs.forecast_report --input TABLES --output OUT --config jobs/forecast_report.json

Members are suppliers, as in tidewell.virtual; prior members' yearly series come from their lines. Output, in Parquet:

    OUT/series/metric=M     yearly series of prior and posterior members
    OUT/report/metric=M     a row for each well and year: quantiles of both, width ratio, median shift, CRPS of both,
                            whether the observation lies between the outer quantiles, residual and its rank in the metric

Only the configured metrics' folders are written, so a run for one metric leaves the others as they are, and a second run
gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import log, main, replace_partitions
from tidewell.functions.columns import status, width_text
from tidewell.operators import series
from tidewell.virtual import Virtual

DEFAULTS = {"quantiles": [0.1, 0.5, 0.9], "outlier_z": 2.0, "metrics": ["disc", "qty", "rev"]}
SERIES = "metric STRING, role STRING, member_id LONG, cluster_id LONG, well STRING, time LONG, value DOUBLE"
KEY = ["metric", "well", "time"]


def member_series(tables: Virtual, metrics: list[str]) -> DataFrame:
    """Yearly series of prior and posterior members, long."""
    prior = tables.rates.where(F.col("metric").isin(metrics))
    both = prior.withColumn("role", F.lit("prior")).unionByName(tables.post(prior).withColumn("role", F.lit("posterior")))
    return both.select("metric", "role", "member_id", "cluster_id", "well", "time", "value")


def compare(rows: DataFrame, observed: DataFrame, quantiles: list[float], outlier_z: float) -> DataFrame:
    """One row for each (metric, well, time) of the series.

    Keys without an observation have null d_obs, CRPS, residual and rank, and
    verdict NEUTRAL; a width of 0 counts as 1 in the ratio, a deviation of 0 or
    unknown as 1 in the residual; equal residuals rank by well, then time.
    """
    role = {r: rows.where(F.col("role") == r) for r in ("prior", "posterior")}
    names = [f"p{round(100 * q)}" for q in quantiles]
    out = None
    for r, prefix in (("prior", "prior"), ("posterior", "post")):
        q = series.column_quantiles(role[r], quantiles).withColumnsRenamed({n: f"{prefix}_{n}" for n in names})
        q = q.join(series.crps(role[r], observed).withColumnRenamed("crps", f"{prefix}_crps"), KEY, "left")
        out = q if out is None else out.join(q, KEY, "full")
    out = out.join(series.width_ratio(role["posterior"], role["prior"]), KEY, "left").join(series.median_shift(role["posterior"], role["prior"]), KEY, "left")
    misfit = series.misfit(role["posterior"], observed).select(*KEY, "d_obs", "residual", "residual_z")
    out = out.join(misfit, KEY, "left")
    size = F.when(F.col("residual_z").isNotNull(), F.abs("residual_z"))
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc_nulls_last(size), "well", "time"))
    return out.withColumns({
        "inside": F.col("d_obs").between(F.col(f"post_{names[0]}"), F.col(f"post_{names[-1]}")),
        "reading": width_text("width_ratio"),
        "verdict": status("prior_crps", "post_crps", F.lit("<")),
        "outlier": F.coalesce(size > outlier_z, F.lit(False)),
        "residual_rank": F.when(size.isNotNull(), rank).cast("long"),
    })


def run(spark: SparkSession, input: str, output: str, config: dict | None = None) -> dict:
    """Write series and report of the configured metrics; return how many rows were read and written."""
    cfg = DEFAULTS | (config or {})
    tables = Virtual(spark, input)
    log.info("%d lines of %d members read from %s", tables.table("lineitem").count(), tables.members.count(), input)
    replace_partitions(member_series(tables, cfg["metrics"]).repartition("metric", "time"), f"{output}/series", "metric")
    mine = F.col("metric").isin(cfg["metrics"])
    rows = spark.read.schema(SERIES).parquet(f"{output}/series").where(mine)
    report = compare(rows, tables.observed.where(mine), cfg["quantiles"], cfg["outlier_z"])
    replace_partitions(report.repartition("metric").sortWithinPartitions("metric", "residual_rank", "well", "time"), f"{output}/report", "metric")
    done = {"series": rows.count(), "report": read_report(spark, output).where(mine).count()}
    log.info("%d rows of series and %d of the report written to %s", done["series"], done["report"], output)
    return done


def read_report(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(f"{output}/report")


run.defaults = DEFAULTS

if __name__ == "__main__":
    raise SystemExit(main(__doc__.splitlines()[0], run))
