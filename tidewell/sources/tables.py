"""Readers of tabular inputs (S01-S07, S13-S16, J10). Workbooks come as tables, one a sheet."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.columns import half_even, sheet_key

#: Forms of sheet names.
ENSEMBLE_SHEET = r"^51-(\d)_\d+-(\d+)$"
FORECAST_SHEET = r"^(\d)_\d+-(\d+)$"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, ddl: str, fmt: str = "csv") -> DataFrame:
    """The table at a path, or an empty one of the schema if there is nothing there."""
    schema = T._parse_datatype_string(ddl)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The Parquet table at a path; built and written first if it is absent or refresh is asked for."""
    if refresh or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_parameters(sheets: dict[str, DataFrame], components: list[str]) -> DataFrame:
    """Manifest of all sheets (MODEL, SEED, components): rows without MODEL go, the cluster is in the sheet's name after the first _, seeds are rounded half to even."""
    parts = []
    for n, (name, df) in enumerate(sheets.items()):
        cluster = int(name.split("_")[1])
        parts.append(
            df.where("MODEL is not null").select(
                F.col("MODEL").cast("long").alias("model_id"), F.lit(cluster).cast("long").alias("cluster_id"),
                half_even("SEED").cast("long").alias("seed"), F.lit(name).alias("sheet"), F.lit(n).alias("sheet_no"),
                *(F.col(c).cast("double").alias(c) for c in components)
            )
        )
    return reduce(DataFrame.unionByName, parts)


def theta_by_sheet(sheets: list[DataFrame], components: list[str]) -> DataFrame:
    """As load_parameters, but the cluster is the sheet's place, from 1."""
    return reduce(
        DataFrame.unionByName,
        (
            df.where("MODEL is not null").select(
                F.lit(i + 1).cast("long").alias("cluster_id"), F.col("MODEL").cast("long").alias("model_id"),
                *(F.col(c).cast("double").alias(c) for c in components)
            ) for i,
            df in enumerate(sheets)
        )
    )


def seed_map(df: DataFrame, order: str) -> DataFrame:
    """(model_id, seed): complete rows, seeds rounded, the first row of each model."""
    if missing := {"MODEL", "SEED"} - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    rows = df.where("MODEL is not null and SEED is not null").withColumn("_r", F.row_number().over(Window.partitionBy("MODEL").orderBy(order))).where("_r = 1")
    return rows.select(F.col("MODEL").cast("long").alias("model_id"), half_even("SEED").cast("long").alias("seed"))


def classify_wells(headers: DataFrame, column: str = "header") -> DataFrame:
    """(well, kind): names in a header's last parentheses; names with . # or a space are left out; WELL* produce, INJ* inject."""
    w = F.regexp_extract(column, r"\(([^()]*)\)\s*$", 1)
    kind = F.when(F.startswith("well", F.lit("WELL")), "producer").when(F.startswith("well", F.lit("INJ")), "injector")
    named = headers.select(w.alias("well")).where(~F.col("well").rlike(r"[.# ]") & (F.col("well") != "")).distinct()
    return named.select("well", kind.alias("kind")).where("kind is not null")


def melt_dynamics(wide: DataFrame, ids: list[str], metrics: list[str], wells: list[str]) -> DataFrame:
    """Long series from columns named `metric (well)`: what is no number, or has no column, is 0."""
    have = set(wide.columns)
    number = lambda c: F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), F.lit(0.0)) if c in have else F.lit(0.0)
    cells = [F.struct(F.lit(m).alias("metric"), F.lit(w).alias("well"), number(f"{m} ({w})").alias("value")) for m in metrics for w in wells]
    return wide.select(*ids, F.explode(F.array(*cells)).alias("c")).select(*ids, "c.metric", "c.well", "c.value")


def load_ensemble(manifest: DataFrame, dynamics: DataFrame) -> DataFrame:
    """Series (sheet, metric, well, time, value) joined to the manifest by the cluster and seed of the sheet's name.

    Sheets of another form or without a manifest row go; of equal manifest keys
    the last row counts; members whose series is shorter or longer than that of
    the first go as well. A missing value is an error, and so is no row at all.
    """
    c, s = sheet_key("sheet", ENSEMBLE_SHEET)
    last = manifest.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id", "seed").orderBy(F.desc("ord")))).where("_r = 1").drop("_r")
    rows = dynamics.withColumn("cluster_id", c).withColumn("seed", s).where("cluster_id is not null").join(
        last.select("cluster_id", "seed", "model_id", "ord"), ["cluster_id", "seed"]
    )
    sizes = rows.groupBy("cluster_id", "seed").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    first = sizes.agg(F.min_by("n", "o").alias("want"))
    out = rows.join(sizes.crossJoin(F.broadcast(first)).where("n = want").select("cluster_id", "seed"), ["cluster_id", "seed"], "left_semi")
    value = F.when(F.col("value").isNull() | F.isnan("value"), F.raise_error(F.lit("a series has a missing value"))).otherwise(F.col("value"))
    if not out.limit(1).count():
        raise ValueError("no series matches the manifest")
    return out.withColumn("value", value)


def lookup_observations(want: DataFrame, rows: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """For each wanted (keys, time): the value of that time, else the first of the same month, else 0."""
    exact = rows.groupBy(*keys, time).agg(F.min(value).alias("_exact"))
    month = rows.groupBy(*keys, F.year(time).alias("_y"), F.month(time).alias("_m")).agg(F.min_by(value, F.struct(time, value)).alias("_month"))
    w = want.withColumn("_y", F.year(time)).withColumn("_m", F.month(time))
    joined = w.join(exact, [*keys, time], "left").join(month, [*keys, "_y", "_m"], "left")
    return joined.select(*want.columns, F.coalesce("_exact", "_month", F.lit(0.0)).alias(value))


def last_in_year(want: DataFrame, rows: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """For each wanted (keys, year): the last value of the year, else 0."""
    last = rows.groupBy(*keys, F.year(time).cast("long").alias("year")).agg(F.max_by(value, F.struct(time, value)).alias("_v"))
    return want.join(last, [*keys, "year"], "left").select(*want.columns, F.coalesce("_v", F.lit(0.0)).alias(value))


def load_forecast(manifest: DataFrame, dynamics: DataFrame, cutoff) -> DataFrame:
    """Cumulative series from a cutoff on, less the last value before it, joined to the manifest; unlike load_ensemble a missing value is kept. Sheets without late rows, or with another number of them than the first, go."""
    c, s = sheet_key("sheet", FORECAST_SHEET)
    rows = dynamics.withColumn("cluster_id", c).withColumn("seed", s).where("cluster_id is not null").join(
        manifest.select("cluster_id", "seed", "model_id", "ord"), ["cluster_id", "seed"]
    )
    base = rows.where(F.col("time") < cutoff).groupBy("cluster_id", "seed", "metric", "well").agg(F.max_by("value", "time").alias("_b"))
    late = rows.where(F.col("time") >= cutoff)
    sizes = late.groupBy("cluster_id", "seed").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    want = sizes.agg(F.min_by("n", "o").alias("want"))
    late = late.join(sizes.crossJoin(F.broadcast(want)).where("n = want").select("cluster_id", "seed"), ["cluster_id", "seed"], "left_semi")
    return late.join(base, ["cluster_id", "seed", "metric", "well"], "left").withColumn("value", F.col("value") - F.coalesce("_b", F.lit(0.0))).drop("_b")
