"""Canonical tables of an ensemble study, and checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEYS = "metric STRING, well STRING, time BIGINT"
MEMBERS = "member_id BIGINT, model_id BIGINT, cluster_id BIGINT, seed BIGINT, ord BIGINT"
THETA = "member_id BIGINT, cluster_id BIGINT, model_id BIGINT, comp STRING, comp_pos INT, value DOUBLE"
SERIES = f"member_id BIGINT, cluster_id BIGINT, kind STRING, {_KEYS}, value DOUBLE"
OBSERVED = f"kind STRING, {_KEYS}, d_obs DOUBLE, sigma DOUBLE"
CELLS = "model BIGINT, i INT, j INT, k INT, poro DOUBLE, permx DOUBLE, ntg DOUBLE"


def assert_schema(df: DataFrame, ddl: str) -> DataFrame:
    """df cast to the schema's columns, in its order; a missing column or another kind of type is an error."""
    want = T.StructType.fromDDL(ddl) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(ddl)
    have = {f.name: f.dataType for f in df.schema}
    if missing := [f.name for f in want if f.name not in have]:
        raise ValueError(f"columns are missing: {missing}")
    for f in want:
        numeric = isinstance(f.dataType, T.NumericType), isinstance(have[f.name], T.NumericType)
        if numeric[0] != numeric[1]:
            raise ValueError(f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in want))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of a float column becomes null: averages skip nulls and spread NaN."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    return df.select(*((F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c)) for c in df.columns))


def violations(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Counts of broken rules: repeated keys, null keys, and null or NaN values."""
    null_key = " OR ".join(f"{k} IS NULL" for k in keys)
    bad = " OR ".join(f"{v} IS NULL OR isnan({v})" for v in values)
    one = df.agg(F.count_if(F.expr(null_key)).alias("null_keys"), F.count_if(F.expr(bad)).alias("bad_values"))
    again = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_keys"))
    return one.withColumn("_k", F.lit(1)).join(again.withColumn("_k", F.lit(1)), "_k").drop("_k")
