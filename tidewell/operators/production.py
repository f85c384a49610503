"""Link of geology to production: what geological predictors add to the parameters in explaining responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import geology, linear

#: Complete rows under which no standardised coefficients are given.
LEAST_ROWS = 20


def join_rows(theta: DataFrame, responses: DataFrame, seed_map: DataFrame, descriptors: DataFrame) -> DataFrame:
    """One row a member: its parameters as columns (model_id, cluster, member_id), responses by member_id, and the descriptors of
    its model's seed; members without a seed or a descriptor stay, with nulls."""
    seeds = seed_map.select("model_id", F.col("seed").alias("seed_real")).dropDuplicates(["model_id"])
    geo = descriptors.withColumnRenamed("seed", "_seed")
    return theta.join(responses, "member_id", "left").join(seeds, "model_id", "left").join(geo, F.col("seed_real") == F.col("_seed"), "left").drop("_seed")


def production_link(
    rows: DataFrame, parameters: list[str], geological: list[str], responses: list[str], cluster: str = "cluster", draws: int = 2000,
    seed: int = 42
) -> dict[str, DataFrame]:
    """Tables uplift, src2 and correlations of complete rows.

    uplift has a row for each response and scope (all, and each cluster): both
    R2 in sample and cross-validated, the gain with its bootstrap interval, and
    status TOO_FEW_SAMPLES where there are under parameters + predictors + 5
    rows. src2 leaves out responses with under LEAST_ROWS complete rows.
    """
    long = rows.select(
        F.col(cluster).cast("string").alias("_c"), *(F.col(c).cast("double").alias(c) for c in [*parameters, *geological, *responses])
    ).unpivot(["_c", *parameters, *geological], responses, "response", "y")
    scopes = long.where("y is not null").withColumn("scope", F.explode(F.array_compact(F.array(F.lit("all"), F.concat(F.lit("cluster_"), "_c")))))
    fitted = linear.r2_uplift(scopes.withColumn("g", F.concat_ws("|", "scope", "response")), "g", parameters, geological, "y", draws, seed)
    part = F.split("group", r"\|", 2)
    status = F.when(F.isnan("r2_base") | F.col("r2_base").isNull(), "TOO_FEW_SAMPLES").otherwise("OK")
    uplift = fitted.select(part[1].alias("response"), part[0].alias("scope"), *(c for c in fitted.columns if c != "group"), status.alias("status"))
    full = long.dropna()
    enough = full.groupBy("response").count().where(F.col("count") >= LEAST_ROWS).select("response")
    src2 = linear.src2(
        full.join(enough, "response", "left_semi"), "response", [*parameters, *geological], "y", draws, seed
    ).withColumnRenamed("group", "response")
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    return {"uplift": uplift, "src2": src2, "correlations": geology.response_correlations(numbered, geological, responses, ["_row"])}
