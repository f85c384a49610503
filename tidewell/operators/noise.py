"""Noise that is correlated within blocks of positions: covariances, draws and products.

A covariance is a table (block, pos_a, pos_b, cov) of all pairs of positions
within each block, in both orders; between blocks noise is independent. A block,
as the times of a well, meets in one task; all of them never do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import portable_uniform
from tidewell.operators.series import KEY

#: Least share of a block's mean variance that is added to the diagonal where rounding leaves a matrix without a factor.
JITTER = 1e-10


def along_time(truth: DataFrame, rho: float, by=("metric", "well"), keys=KEY, time: str = "time") -> DataFrame:
    """The covariance of noise whose correlation is rho to the power of the distance in time, within each of `by` (so 1 at equal times); deviations are the truth's sigma."""
    if not 0 <= rho < 1:
        raise ValueError("a correlation from 0 on and below 1 is wanted")
    pos = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    t = truth.select(F.concat_ws("|", *(F.col(b).cast("string") for b in by)).alias("block"), pos.alias("pos"), F.col(time).cast("double").alias("t"), "sigma").distinct()
    a, b = (t.select(F.col("block").alias(f"block_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("pos", "t", "sigma"))) for x in "ab")
    both = a.join(b, F.col("block_a") == F.col("block_b"))
    power = F.when(F.col("pos_a") == F.col("pos_b"), 1.0).otherwise(F.pow(F.lit(float(rho)), F.abs(F.col("t_a") - F.col("t_b"))))
    return both.select(F.col("block_a").alias("block"), "pos_a", "pos_b", (F.col("sigma_a") * F.col("sigma_b") * power).alias("cov"))


def checked(covariance: DataFrame, positions: DataFrame) -> DataFrame:
    """The covariance of the given positions (pos). A position without a variance, or one named twice, is an error."""
    inside = covariance.join(positions.select(F.col("pos").alias("pos_a")), "pos_a", "left_semi").join(positions.select(F.col("pos").alias("pos_b")), "pos_b", "left_semi")
    own = inside.where("pos_a = pos_b").groupBy(F.col("pos_a").alias("pos")).agg(F.count("*").alias("n"))
    if positions.join(own, "pos", "left").where("n is null or n <> 1").limit(1).count():
        raise ValueError("members or observations don't match")
    return inside


def _matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = sorted(pdf["pos_a"].unique())
    at = {x: i for i, x in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    c[pdf["pos_a"].map(at).to_numpy(), pdf["pos_b"].map(at).to_numpy()] = pdf["cov"].to_numpy()
    return names, c


def factors(covariance: DataFrame) -> DataFrame:
    """(pos, other, factor): the lower Cholesky factor of each block, positions in the order of their names; zeros are left out."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, c = _matrix(pdf)
        try:
            lower = np.linalg.cholesky(c)
        except np.linalg.LinAlgError:
            lower = np.linalg.cholesky(c + JITTER * max(np.trace(c) / len(c), 1e-300) * np.eye(len(c)))
        i, j = np.nonzero(lower)
        return pd.DataFrame({"pos": np.array(names)[i], "other": np.array(names)[j], "factor": lower[i, j]})

    return covariance.groupBy("block").applyInPandas(one, "pos string, other string, factor double")


def normal(seed: int, *cols) -> F.Column:
    """A normal draw with deviation 1 that any engine shares: by the sine and cosine rule, from two uniform draws of seed and columns."""
    u, v = portable_uniform(seed, *cols), portable_uniform(seed + 1, *cols)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def perturbations(wanted: DataFrame, covariance: DataFrame, seed: int = 42) -> DataFrame:
    """(member_id, pos, eps) for the wanted (member_id, pos): draws with the covariance. A member's draw of a position depends on seed, member and block alone."""
    lower = factors(covariance)
    rows = wanted.select("member_id", "pos").distinct().join(lower, "pos")
    return rows.groupBy("member_id", "pos").agg(F.sum(F.col("factor") * normal(seed, "member_id", "other")).alias("eps"))


def quadratic(covariance: DataFrame, vectors: DataFrame, width: int) -> np.ndarray:
    """Sum over blocks of V' C V, for the rows v (pos, v) of V: a task multiplies a block, and products are added row by row."""
    block_of = covariance.where("pos_a = pos_b").select(F.col("block").alias("_b"), F.col("pos_a").alias("pos"))
    placed = vectors.join(block_of, "pos").select("_b", "pos", "v")

    def product(cov: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names, c = _matrix(cov)
        v = np.stack(rows.set_index("pos").loc[names, "v"].to_numpy())
        m = v.T @ c @ v
        return pd.DataFrame({"i": np.arange(len(m)), "row": list(m)})

    parts = covariance.groupBy("block").cogroup(placed.groupBy("_b")).applyInPandas(product, "i long, row array<double>")
    sums = parts.groupBy("i").agg(*(F.sum(F.col("row")[k]).alias(f"s{k}") for k in range(width)))
    out = np.zeros((width, width))
    for r in sums.collect():  # kept by kept values
        out[r.i] = [r[f"s{k}"] for k in range(width)]
    return out
