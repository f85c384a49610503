"""Correlated noise against the dense formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import linear, noise

T = "kind STRING, metric STRING, well STRING, time LONG, d_obs DOUBLE, sigma DOUBLE"


def _study(spark, n, seed=3):
    """n members, 3 components, 12 observations: two wells with six years each, gaps in between."""
    r = np.random.default_rng(seed)
    years = [2000, 2001, 2003, 2004, 2007, 2008]
    keys = [("oil", w, y) for w in ("W1", "W2") for y in years]
    z, h, s = r.normal(size=(n, 3)), r.normal(size=(3, 12)), r.uniform(0.2, 1.5, 12)
    d, y = z @ h + r.normal(0, 0.3, (n, 12)), r.normal(size=12)
    theta = spark.createDataFrame([(i, 0, i, f"c{j}", j, float(z[i, j])) for i in range(n) for j in range(3)], "member_id LONG, cluster_id LONG, model_id LONG, comp STRING, comp_pos INT, value DOUBLE")
    sim = spark.createDataFrame([(i, 0, "cum", *k, float(d[i, j])) for i in range(n) for j, k in enumerate(keys)], "member_id LONG, cluster_id LONG, kind STRING, metric STRING, well STRING, time LONG, value DOUBLE")
    truth = spark.createDataFrame([("cum", *k, float(y[j]), float(s[j])) for j, k in enumerate(keys)], T)
    c = np.array([[s[a] * s[b] * 0.6 ** abs(keys[a][2] - keys[b][2]) * (keys[a][1] == keys[b][1]) for b in range(12)] for a in range(12)])
    return z, d, y, c, theta, sim, truth, ["|".join(map(str, k)) for k in keys]


@pytest.mark.parametrize("n", [9, 40])
@pytest.mark.parametrize("energy", [0.95, 1.0])
def test_update_equals_the_dense_formula(spark, n, energy):
    """Fewer members than positions, and more: both ways of the decomposition."""
    z, d, y, c, theta, sim, truth, _ = _study(spark, n)
    cov = noise.along_time(truth, 0.6)
    got = linear.ensemble_update(theta, sim, truth, None, energy, perturb=False, covariance=cov).toPandas().pivot(index="member_id", columns="comp", values="value").to_numpy()
    zc, dc = z - z.mean(0), d - d.mean(0)
    _, s, vt = np.linalg.svd(dc / np.sqrt(n - 1), full_matrices=False)
    keep = min(int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), energy)) + 1, int((s > 1e-12).sum()))
    v = vt[:keep].T
    gain = (zc.T @ dc / (n - 1)) @ v @ np.linalg.solve(np.diag(s[:keep] ** 2) + v.T @ c @ v, v.T)
    assert np.abs(got - (z + (y - d) @ gain.T)).max() < 1e-9


def test_draws_have_the_covariance(spark):
    *_, c, theta, sim, truth, names = _study(spark, 5)
    wanted = spark.range(4000).select(F.col("id").alias("member_id"), F.explode(F.array(*map(F.lit, names))).alias("pos"))
    eps = noise.perturbations(wanted, noise.along_time(truth, 0.6), 11).toPandas().pivot(index="member_id", columns="pos", values="eps")[names].to_numpy()
    assert np.abs(np.cov(eps.T) - c).max() < 0.12 and np.abs(eps.mean(0)).max() < 0.08
    lower = noise.factors(noise.along_time(truth, 0.6)).toPandas()
    m = np.zeros((12, 12))
    for p, o, x in lower.itertuples(index=False):
        m[names.index(p), names.index(o)] = x
    assert np.abs(m @ m.T - c).max() < 1e-12


def test_perturbed_update_uses_the_draws(spark):
    z, d, y, c, theta, sim, truth, names = _study(spark, 30)
    cov = noise.along_time(truth, 0.6)
    wanted = sim.select("member_id", F.concat_ws("|", "metric", "well", F.col("time").cast("string")).alias("pos"))
    eps = noise.perturbations(wanted, cov, 42).toPandas().pivot(index="member_id", columns="pos", values="eps")[names].to_numpy()
    gain = linear.ensemble_gain(theta, sim, truth, 1.0, covariance=cov).toPandas().pivot(index="comp", columns="pos", values="gain")[names].to_numpy()
    got = linear.ensemble_update(theta, sim, truth, None, 1.0, covariance=cov).toPandas().pivot(index="member_id", columns="comp", values="value").to_numpy()
    assert np.abs(got - (z + (y + eps - d) @ gain.T)).max() < 1e-9


def test_a_covariance_that_does_not_fit(spark):
    *_, theta, sim, truth, _ = _study(spark, 6)
    with pytest.raises(ValueError, match="match"):
        linear.ensemble_gain(theta, sim, truth, covariance=noise.along_time(truth.where("time > 2000"), 0.6))
    with pytest.raises(ValueError, match="correlation"):
        noise.along_time(truth, 1.0)


def test_a_block_without_full_rank(spark):
    cov = spark.createDataFrame([("b", a, b, 4.0) for a in "xy" for b in "xy"], "block STRING, pos_a STRING, pos_b STRING, cov DOUBLE")
    f = {(r.pos, r.other): r.factor for r in noise.factors(cov).collect()}
    assert f["x", "x"] == pytest.approx(2) and f["y", "x"] == pytest.approx(2) and f.get(("y", "y"), 0.0) < 1e-3
